"""Cheap looks at JSON lines before any parse: first key, one member, the arm of a union."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.arrays import let, running
from docframe.spec import INTEGERS, SPARK_TYPE, UnionSpec

_FIRST_KEY = r'^[ \t\r\n]*\{[ \t\r\n]*"([^"\\]*)"[ \t\r\n]*:'
#: C0 controls but tab; a line feed ends a line and is none.
_CONTROL = r"[\x00-\x08\x0B-\x1F]"


def path_of(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def kind_of(line: Column) -> Column:
    """The first key of the object on a line, if it is written without escapes."""
    return F.when(F.regexp_like(line, F.lit(_FIRST_KEY)), F.regexp_extract(line, _FIRST_KEY, 1))


_STRING = r'"(?:[^"\\]|\\.)*+"'
_TOKEN = _STRING + r"|[{}\[\],]|[^\"{}\[\],]++|\""


def _brackets(depth: int) -> str:
    """Pattern of a JSON object or array with at most ``depth`` levels of brackets; nothing in it backtracks."""
    deeper = f"|{_brackets(depth - 1)}" if depth > 1 else ""
    return rf'[{{\[](?:[^"{{}}\[\]]++|{_STRING}{deeper})*+[}}\]]'


#: Objects and arrays of at most so many levels are cut by patterns; deeper ones are walked token by token.
LEVELS = 8
NESTED = rf"^[ \t\r\n]*{_brackets(LEVELS)}[ \t\r\n]*\z"
_PART = rf'(?:[^"{{}}\[\],]++|{_STRING}|{_brackets(LEVELS - 1)})++'
_HEAD = rf"^{_STRING}[ \t\r\n]*:"
_BLANK = " \t\r\n"


def first_of(name: str) -> str:
    """Pattern of an object up to the end of its first member of a name that is written without escapes; group 1 is the member's text."""
    head = rf'[ \t\r\n]*"{re.escape(name)}"[ \t\r\n]*:'
    return rf"^[ \t\r\n]*\{{(?:(?!{head}){_PART},)*+{head}({_PART})"


def unescaped(token: Column) -> Column:
    """The text of a JSON string token."""
    plain = F.substr(token, F.lit(2), F.char_length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")).otherwise(plain)


def _stepped(text: Column) -> Column:
    """struct of the tokens of a JSON text and the number of brackets open before each."""
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0).cast("bigint")
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return let(tokens, lambda t: F.struct(t.alias("tokens"), running(F.transform(t, step)).alias("depth")))


def split_members(text: Column) -> Column:
    """Array of name and raw of an object's members, or of the raw elements of an array (name null), byte for byte and in order.

    What lies between the commas of the outermost level is matched by one pattern that
    holds ``LEVELS`` levels of brackets; a deeper text is cut into strings, brackets,
    commas and what lies between, and a running depth tells those commas. The text must
    be valid JSON.
    """

    def cuts(s: Column) -> Column:
        t, d = s["tokens"], s["depth"]
        edge = lambda k: ((F.get(t, k) == ",") & (F.get(d, k) == 1)) | (F.get(t, k).isin("{", "[") & (F.get(d, k) == 0)) | (F.get(t, k).isin("}", "]") & (F.get(d, k) == 1))
        return F.struct(t.alias("tokens"), F.filter(F.sequence(F.lit(0), F.size(t) - 1), edge).alias("at"))

    def walked(s: Column) -> Column:
        at = s["at"]
        span = lambda k, i: F.array_join(F.slice(s["tokens"], k + 2, F.get(at, i + 1) - k - 1), "")
        return F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), span)

    def matched(b: Column) -> Column:
        return F.regexp_extract_all(F.substr(b, F.lit(2), F.char_length(b) - 2), F.lit(_PART), F.lit(0))

    def member(s: Column) -> Column:
        x, head = s["x"], s["head"]
        name = F.rtrim(F.substr(head, F.lit(1), F.char_length(head) - 1), F.lit(_BLANK))
        raw = F.when(head != "", F.ltrim(F.substr(x, F.char_length(head) + 1), F.lit(_BLANK))).otherwise(x)
        return F.struct(F.when(head != "", let(name, unescaped)).alias("name"), raw.alias("raw"))

    def read(parts: Column) -> Column:
        trimmed = F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "")
        return F.transform(trimmed, lambda x: let(F.struct(x.alias("x"), F.regexp_extract(x, _HEAD, 0).alias("head")), member))

    def parts(text: Column) -> Column:
        near = F.regexp_like(text, F.lit(NESTED))
        return F.when(near, let(F.btrim(text, F.lit(_BLANK)), matched)).otherwise(let(let(_stepped(text), cuts), walked))

    return read(let(text, parts))


def prefix_value(text: Column) -> Column:
    """struct<value, end> of the JSON value that a text starts with, and the bytes up to its end; null where there is none.

    What follows the value is not looked at.
    """
    scalar = F.regexp_extract(text, rf"^[ \t\r\n]*({_STRING}|-?[0-9][0-9.eE+-]*|true|false|null)", 0)

    def nested(s: Column) -> Column:
        closes = lambda k: (F.get(s["depth"], k) == 1) & F.get(s["tokens"], k).isin("}", "]")
        last = F.get(F.filter(F.sequence(F.lit(0), F.size(s["tokens"]) - 1), closes), F.lit(0))
        return F.array_join(F.slice(s["tokens"], 1, last + 1), "")

    open_ = F.regexp_like(text, F.lit(r"^[ \t\r\n]*[{\[]"))
    found = F.when(open_, let(_stepped(text), nested)).otherwise(scalar)
    bare = lambda v: F.regexp_replace(v, r"^[ \t\r\n]+", "")
    return let(found, lambda v: F.when(F.try_parse_json(v).isNotNull(), F.struct(bare(v).alias("value"), F.octet_length(v).alias("end"))))


def indented(text: Column, unit: str = "  ") -> Column:
    """A valid JSON text laid out over lines, ``unit`` for each level; empty brackets stay together, members keep their order and spelling."""

    def layout(s: Column) -> Column:
        t, depth = s["tokens"], s["depth"]
        margin = lambda n: F.concat(F.lit("\n"), F.repeat(F.lit(unit), n.cast("int")))
        bare = lambda x: F.when(F.startswith(x, F.lit('"')), x).otherwise(F.regexp_replace(x, "^:", ": "))

        def put(x: Column, k: Column) -> Column:
            d, before, behind = F.get(depth, k), F.get(t, k - 1), F.get(t, k + 1)
            return (
                F.when(x.isin("{", "["), F.when(F.coalesce(behind.isin("}", "]"), F.lit(False)), x).otherwise(F.concat(x, margin(d + 1))))
                .when(x.isin("}", "]"), F.when(before.isin("{", "["), x).otherwise(F.concat(margin(d - 1), x)))
                .when(x == ",", F.concat(x, margin(d)))
                .otherwise(bare(x))
            )

        return F.array_join(F.transform(t, put), "")

    # white space around tokens goes first; what is left of a token between others is a colon, a scalar or both
    tight = lambda s: F.struct(F.filter(F.transform(s, lambda x: F.when(F.startswith(x, F.lit('"')), x).otherwise(F.regexp_replace(x, r"[ \t\r\n]+", ""))), lambda x: x != "").alias("tokens"))
    spaced = let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.array_join(tight(t)["tokens"], ""))
    return let(let(spaced, _stepped), layout)


def valid_object(line: Column) -> Column:
    """Whether a text is one JSON object and nothing more; repeated members are allowed."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    held = F.from_json(F.concat(F.lit("["), line, F.lit(",0]")), "array<string>", strict)
    return F.coalesce(let(held, lambda h: (F.size(h) == 2) & F.startswith(F.get(h, F.lit(0)), F.lit("{"))) & F.regexp_like(line, F.lit(r"^[ \t\r\n]*\{")), F.lit(False))


def members(line: Column) -> Column:
    """Top-level members in order, repeated ones too: array of ordinal, name, value (text of strings, JSON text of other members) and raw (bytes as written)."""
    plain = lambda m: F.when(F.startswith(m["raw"], F.lit('"')), unescaped(m["raw"])).otherwise(m["raw"])
    found = F.transform(split_members(line), lambda m, i: F.struct(i.alias("ordinal"), m["name"].alias("name"), plain(m).alias("value"), m["raw"].alias("raw")))
    return F.when(valid_object(line), found)


def raw_member(line: Column, name: str) -> Column:
    """The first member of a name, at the top level, as it is written; null where there is none."""

    def first(line: Column) -> Column:
        # a line without the name, or an escape that may spell it, needs no look at its members
        near = F.contains(line, F.lit(name)) | F.contains(line, F.lit("\\"))
        return F.when(near & valid_object(line), F.get(F.filter(split_members(line), lambda x: x["name"] == name), F.lit(0))["raw"])

    return let(line, first)


def name_is(member: Column, name: str) -> Column:
    """Whether a member (of ``members``) has a name, however its escapes are written."""
    return member["name"] == name


def member_of(line: Column, name: str) -> Column:
    """A top-level scalar member as it is written, the first of its name; null for objects, arrays and none."""
    return let(raw_member(line, name), lambda raw: F.when(~F.substr(raw, F.lit(1), F.lit(1)).isin("{", "["), raw))


def member_string_of(line: Column, name: str) -> Column:
    """A top-level string member's text; null for anything else and for text that is written with escapes."""
    return let(raw_member(line, name), lambda raw: F.when(F.startswith(raw, F.lit('"')) & ~F.contains(raw, F.lit("\\")), F.substr(raw, F.lit(2), F.char_length(raw) - 2)))


def tag_of(line: Column, union: UnionSpec) -> Column:
    """The arm that a line names, by aliases too; 'other' for unknown arms of an open union, else null."""
    name = member_string_of(line, union.tag) if union.tag else kind_of(line)
    arm = F.lit(None).cast("string")
    for wire, to in union.aliases.items():
        arm = F.when(name == wire, to).otherwise(arm)
    arm = F.when(name.isin(*union.arms), name).otherwise(arm)
    return F.when(arm.isNotNull(), arm).when(name.isNotNull() & F.lit(union.other), "other")


def int_of(text: Column, kind: str = "bigint") -> Column:
    """An integer by its digits alone; null for any other spelling and outside the type."""
    lo, hi = INTEGERS[kind]
    digits = F.regexp_like(text, F.lit(r"^-?(0|[1-9][0-9]{0,37})$"))
    value = F.when(digits, text.try_cast("decimal(38,0)"))
    return F.when(value.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), value).cast(SPARK_TYPE.get(kind, kind))


def whole_of(text: Column, kind: str = "bigint") -> Column:
    """An integer that may be written with a zero fraction or an exponent (1.0, 1e2); exact in every digit."""
    lo, hi = INTEGERS[kind]
    pattern = r"^(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]{1,4}))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)

    def spelled(s: Column) -> Column:
        digits, shift = F.concat(s["whole"], s["fraction"]), F.when(s["exponent"] == "", 0).otherwise(s["exponent"].cast("int")) - F.char_length(s["fraction"])
        # moved left, what falls off must be zeros; moved right, zeros are added
        kept = F.greatest(F.char_length(digits) + shift, F.lit(0))
        left = F.when(F.regexp_like(F.substr(digits, kept + 1), F.lit("^0*$")), F.concat(F.lit("0"), F.substr(digits, F.lit(1), kept)))
        zero = F.regexp_like(digits, F.lit("^0+$"))
        return F.when(zero, "0").when(shift < 0, left).when(shift <= 40, F.concat(digits, F.repeat(F.lit("0"), F.greatest(shift, F.lit(0)))))

    parts = F.struct(part(2).alias("whole"), part(3).alias("fraction"), part(4).alias("exponent"))
    slow = F.concat(part(1), let(parts, spelled)).try_cast("decimal(38,0)")
    plain = F.regexp_like(text, F.lit(r"^-?(0|[1-9][0-9]*)$"))
    value = F.when(plain, text.try_cast("decimal(38,0)")).when(F.regexp_like(text, F.lit(pattern)), slow)
    return F.when(value.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), value).cast(SPARK_TYPE.get(kind, kind))


def index_of_control(text: Column) -> Column:
    """Byte offset of the first control character but tab and line feed; null where there is none."""
    before = F.regexp_extract(text, rf"(?s)^(.*?){_CONTROL}", 1)
    return F.when(F.regexp_like(text, F.lit(_CONTROL)), F.octet_length(before))


def first_control_or_end(text: Column) -> Column:
    """Byte offset of the first control character or line feed; null where there is none."""
    stop = r"[\x00-\x08\x0A-\x1F]"
    return F.when(F.regexp_like(text, F.lit(stop)), F.octet_length(F.regexp_extract(text, rf"(?s)^(.*?){stop}", 1)))
