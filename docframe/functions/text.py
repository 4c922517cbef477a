"""Written forms as expressions: JSON strings and objects, canonical JSON, CSV lines, URL-encoded forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_INTEGER = 2**53 - 1


def json_string(text: Column) -> Column:
    """A JSON string; bytes that are no UTF-8 become U+FFFD."""
    whole = F.to_json(F.struct(F.make_valid_utf8(text).alias("v")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def json5_number(value: Column) -> Column:
    """A number as JSON5 writes it: as JSON does, and Infinity, -Infinity and NaN."""
    plain = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == -float("inf"), "-Infinity").otherwise(plain)


def json_object(*columns: Column, nulls: bool = True) -> Column:
    """A JSON object of named columns; nulls are written or left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if nulls else "true"})


def with_member(obj: Column, name: str, value: Column) -> Column:
    """An object's text with one more member of JSON text at its end."""
    head = F.substr(obj, F.lit(1), F.char_length(obj) - 1)
    comma = F.when(F.regexp_like(obj, F.lit(r"^\{\s*\}$")), "").otherwise(",")
    return F.concat(head, comma, json_string(F.lit(name)), F.lit(":"), value, F.lit("}"))


def with_checksum(obj: Column, name: str = "crc") -> Column:
    """An object's text with the CRC-32 of the text before the member as its last member."""
    head = F.substr(obj, F.lit(1), F.char_length(obj) - 1)
    return with_member(obj, name, F.crc32(head.cast("binary")).cast("string"))


def canonical_number(value: Column) -> Column:
    """An integer's canonical text; null beyond 2^53 - 1, which no double holds exactly."""
    return F.when(F.abs(value.cast("decimal(38,0)")) <= SAFE_INTEGER, value.cast("string"))


def canonical_object(members: dict[str, Column]) -> Column:
    """A canonical JSON object of texts and integers: members by UTF-16 code units, nothing spare.

    The order is known when the plan is made. Null where a member has no canonical form.
    """
    parts = []
    for i, name in enumerate(sorted(members, key=lambda s: s.encode("utf-16-be"))):
        parts += [F.lit("," if i else ""), json_string(F.lit(name)), F.lit(":"), members[name]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def csv_field(text: Column, delimiter: str = ",") -> Column:
    """One CSV field: quoted if it is empty or holds a delimiter, quote or line end; null is nothing."""
    special = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(special | (text == ""), quoted).otherwise(text)


def csv_line(*columns: Column, delimiter: str = ",") -> Column:
    parts = []
    for i, c in enumerate(columns):
        parts += [F.lit(delimiter if i else ""), csv_field(c.cast("string"), delimiter)]
    return F.concat(*parts)


def csv_fields(line: Column, delimiter: str = ",") -> Column:
    """The fields of one well-formed CSV row, null for an empty unquoted one; null for a malformed row."""
    cut = re.escape(delimiter)
    field = rf'"[^"]*+(?:""[^"]*+)*+"|[^"{cut}\r\n]*+'
    ok = F.regexp_like(line, F.lit(rf"^(?:{field})(?:{cut}(?:{field}))*+$"))
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf"{cut}({field})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(x == "", None).when(F.startswith(x, F.lit('"')), F.replace(F.substr(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(ok, plain)


PAIRS = "array<struct<name:string,value:string>>"


def form_pairs(text: Column) -> Column:
    """The pairs of an URL-encoded form in order, decoded; null where a % stands without two digits."""
    pieces = F.filter(F.split(text, "&"), lambda p: p != "")
    decode = lambda x: F.try_url_decode(x)
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.char_length(F.substring_index(p, "=", 1)) + 2)).otherwise("")).alias("value"),
        ),
    )
    return F.when(~F.regexp_like(text, F.lit("%(?![0-9A-Fa-f]{2})")), pairs)


def form_path(name: Column) -> Column:
    """The segments of a form name: a[b][] is a, b and an empty one; null for a name outside the grammar."""
    ok = F.regexp_like(name, F.lit(r"^[^\[\]]+(\[[^\[\]]*\])*$"))
    head = F.regexp_extract(name, r"^([^\[\]]+)", 1)
    return F.when(ok, F.concat(F.array(head), F.regexp_extract_all(name, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))))


def form_values(pairs: Column, name: str) -> Column:
    """All values of a name, or of the name with one [] behind it, in order."""
    return F.transform(F.filter(pairs, lambda p: p["name"].isin(name, f"{name}[]")), lambda p: p["value"])


def form_write(members: dict[str, Column]) -> Column:
    """An URL-encoded form; members that are null are left out."""
    return F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v.cast("string")))) for k, v in members.items()])


#: Nanoseconds of a unit.
NANOS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
BYTES = {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "kB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}


def duration_nanos(text: Column) -> Column:
    """Nanoseconds of an exact duration such as 1m30s; a bare number is refused."""
    split = F.regexp_replace(text, "([a-z])(?=[0-9])", "$1 ")
    return F.when(F.regexp_like(text, F.lit(r"^([0-9]+(h|ms|m|s|us|ns))+$")), _sum_spaced(split, NANOS))


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 64MiB; a bare number is refused."""
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]+(B|[KMGT]iB|kB|MB|GB|TB)$")), _sum_spaced(text, BYTES))


def _sum_spaced(text: Column, units: dict[str, int]) -> Column:
    def add(acc: Column, p: Column) -> Column:
        unit, factor = F.regexp_extract(p, "([A-Za-z]+)$", 1), F.lit(None).cast("decimal(38,0)")
        for n, size in units.items():
            factor = F.when(unit == n, F.lit(size).cast("decimal(20,0)")).otherwise(factor)
        return (acc + F.regexp_extract(p, "^([0-9]+)", 1).try_cast("decimal(18,0)") * factor).cast("decimal(38,0)")

    return F.aggregate(F.split(text, " "), F.lit(0).cast("decimal(38,0)"), add).try_cast("bigint")
