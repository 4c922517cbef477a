"""Typed reading and writing of JSON records under a declared shape, as column expressions.

``parse_json_record`` gives ``struct<value, _error>``: a refused record has a null
value and an error with a code and the path of the member. A line is one JSON
object and nothing more. It is parsed once, to a variant, which also refuses
members repeated at any depth; members are then taken by name and read by their
declared kind, in records, lists, maps and tuples alike. Presence, null and wrong
type are told apart.

Policies that a variant cannot follow (repeated members taken first, last or
merged, names folded, texts kept byte for byte) read the members from the text
itself, level by level, by ``route.split_members``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.arrays import let
from docframe.functions.route import NESTED, first_of, path_of, raw_member, split_members, tag_of, valid_object, whole_of
from docframe.functions.scalars import rfc3339
from docframe.functions.text import json_string
from docframe.spec import INTEGERS, MISSING, POLICIES, FieldSpec, ListOf, MapOf, RecordSpec, TupleOf, UnionSpec, holds_raw, type_of

ERROR = "struct<code:string,field:string>"
#: A lone surrogate escape, which no text can hold.
_LONE = r"(?i)(?<!\\)((?:\\\\)*)\\u(?:d[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2}\\u)d[c-f][0-9a-f]{2})"


@cache
def error(code: str, name: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field")).cast(ERROR)


def _below(name: Column, e: Column) -> Column:
    """An error with ``name`` before its path."""
    path = F.concat(name, F.when(e["field"].isNull() | F.startswith(e["field"], F.lit("[")), "").otherwise("."), F.coalesce(e["field"], F.lit("")))
    return F.when(e.isNotNull(), F.struct(e["code"].alias("code"), path.alias("field"))).cast(ERROR)


def _result(value: Column, kind: Any, bad: Column) -> Column:
    """struct<value, error>, the value null where there is an error."""
    return let(bad.cast(ERROR), lambda e: F.struct(F.when(e.isNull(), value).cast(type_of(kind)).alias("value"), e.alias("error")))


def _json_kind(x: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID, OBJECT or ARRAY of a variant."""
    return F.substring_index(F.substring_index(F.schema_of_variant(x), "<", 1), "(", 1)


_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _scalar(x: Column, kind: str, record: RecordSpec) -> Column:
    """struct<value, error> of a scalar from its variant."""
    as_ = lambda t: F.try_variant_get(x, "$", t)
    wrong, range_ = error("UnexpectedType"), error("NumberOutOfRange")

    def of(s: Column) -> Column:
        k, text = s["kind"], s["text"]
        if kind in INTEGERS:
            lo, hi = INTEGERS[kind]
            quick = let(text.try_cast("bigint"), lambda v: F.when(v.between(lo, min(hi, 2**63 - 1)), v)).cast(type_of(kind))
            # a decimal that fits 64 bits was written with a fraction, as larger ones are whole
            small = as_("decimal(38,0)").between(F.lit(-(2**63)), F.lit(2**63 - 1))
            slow = whole_of(text, kind)
            if record.integers == "digits":
                slow = F.when((k == "DECIMAL") & ~small, slow)
            value = F.when(k == "BIGINT", quick).otherwise(slow)
            return let(value, lambda v: _result(v, kind, F.when(~k.isin(*_NUMBERS), wrong).when(v.isNull(), range_)))
        if kind in ("float", "double"):
            value = text.try_cast(kind)
            fits = F.abs(text.try_cast("double")) < float("inf")
            return _result(value, kind, F.when(~k.isin(*_NUMBERS), wrong).when(~F.coalesce(fits, F.lit(False)) | (F.abs(value) == float("inf")), range_))
        if kind.startswith("decimal"):
            value = text.try_cast(kind)
            whole = value.cast("decimal(38,18)") == text.try_cast("decimal(38,18)")
            return let(value, lambda v: _result(v, kind, F.when(~k.isin(*_NUMBERS), wrong).when(v.isNull(), range_).when(~F.coalesce(whole, F.lit(False)), error("InexactNumber"))))
        if kind == "boolean":
            return _result(as_("boolean"), kind, F.when(k != "BOOLEAN", wrong))
        if kind == "string":
            return _result(text, kind, F.when(k != "STRING", wrong))
        if kind == "timestamp":
            made = let(rfc3339(text), lambda t: F.timestamp_micros(t["seconds"] * 1_000_000 + F.floor(t["nanos"] / 1000)))
        elif kind == "date":
            made = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d\d-\d\d$")), text.try_cast("date"))
        else:
            made = F.try_to_binary(text, F.lit("base64"))
        return let(made, lambda v: _result(v, kind, F.when(k != "STRING", wrong).when(v.isNull(), error("UnsupportedValue"))))

    # taken from the variant once: each look into it is dear
    return let(F.struct(_json_kind(x).alias("kind"), as_("string").alias("text")), of)


def _value(x: Column, raw: Column, kind: Any, record: RecordSpec) -> Column:
    """struct<value, error> of a member from its variant; ``raw`` is its text, null where no policy asks for it."""
    if isinstance(kind, RecordSpec):
        inner = replace(kind, **{p: getattr(record, p) for p in POLICIES})
        parsed = _text_object(raw, inner) if _by_text(record) else _object(x, inner)
        return let(parsed, lambda p: _result(p["value"], kind, p["_error"]))
    if isinstance(kind, ListOf):
        element = lambda e, r: _nullable(e, r, kind.element, kind.nullable, record)

        def items(found: Column) -> Column:
            bad = F.get(F.filter(F.transform(found, lambda p, i: _below(F.concat(F.lit("["), i.cast("string"), F.lit("]")), p["error"])), lambda e: e.isNotNull()), F.lit(0))
            over = F.when(F.size(found) > kind.max_items, error("ItemLimit")) if kind.max_items is not None else F.lit(None).cast(ERROR)
            return _result(F.transform(found, lambda p: p["value"]), kind, F.coalesce(F.when(found.isNull(), error("UnexpectedType")), over, bad))

        if _by_text(record):
            parse = (lambda r: F.when(r == "null", F.try_parse_json(r)).otherwise(F.try_parse_json(F.lit("0")))) if isinstance(kind.element, RecordSpec) else F.try_parse_json
            found = F.when(F.startswith(raw, F.lit("[")), F.transform(_elements(raw, kind), lambda r: element(parse(r), r)))
        else:
            found = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: element(e, F.lit(None).cast("string")))
        return let(found, items)
    if isinstance(kind, MapOf):

        def entries(found: Column) -> Column:
            bad = F.get(F.filter(F.transform(found, lambda p: _below(p["key"], p["read"]["error"])), lambda e: e.isNotNull()), F.lit(0))
            pairs = F.transform(found, lambda p: F.struct(p["key"], p["read"]["value"].alias("value")))
            return _result(F.map_from_entries(pairs), kind, F.coalesce(F.when(found.isNull(), error("UnexpectedType")), bad))

        pair = lambda key, v, r: F.struct(key.alias("key"), _nullable(v, r, kind.value, kind.nullable, record).alias("read"))
        if _by_text(record):
            held = lambda m: F.transform(F.array_distinct(F.transform(m, lambda e: e["name"])), lambda n: F.struct(n.alias("name"), let(F.transform(F.filter(m, lambda e: e["name"] == n), lambda e: e["raw"]), lambda raws: _pick(raws, kind.value, record)).alias("raw")))
            found = F.when(F.startswith(raw, F.lit("{")), let(split_members(raw), lambda m: F.transform(held(m), lambda e: pair(e["name"], F.try_parse_json(e["raw"]), e["raw"]))))
        else:
            found = F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: pair(e["key"], e["value"], F.lit(None).cast("string")))
        return let(found, entries)
    if isinstance(kind, TupleOf):

        def places(found: Column) -> Column:
            read = [_value(F.get(found, F.lit(i)), F.lit(None).cast("string"), k, replace(record, duplicates="reject", names="exact")) for i, k in enumerate(kind.kinds)]
            return let(F.struct(*[r.alias(f"_{i}") for i, r in enumerate(read)]), lambda p: joined(found, p))

        def joined(found: Column, p: Column) -> Column:
            bad = F.coalesce(F.when(found.isNull() | (F.size(found) != len(kind.kinds)), error("UnexpectedType")), *[_below(F.lit(f"[{i}]"), p[f"_{i}"]["error"]) for i in range(len(kind.kinds))])
            return _result(F.struct(*[p[f"_{i}"]["value"].alias(f"_{i}") for i in range(len(kind.kinds))]), kind, bad)

        return let(F.try_variant_get(x, "$", "array<variant>"), places)
    if kind == "raw":
        return _result(raw, kind, F.lit(None))
    return _scalar(x, kind, record)


def _elements(raw: Column, kind: ListOf) -> Column:
    """The elements of an array's text as texts; those that may hold repeated members are never parsed whole."""
    if isinstance(kind.element, (RecordSpec, MapOf)):
        return F.transform(F.from_json(raw, "array<string>"), lambda x: F.coalesce(x, F.lit("null")))
    return F.transform(F.from_json(raw, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def _nullable(x: Column, raw: Column, kind: Any, nullable: bool, record: RecordSpec) -> Column:
    """An element of a list or map, which may be null if it is declared so."""
    none = F.is_variant_null(x)
    bad = F.lit(None).cast(ERROR) if nullable else error("UnexpectedType")
    return F.when(none, _result(F.lit(None), kind, bad)).otherwise(_value(x, raw, kind, record))


def _field(x: Column, raw: Column, f: FieldSpec, record: RecordSpec) -> Column:
    """struct<value, error> of a field from its member's variant, null where it is missing."""
    wire = record.wire_name(f)
    none = F.lit(None).cast(ERROR)
    made = f.default() if callable(f.default) else F.lit(None if f.default is MISSING else f.default)
    if isinstance(f.default, (list, tuple)):
        made = F.array(*map(F.lit, f.default))
    fallback = made.cast(f.spark_type)
    out = lambda value, bad: F.struct(value.cast(f.spark_type).alias("value"), bad.cast(ERROR).alias("error"))
    if f.skip_decode:
        return out(fallback, none)
    code = F.struct(F.lit(f.code).alias("code"), F.lit(None).cast("string").alias("field")).cast(ERROR)

    def judge(read: Column) -> Column:
        value = read["value"]
        checks = [read["error"]]
        if f.minimum is not None:
            checks.append(F.when(value < F.lit(f.minimum), error("NumberOutOfRange")))
        if f.maximum is not None:
            checks.append(F.when(value > F.lit(f.maximum), error("NumberOutOfRange")))
        if f.max_len is not None:
            checks.append(F.when(F.octet_length(value) > f.max_len, error("LengthLimit")))
        if f.allowed is not None:
            checks.append(F.when(~value.isin(*f.allowed), error("UnknownVariant")))
        if f.constant is not MISSING:
            checks.append(F.when(~value.eqNullSafe(F.lit(f.constant)), error("UnexpectedType")))
        if f.validate is not None:
            checks.append(F.when(~F.coalesce(f.validate(value), F.lit(False)), code))
        if f.decode is None:
            return out(value, F.coalesce(*checks))
        return let(f.decode(value), lambda v: out(v, F.coalesce(*checks, F.when(v.isNull() & value.isNotNull(), code))))

    optional = f.default is not MISSING or f.nullable
    if f.nullable:
        of_null = out(F.lit(None), none)
    elif record.nulls == "keep":
        of_null = out(fallback if f.default is not MISSING else _zero(f), none)
    else:
        of_null = out(F.lit(None), error("UnexpectedType"))
    given = let(_value(x, raw, f.kind, record), judge)
    if f.kind != "raw":
        given = F.when(F.is_variant_null(x), of_null).otherwise(given)
    missing = out(fallback, none if optional else error("MissingField"))
    return let(F.when(x.isNull(), missing).otherwise(given), lambda r: F.struct(r["value"].alias("value"), _below(F.lit(wire), r["error"]).alias("error")))


def _zero(f: FieldSpec) -> Column:
    """What a null leaves in a field without nulls and default: zero, an empty text or an empty list, else null."""
    t = f.spark_type
    if t == "string":
        return F.lit("")
    if t == "boolean":
        return F.lit(False)
    if t.startswith(("array", "map", "struct", "timestamp", "date", "binary")):
        return F.array() if t.startswith("array") else F.lit(None)
    return F.lit(0)


def _names(record: RecordSpec, f: FieldSpec) -> list[str]:
    return [record.wire_name(f), *f.aliases]


def _whole(names: Column, record: RecordSpec) -> list[Column]:
    """What may be wrong with the names of an object as a whole."""
    checks = []
    slots = [_names(record, f) for f in record.fields if f.aliases]
    if record.duplicates == "reject":
        checks += [F.when(F.size(F.array_intersect(names, F.array(*map(F.lit, n)))) > 1, error("DuplicateField")) for n in slots]
    if record.unknown_fields == "reject":
        extra = F.array_except(names, F.array(*[F.lit(n) for f in record.fields for n in _names(record, f)]))
        checks.append(F.when(F.size(extra) > 0, F.struct(F.lit("UnknownField").alias("code"), F.get(extra, F.lit(0)).alias("field")).cast(ERROR)))
    return checks


def _joined(fields: Column, whole: Column, record: RecordSpec) -> Column:
    """struct<value, _error> of a record from its fields' results."""
    bad = F.coalesce(whole, *[fields[f.field]["error"] for f in record.fields])
    values = F.struct(*[fields[f.field]["value"].alias(f.field) for f in record.fields])
    return let(bad, lambda e: F.struct(F.when(e.isNull(), values).alias("value"), e.alias("_error")))


def _object(x: Column, record: RecordSpec) -> Column:
    """struct<value, _error> of a variant that must be an object."""
    nothing = F.lit(None).cast("string")

    def read(m: Column) -> Column:
        found = lambda f: F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in _names(record, f)])
        field = lambda f: let(found(f), lambda v: _field(v, nothing, f, record))
        fields = F.struct(*[field(f).alias(f.field) for f in record.fields])
        whole = F.coalesce(F.when(m.isNull(), error("UnexpectedType")), *_whole(F.map_keys(m), record), F.lit(None).cast(ERROR))
        return let(fields, lambda p: _joined(p, whole, record))

    return let(F.try_variant_get(x, "$", "map<string,variant>"), read)


# --- members from the text itself ---


def _by_text(record: RecordSpec) -> bool:
    return record.duplicates != "reject" or record.names == "fold" or holds_raw(record)


def _pick(raws: Column, kind: Any, record: RecordSpec) -> Column:
    """The text that counts among those of one name: the first, the last, or all merged."""
    if record.duplicates in ("reject", "first"):
        return F.get(raws, F.lit(0))
    last = F.try_element_at(raws, F.lit(-1))
    if record.duplicates == "last" or not isinstance(kind, (RecordSpec, MapOf, ListOf)):
        return F.when(F.size(raws) > 0, last)
    inner = lambda r: F.regexp_replace(r, r"^[{\[][ \t\r\n]*|[ \t\r\n]*[}\]]$", "")
    if isinstance(kind, ListOf):
        # by position: a later list replaces, or merges, what an earlier one has there and keeps the rest
        held = F.transform(raws, lambda r: _elements(r, kind))
        both = (lambda a, b: F.concat(F.lit("{"), F.array_join(F.filter(F.array(inner(a), inner(b)), lambda x: x != ""), ","), F.lit("}"))) if isinstance(kind.element, (RecordSpec, MapOf)) else (lambda a, b: b)
        zipped = F.aggregate(held, F.array().cast("array<string>"), lambda acc, r: F.zip_with(acc, r, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both(a, b))))
        return F.when(F.size(raws) < 2, last).when(F.exists(raws, lambda r: ~F.startswith(r, F.lit("["))), last).otherwise(F.concat(F.lit("["), F.array_join(zipped, ","), F.lit("]")))
    merged = F.concat(F.lit("{"), F.array_join(F.filter(F.transform(raws, inner), lambda x: x != ""), ","), F.lit("}"))
    return F.when(F.size(raws) < 2, last).when(F.exists(raws, lambda r: ~F.startswith(r, F.lit("{"))), last).otherwise(merged)


def _text_object(text: Column, record: RecordSpec) -> Column:
    """struct<value, _error> of a text that must be an object, valid JSON already."""

    def read(m: Column) -> Column:
        names = F.transform(m, lambda e: e["name"])

        def raw_of(f: FieldSpec) -> Column:
            mine = F.transform(F.filter(m, lambda e: e["name"].isin(*_names(record, f))), lambda e: e["raw"])
            return let(mine, lambda raws: _pick(raws, f.kind, record))

        def field(f: FieldSpec) -> Column:
            # whatever is no scalar is read from its text, so only scalars are parsed here
            scalar = isinstance(f.kind, (str, TupleOf)) and f.kind != "raw"
            x = lambda r: F.try_parse_json(r if scalar else F.when(r == "null", r).when(r.isNotNull(), F.lit("0")))
            return let(raw_of(f), lambda r: let(x(r), lambda v: _field(v, r, f, record)))

        fields = F.struct(*[field(f).alias(f.field) for f in record.fields])
        checks = [F.when(m.isNull(), error("UnexpectedType"))]
        if record.duplicates == "reject":
            checks.append(F.when(F.size(names) != F.size(F.array_distinct(names)), error("DuplicateField")))
        whole = F.coalesce(*checks, *_whole(names, record), F.lit(None).cast(ERROR))
        return let(fields, lambda p: _joined(p, whole, record))

    held = F.when(F.regexp_like(text, F.lit(r"^[ \t\r\n]*\{")), split_members(text))
    if record.names == "fold":
        known = [n for f in record.fields for n in _names(record, f)]
        spelled = F.create_map(*[F.lit(x) for n in reversed(known) for x in (n.lower(), n)]) if len({n.lower() for n in known}) == len(known) else F.create_map(*[F.lit(x) for n in {k.lower(): k for k in reversed(known)}.items() for x in n])
        held = F.transform(held, lambda e: F.struct(F.when(e["name"].isin(*known), e["name"]).otherwise(F.coalesce(F.try_element_at(spelled, F.lower(e["name"])), e["name"])).alias("name"), e["raw"].alias("raw")))
    return let(held, read)


#: Kinds that Spark's own parser reads exactly or not at all; what it reads otherwise is judged by its variant.
_OWN = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "boolean": "boolean"}
_PLAIN = {*_OWN, "string", "double", "float", "u64"}


def _simple(f: FieldSpec) -> bool:
    return not f.aliases and f.decode is None and f.constant is MISSING and not callable(f.default) and not isinstance(f.default, (list, tuple))


def _is_plain(f: FieldSpec) -> bool:
    return isinstance(f.kind, str) and f.kind in _PLAIN and _simple(f)


def _quick(record: RecordSpec) -> bool:
    return not _by_text(record) and record.unicode == "reject" and all(map(_is_plain, record.fields))


def _own_type(f: FieldSpec) -> str:
    return "variant" if f.nullable or f.kind not in _OWN else _OWN[f.kind]


def _quick_row(line: Column, record: RecordSpec) -> Column:
    """struct of what one pass of Spark's parser gives for a flat record, and the names of its members."""
    schema = ",".join(f"`{record.wire_name(f)}`:{_own_type(f)}" for f in record.fields)
    held = F.from_json(F.concat(F.lit("["), line, F.lit(",{}]")), f"array<struct<{schema}>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    row = let(held, lambda h: F.when(F.size(h) == 2, F.get(h, F.lit(0))))
    return F.struct(row.alias("row"), F.json_object_keys(line).alias("names"))


def _within(f: FieldSpec, value: Column, right: Column, empty: Column) -> Column:
    """Whether a value is right and within its field's limits, or its member rightly empty."""
    checks = [value.isNotNull()]
    if isinstance(f.kind, str) and f.kind.startswith("u"):
        checks.append(value.between(0, INTEGERS[f.kind][1] if f.kind != "u64" else 2**63 - 1))
    if f.minimum is not None:
        checks.append(value >= F.lit(f.minimum))
    if f.maximum is not None:
        checks.append(value <= F.lit(f.maximum))
    if f.max_len is not None:
        checks.append(F.octet_length(value) <= f.max_len)
    if f.allowed is not None:
        checks.append(value.isin(*f.allowed))
    if f.validate is not None:
        checks.append(f.validate(value))
    fits = right
    for c in checks:
        fits = fits & c
    return empty | fits


def _or_default(f: FieldSpec, value: Column, absent: Column) -> Column:
    return F.when(absent, F.lit(f.default)).otherwise(value) if f.default is not MISSING else value


def _plain(f: FieldSpec, x: Column, absent: Column, variant: bool) -> tuple[Column, Column]:
    """A plain field's value, and whether it is right in every respect."""
    value, right, empty = x, x.isNotNull(), absent & F.lit(f.default is not MISSING)
    if variant:
        kind = F.schema_of_variant(x)
        value = F.try_variant_get(x, "$", f.spark_type)
        right = {"string": kind == "STRING", "boolean": kind == "BOOLEAN"}.get(f.kind, kind == "BIGINT" if f.kind in INTEGERS else kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")))
        if f.kind in ("double", "float"):
            right = right & (F.abs(value) < float("inf"))
        if f.nullable:
            empty = x.isNull()
    return _or_default(f, value, absent), _within(f, value, right, empty)


def _quick_values(s: Column, line: Column, record: RecordSpec) -> tuple[Column, Column]:
    """The record of a line that is right in every respect, and whether it is; all other lines are for the whole judgement."""
    row, names = s["row"], s["names"]
    good = [row.isNotNull(), F.size(names) == F.size(F.array_distinct(names)), ~F.contains(line, F.lit("\\u"))]
    if record.unknown_fields == "reject":
        good.append(F.size(F.array_except(names, F.array(*[F.lit(n) for n in record.wire_names()]))) == 0)
    else:
        good.append(F.try_parse_json(line).isNotNull())
    values = []
    for f in record.fields:
        wire = record.wire_name(f)
        x, absent = row[wire], ~F.array_contains(names, wire)
        if f.skip_decode:
            values.append(F.lit(f.default).cast(f.spark_type).alias(f.field))
            continue
        value, fits = _plain(f, x, absent, _own_type(f) == "variant")
        good.append(fits)
        values.append(value.cast(f.spark_type).alias(f.field))
    whole = good[0]
    for g in good[1:]:
        whole = whole & g
    return F.struct(*values), F.coalesce(whole, F.lit(False))


#: Elements of lists that one look into a variant reads exactly or not at all, and what the variant calls such a list.
_LISTED = {"tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}


def _quick_text(record: RecordSpec) -> bool:
    """Whether lines of a record that is read from the text may be read by one pass of Spark's parser all the same."""
    fold = record.names == "fold"

    def near(f: FieldSpec) -> bool:
        if fold or f.skip_decode or _is_plain(f):
            return _is_plain(f)
        flat = isinstance(f.kind, RecordSpec) and all(map(_is_plain, f.kind.fields)) or isinstance(f.kind, ListOf) and f.kind.element in _LISTED and f.kind.max_items is None
        return _simple(f) and (f.kind == "raw" or flat and (f.default is MISSING or f.default is None))

    names = [n.lower() for n in record.wire_names()]
    return _by_text(record) and all(map(near, record.fields)) and not (fold and len({*names}) < len(names))


def _text_row(line: Column, record: RecordSpec) -> Column:
    """struct of the names, folded if the record folds, and variants of all members in order, repeated ones too.

    Null for lines that are for the whole judgement: with escapes, deep brackets, members
    repeated further in, names beyond ASCII where they fold, and all that are not one object.
    """
    near = F.regexp_like(line, F.lit(NESTED)) & ~F.contains(line, F.lit("\\"))
    if record.names == "fold":
        near = near & (F.octet_length(line) == F.char_length(line))
    held = F.from_json(F.concat(F.lit("["), line, F.lit(",{}]")), "array<map<string,variant>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})

    def taken(h: Column) -> Column:
        m = F.get(h, F.lit(0))
        names = F.map_keys(m)
        if record.names == "fold":  # no name holds a control character, as there are no escapes
            names = F.split(F.lower(F.array_join(names, "\x01")), "\x01")
        return F.when(F.size(h) == 2, F.struct(names.alias("names"), F.map_values(m).alias("members")))

    return let(F.when(near, held), taken)


def _found(s: Column, wire: str, record: RecordSpec) -> list[Column]:
    """The members of a name that count, the strongest first."""
    at = F.array_position(s["names"], wire) - 1
    first = F.get(s["members"], at.cast("int"))
    if record.duplicates in ("reject", "first"):
        return [first]
    back = F.size(s["names"]) - F.array_position(F.reverse(s["names"]), wire)
    last = F.get(s["members"], back.cast("int"))
    return [last, first] if record.duplicates == "merge" else [last]


def _nested_part(s: Column, f: FieldSpec, record: RecordSpec) -> Column:
    """struct<value, right> of a record of plain fields or a list of scalars."""
    found = _found(s, record.wire_name(f), record)
    if isinstance(f.kind, ListOf):
        kind = f"ARRAY<{_LISTED[f.kind.element]}>"
        looked = F.struct(*[F.try_variant_get(x, "$", f.spark_type).alias(f"_{i}") for i, x in enumerate(found)])

        def items(p: Column) -> Column:
            value, right = p["_0"], F.lit(True)
            if len(found) > 1:  # by position: the later list replaces what the earlier one has there and keeps the rest
                value = F.concat(value, F.slice(p["_1"], F.size(value) + 1, F.greatest(F.size(p["_1"]), F.lit(1))))
            for i, x in enumerate(found):
                right = right & (F.schema_of_variant(x) == kind) & ~F.exists(p[f"_{i}"], lambda e: e.isNull())
            return F.struct(value.alias("value"), right.alias("right"))

        return let(looked, items)
    inner = f.kind
    looked = F.struct(*[F.try_variant_get(x, "$", "map<string,variant>").alias(f"_{i}") for i, x in enumerate(found)])

    def fields(p: Column) -> Column:
        held = [p[f"_{i}"] for i in range(len(found))]
        right = F.lit(True)
        for m in held:
            right = right & m.isNotNull()
            if record.unknown_fields == "reject":
                right = right & (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, inner.wire_names())))) == 0)
        values = []
        for g in inner.fields:
            wire = inner.wire_name(g)
            if g.skip_decode:
                values.append(F.lit(g.default).cast(g.spark_type).alias(g.field))
                continue
            x, absent = F.try_element_at(held[-1], F.lit(wire)), ~F.array_contains(F.map_keys(held[-1]), wire)
            if len(held) > 1:
                later = F.array_contains(F.map_keys(held[0]), wire)
                x, absent = F.when(later, F.try_element_at(held[0], F.lit(wire))).otherwise(x), ~later & absent
            value, fits = _plain(g, x, absent, True)
            right = right & fits
            values.append(value.cast(g.spark_type).alias(g.field))
        return F.struct(F.struct(*values).alias("value"), right.alias("right"))

    return let(looked, fields)


def _text_values(s: Column, nested: Column, line: Column, record: RecordSpec) -> tuple[Column, Column]:
    """The record of a line that is right in every respect, and whether it is, from ``_text_row``."""
    names = s["names"]
    fold = (lambda n: n.lower()) if record.names == "fold" else (lambda n: n)
    times = lambda wire: F.size(names) - F.size(F.array_remove(names, wire))
    whole, values = names.isNotNull(), []
    if record.duplicates == "reject":
        whole = whole & (F.size(names) == F.size(F.array_distinct(names)))
    if record.unknown_fields == "reject":
        whole = whole & (F.size(F.array_except(names, F.array(*[F.lit(fold(n)) for n in record.wire_names()]))) == 0)
    for f in record.fields:
        wire = fold(record.wire_name(f))
        if f.skip_decode:
            values.append(F.lit(f.default).cast(f.spark_type).alias(f.field))
            continue
        absent = ~F.array_contains(names, wire)
        empty = absent & F.lit(f.default is not MISSING or f.nullable)
        if f.kind == "raw":
            raw = F.btrim(F.regexp_extract(line, first_of(wire), 1), F.lit(" \t\r\n"))
            value, fits = F.when(absent, F.lit(None if f.default is MISSING else f.default)).otherwise(raw), _within(f, raw, (times(wire) == 1) & (raw != ""), empty)
        elif isinstance(f.kind, str):
            value, fits = _plain(f, _found(s, wire, record)[0], absent, True)
        else:
            part = nested[f.field]
            value, fits = F.when(~absent, part["value"]), _within(f, part["value"], part["right"] & (times(wire) <= 2), empty)
        whole = whole & fits
        values.append(value.cast(f.spark_type).alias(f.field))
    return F.struct(*values), F.coalesce(whole, F.lit(False))


def parse_json_record(line: Column, record: RecordSpec) -> Column:
    """struct<value, _error> of a line read as the record.

    A record of plain fields, under policies that read the text of plain records, lists
    and raw members too, is read by one pass of Spark's parser; lines that it does not
    find right in every respect get the whole judgement.
    """
    if _quick_text(record):
        return let(F.struct(line.alias("line"), _text_row(line, record).alias("row")), lambda s: _text_read(s, record))
    if not _quick(record):
        return judge_json_record(line, record)
    return let(F.struct(line.alias("line"), _quick_row(line, record).alias("quick")), lambda s: _chosen(*_quick_values(s["quick"], s["line"], record), s["line"], record))


def _text_read(s: Column, record: RecordSpec) -> Column:
    row = s["row"]
    parts = [_nested_part(row, f, record).alias(f.field) for f in record.fields if not f.skip_decode and not isinstance(f.kind, str)]
    return let(F.struct(*(parts or [F.lit(0).alias("none")])), lambda n: _chosen(*_text_values(row, n, s["line"], record), s["line"], record))


def _chosen(values: Column, good: Column, line: Column, record: RecordSpec) -> Column:
    return F.when(good, F.struct(values.alias("value"), F.lit(None).cast(ERROR).alias("_error"))).otherwise(judge_json_record(line, record))


def judge_json_record(line: Column, record: RecordSpec) -> Column:
    """struct<value, _error> of a line under any policy, with the reason for a refusal."""
    return let(line, lambda text: _judged(text, record))


def _judged(line: Column, record: RecordSpec) -> Column:
    lone = F.contains(line, F.lit("\\u")) & F.regexp_like(line, F.lit(_LONE))
    clean = F.when(lone, F.regexp_replace(line, _LONE, r"$1\\ufffd")).otherwise(line) if record.unicode == "replace" else line
    refused = F.when(lone, error("InvalidUtf8")) if record.unicode == "reject" else F.lit(None).cast(ERROR)
    other = F.regexp_like(line, F.lit(r"^[ \t\r\n]*[\[\"0-9tfn-]"))
    syntax = F.when(other, error("UnexpectedType")).otherwise(error("SyntaxError"))
    fail = lambda e: F.struct(F.lit(None).cast(type_of(record)).alias("value"), e.cast(ERROR).alias("_error"))

    def judged(s: Column) -> Column:
        """The text as one JSON object, or what is wrong with it."""
        line, bad = s["line"], s["bad"]
        if _by_text(record):
            good = valid_object(line)
            if record.duplicates == "reject":
                # only a line with repeated members, if any, fails here
                bad = F.coalesce(bad, F.when(good & F.try_parse_json(line).isNull(), error("DuplicateField")))
            return F.when(bad.isNotNull(), fail(bad)).when(good, _text_object(line, record)).otherwise(fail(syntax))
        # one value alone: what follows it would be more than the 0 that is set behind it
        held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]"))), "$", "array<variant>")
        doubled = F.when(valid_object(line), error("DuplicateField")).otherwise(syntax)
        return F.when(bad.isNotNull(), fail(bad)).otherwise(let(held, lambda h: F.when(F.size(h) == 2, _object(F.get(h, F.lit(0)), record)).otherwise(fail(doubled))))

    return let(F.struct(clean.alias("line"), refused.alias("bad")), judged)


def parse_json_union(line: Column, union: UnionSpec) -> Column:
    """struct<_tag, one nullable struct an arm, _other (raw), _error> of a line read as a tagged union."""
    return let(F.struct(line.alias("line"), tag_of(line, union).alias("tag")), lambda s: _union(s["line"], s["tag"], union))


def _member_text(line: Column, name: str, record: RecordSpec) -> Column:
    """A member's text: as it is written where the record keeps texts or repeated members, else as Spark writes it."""
    return raw_member(line, name) if _by_text(record) else F.get_json_object(line, path_of(name))


def _union(line: Column, tag: Column, union: UnionSpec) -> Column:
    arms, wrong = [], F.when(tag.isNull(), error("UnknownVariant"))
    if union.tag is None:  # the arm is the only member
        wrong = F.coalesce(F.when(F.size(F.json_object_keys(line)) > 1, error("UnknownField")), wrong)
    wrong = F.coalesce(F.when(~valid_object(line), error("SyntaxError")), wrong)
    payloads = []
    for arm, record in union.arms.items():
        wires = [arm, *[w for w, to in union.aliases.items() if to == arm]]
        if union.tag is None:
            payload = F.coalesce(*[_member_text(line, w, record) for w in wires])
            spec = record
        elif union.content:
            payload, spec = _member_text(line, union.content, record), record
        else:  # the tag lies among the fields
            payload = line
            spec = replace(record, fields=(*record.fields, FieldSpec("__tag", name=union.tag)))
        payloads.append(F.when(tag == arm, parse_json_record(payload, spec)).alias(arm))
    other = F.when(tag == "other", line) if union.other else F.lit(None).cast("string")

    def result(parsed: Column) -> Column:
        bad = wrong
        for arm in union.arms:
            value = parsed[arm]["value"]
            arms.append((value.dropFields("__tag") if union.tag and not union.content else value).alias(arm))
            bad = F.coalesce(wrong, F.when(tag == arm, parsed[arm]["_error"]), bad)
        return F.struct(tag.alias("_tag"), *arms, other.alias("_other"), bad.alias("_error"))

    return let(F.struct(*payloads), result)


def json_value(c: Column, kind: Any) -> Column:
    """JSON text of a value of a kind; null is written null, raw text as it stands; a number that is none fails the job."""
    if isinstance(kind, RecordSpec):
        made = write_json_record(kind, lambda n: c[n])
    elif isinstance(kind, ListOf):
        made = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_value(x, kind.element)), ","), F.lit("]"))
    elif isinstance(kind, MapOf):
        pair = lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_value(e["value"], kind.value))
        made = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))
    elif isinstance(kind, TupleOf):
        made = F.concat(F.lit("["), F.concat_ws(",", *[json_value(c[f"_{i}"], k) for i, k in enumerate(kind.kinds)]), F.lit("]"))
    elif kind == "raw":
        made = c
    elif kind == "timestamp":
        made = F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"'))
    elif kind == "binary":
        made = F.concat(F.lit('"'), F.base64(c), F.lit('"'))
    elif kind in ("string", "date"):
        made = json_string(c.cast("string"))
    elif kind in ("float", "double"):
        finite = F.abs(c) < float("inf")
        made = F.when(finite & ~F.isnan(c), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")).otherwise(F.raise_error(F.lit("UnsupportedValue")).cast("string"))
    else:
        made = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(made)


def write_json_record(record: RecordSpec, column: Callable[[str], Column] = F.col) -> Column:
    """The record's fields as a JSON object under the record's names and omission rules."""
    kept = [f for f in record.fields if not f.skip_encode]
    plain = all(f.omit == "never" and f.omit_if is None and f.encode is None and isinstance(f.kind, str) and f.kind not in ("raw", "timestamp", "binary") for f in kept)
    if plain:
        return F.to_json(F.struct(*[column(f.field).alias(record.wire_name(f)) for f in kept]), {"ignoreNullFields": "false"})
    parts = []
    for f in kept:
        own, name = column(f.field), record.wire_name(f)
        c = f.encode(own) if f.encode else own
        body = F.concat(json_string(F.lit(name)), F.lit(":"), json_value(c, f.kind))
        if f.omit_if is not None:
            body = F.when(~F.coalesce(f.omit_if(own), F.lit(False)), body)
        if f.omit == "null_value":
            body = F.when(c.isNotNull(), body)
        elif f.omit == "default_value":
            body = F.when(~c.eqNullSafe(F.lit(f.default)), body)
        parts.append(body)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def split_refused(parsed: DataFrame, column: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Accepted rows with the record's fields, and refused rows with their error."""
    good = parsed.where(F.col(f"{column}._error").isNull()).select(*[c for c in parsed.columns if c != column], f"{column}.value.*")
    bad = parsed.where(F.col(f"{column}._error").isNotNull()).withColumn("_error", F.col(f"{column}._error")).drop(column)
    return good, bad


def parse_versioned(
    line: Column, current: int, record: RecordSpec, migrations: dict[int, tuple[RecordSpec, Callable[[Column], Column]]], unstamped: int = 0
) -> Column:
    """struct<value, from_version, migrated, _error> of ``{"v":N,"data":...}`` lines.

    A migration maps an older version's record (a struct column) to the current one's fields.
    """
    keys = F.json_object_keys(line)
    # one object and nothing behind it, with the version as a number
    held = F.from_json(F.concat(F.lit("["), line, F.lit(",{}]")), "array<struct<v:variant>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    stamp = let(held, lambda h: F.when(F.size(h) == 2, F.get(h, F.lit(0))["v"]))
    stamp = let(stamp, lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")))
    version = F.coalesce(stamp, F.when(~F.array_contains(keys, "v"), F.lit(unstamped).cast("bigint")))
    source = F.struct(F.when(F.size(held) == 2, keys).alias("keys"), version.alias("version"), _member_text(line, "data", record).alias("data"))
    shape = "struct<" + ",".join(f"`{f.field}`:{f.spark_type}" for f in record.fields) + ">"

    def read(s: Column) -> Column:
        """struct<v<version>: struct<value, _error>> of the version that the line has."""
        arms = [F.when(s["version"] == current, parse_json_record(s["data"], record)).alias("now")]
        arms += [F.when(s["version"] == old, parse_json_record(s["data"], spec)).alias(f"v{old}") for old, (spec, _) in migrations.items()]
        return let(F.struct(*arms), lambda p: judge(s, p))

    def judge(s: Column, p: Column) -> Column:
        keys, version = s["keys"], s["version"]
        value, wrong = p["now"]["value"], p["now"]["_error"]
        for old, (_, migrate) in migrations.items():
            mine = p[f"v{old}"]
            value = F.when((version == old) & mine["_error"].isNull(), migrate(mine["value"]).cast(shape)).otherwise(value)
            wrong = F.when(version == old, mine["_error"]).otherwise(wrong)
        stray = F.array_except(keys, F.array(F.lit("v"), F.lit("data")))
        bad = F.coalesce(
            F.when(keys.isNull(), error("SyntaxError")),
            F.when(F.size(keys) != F.size(F.array_distinct(keys)), error("DuplicateField")),
            F.when(F.size(stray) > 0, error("UnknownField")),
            F.when(~F.array_contains(keys, "data"), error("MissingField", "data")),
            F.when(version.isNull(), error("UnexpectedType", "v")),
            F.when(~version.isin(current, *migrations), error("UnknownVariant", "v")),
            wrong,
        )
        return let(bad, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), version.alias("from_version"), (version != current).alias("migrated"), e.alias("_error")))

    return let(source, read)


def write_versioned(current: int, record: RecordSpec, column: Callable[[str], Column] = F.col) -> Column:
    """A line of the current version, whatever version it was read from."""
    return F.concat(F.lit(f'{{"v":{current},"data":'), write_json_record(record, column), F.lit("}"))
