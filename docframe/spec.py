"""Declared record shapes: names, aliases, defaults, ranges, unions, and what a reading accepts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from docframe.errors import SpecError

INTEGERS = {
    "tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1),
    "u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1),
}
#: Kinds that are read from JSON text: RFC 3339 times with an offset, days, and base64.
TEXT_KINDS = {"timestamp", "date", "binary"}
SPARK_TYPE = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)"}
KINDS = {*INTEGERS, *TEXT_KINDS, "string", "boolean", "float", "double", "raw"}
_DECIMAL = re.compile(r"decimal\(\d+,\d+\)")
MISSING = object()


@dataclass(frozen=True)
class ListOf:
    """An array of one kind; ``max_items`` bounds it."""

    element: Any
    nullable: bool = False
    max_items: int | None = None


@dataclass(frozen=True)
class MapOf:
    """An object of any names whose values are of one kind."""

    value: Any
    nullable: bool = False


@dataclass(frozen=True)
class TupleOf:
    """An array of a fixed length, each place with a kind of its own; a struct of _0, _1 and so on."""

    kinds: tuple


def known_kind(kind: Any) -> bool:
    if isinstance(kind, ListOf):
        return known_kind(kind.element)
    if isinstance(kind, MapOf):
        return known_kind(kind.value)
    if isinstance(kind, TupleOf):
        return all(map(known_kind, kind.kinds))
    return isinstance(kind, RecordSpec) or kind in KINDS or bool(_DECIMAL.fullmatch(str(kind)))


def type_of(kind: Any) -> str:
    """The Spark type of a kind."""
    if isinstance(kind, ListOf):
        return f"array<{type_of(kind.element)}>"
    if isinstance(kind, MapOf):
        return f"map<string,{type_of(kind.value)}>"
    if isinstance(kind, TupleOf):
        return "struct<" + ",".join(f"_{i}:{type_of(k)}" for i, k in enumerate(kind.kinds)) + ">"
    if isinstance(kind, RecordSpec):
        return "struct<" + ",".join(f"`{f.field}`:{f.spark_type}" for f in kind.fields) + ">"
    return SPARK_TYPE.get(kind, "string" if kind == "raw" else kind)


def holds_raw(kind: Any) -> bool:
    """Whether a kind keeps JSON text as it is written, somewhere inside records."""
    return kind == "raw" or isinstance(kind, RecordSpec) and any(holds_raw(f.kind) for f in kind.fields)


def rename(name: str, rule: str) -> str:
    """A snake_case name under a casing rule."""
    parts = name.split("_")
    if rule == "snake":
        return name
    if rule == "camel":
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    if rule == "pascal":
        return "".join(p.capitalize() for p in parts)
    if rule == "kebab":
        return "-".join(parts)
    if rule == "screaming_snake":
        return name.upper()
    raise SpecError(f"no casing rule {rule}")


@dataclass(frozen=True)
class FieldSpec:
    """One field. ``kind`` is a Spark type name, u8 to u64, raw (checked JSON text kept as it is), a record, list, map or tuple.

    ``default`` is a constant or a function that makes a column. ``constant`` is what
    the member must be. ``decode`` makes the value from what was read as ``kind``
    (null refuses it with ``code``), ``encode`` is its reverse for writing, and
    ``decoded`` the Spark type in between. ``validate`` refuses with ``code`` too.
    """

    field: str
    kind: Any = "string"
    name: str | None = None
    aliases: tuple[str, ...] = ()
    nullable: bool = False
    default: Any = MISSING
    minimum: Any = None
    maximum: Any = None
    max_len: int | None = None
    allowed: tuple[str, ...] | None = None
    validate: Callable[[Column], Column] | None = None
    omit: str = "never"  # never, null_value, default_value
    skip_encode: bool = False
    skip_decode: bool = False
    description: str | None = None
    constant: Any = MISSING
    decode: Callable[[Column], Column] | None = None
    encode: Callable[[Column], Column] | None = None
    decoded: str | None = None
    omit_if: Callable[[Column], Column] | None = None
    code: str = "CustomRejected"

    @property
    def spark_type(self) -> str:
        return self.decoded or type_of(self.kind)


@dataclass(frozen=True)
class RecordSpec:
    """A record, and the policy of reading and writing it; the policy of the outermost record holds for nested ones.

    ``names`` folds cases (ASCII and what lower-casing maps) only where no name fits
    exactly. ``nulls`` keeps a default where a null stands for a field without nulls.
    ``integers`` takes whole numbers however written, or digits alone.
    ``unicode`` refuses lone surrogates or reads them as U+FFFD.
    """

    fields: tuple[FieldSpec, ...]
    unknown_fields: str = "reject"  # reject, ignore
    duplicates: str = "reject"  # reject, first, last, merge
    rename_all: str | None = None
    description: str | None = None
    names: str = "exact"  # exact, fold
    nulls: str = "reject"  # reject, keep
    integers: str = "whole"  # whole, digits
    unicode: str = "reject"  # reject, replace
    _names: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        seen: set[str] = set()
        for name, known in POLICIES.items():
            if getattr(self, name) not in known:
                raise SpecError(f"{name} has no policy {getattr(self, name)}")
        for f in self.fields:
            if not known_kind(f.kind):
                raise SpecError(f"{f.field}: no type {f.kind}")
            if f.omit == "null_value" and not f.nullable:
                raise SpecError(f"{f.field}: omitting null needs a nullable field")
            if f.omit == "default_value" and f.default is MISSING:
                raise SpecError(f"{f.field}: omitting the default needs one")
            if f.decode and not f.decoded:
                raise SpecError(f"{f.field}: what is decoded needs a type")
            if f.skip_decode and f.default is MISSING:
                raise SpecError(f"{f.field}: a field that is not read needs a default")
            if f.minimum is not None and f.maximum is not None and f.minimum > f.maximum:
                raise SpecError(f"{f.field}: the range is unordered")
            for n in (self.wire_name(f), *f.aliases):
                if n in seen:
                    raise SpecError(f"{f.field}: the name {n} is taken")
                seen.add(n)

    def wire_name(self, f: FieldSpec) -> str:
        return f.name or (rename(f.field, self.rename_all) if self.rename_all else f.field)

    def wire_names(self) -> list[str]:
        return [self.wire_name(f) for f in self.fields]

    def describe(self, fmt: str) -> list[str]:
        """What a format cannot hold of this record; empty if all."""
        caps = CAPABILITIES[fmt]
        out = []
        for f in self.fields:
            if f.nullable and not caps["null"] and f.omit != "null_value":
                out.append(f"{f.field}: {fmt} has no null")
            if isinstance(f.kind, str) and f.kind in INTEGERS and caps["bits"] and INTEGERS[f.kind][1] >= 2 ** caps["bits"]:
                out.append(f"{f.field}: {fmt} holds integers of {caps['bits']} bits")
        return out


#: The policies of reading, the strictest first.
POLICIES = {
    "unknown_fields": ("reject", "ignore"), "duplicates": ("reject", "first", "last", "merge"), "names": ("exact", "fold"),
    "nulls": ("reject", "keep"), "integers": ("whole", "digits"), "unicode": ("reject", "replace"),
}
#: The lenient profile: what a reader of another well-known library accepts.
LENIENT = {"unknown_fields": "ignore", "duplicates": "merge", "names": "fold", "nulls": "keep", "integers": "digits", "unicode": "replace"}

#: What formats can hold; bits None is unbounded.
CAPABILITIES = {
    "json": {"null": True, "non_finite": False, "bits": None},
    "json5": {"null": True, "non_finite": True, "bits": None},
    "csv": {"null": True, "non_finite": False, "bits": None},
    "cbor": {"null": True, "non_finite": True, "bits": 64},
    "msgpack": {"null": True, "non_finite": True, "bits": 64},
    "toml": {"null": False, "non_finite": True, "bits": 63},
    "yaml": {"null": True, "non_finite": True, "bits": 128},
    "xml": {"null": False, "non_finite": True, "bits": 128},
    "ini": {"null": True, "non_finite": False, "bits": None},
    "dotenv": {"null": True, "non_finite": False, "bits": None},
    "urlencoded": {"null": False, "non_finite": False, "bits": None},
}


@dataclass(frozen=True)
class UnionSpec:
    """A tagged union: each arm's record by its name; ``tag`` None is external tagging ({"arm": payload})."""

    arms: dict[str, RecordSpec]
    tag: str | None = None
    content: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    other: bool = False

    def __post_init__(self):
        if self.content and not self.tag:
            raise SpecError("content needs a tag")
        if any(to not in self.arms for to in self.aliases.values()):
            raise SpecError("an alias names no arm")
        if self.tag:
            for arm, record in self.arms.items():
                if not self.content and self.tag in record.wire_names():
                    raise SpecError(f"{arm}: a field has the tag's name")


def json_schema(record: RecordSpec, direction: str = "decode") -> dict:
    """A JSON Schema (2020-12) of the record as it is read or written; a record used more than once stands under $defs."""
    used: dict[int, list] = {}

    def count(kind: Any) -> None:
        for k in (kind.fields if isinstance(kind, RecordSpec) else ()):
            count(k.kind)
        if isinstance(kind, RecordSpec):
            used.setdefault(id(kind), [kind, 0])[1] += 1
        elif isinstance(kind, (ListOf, MapOf)):
            count(kind.element if isinstance(kind, ListOf) else kind.value)
        elif isinstance(kind, TupleOf):
            for k in kind.kinds:
                count(k)

    for f in record.fields:
        count(f.kind)
    names = {key: f"record{i}" for i, (key, (_, n)) in enumerate(used.items()) if n > 1}
    out = {"$schema": "https://json-schema.org/draft/2020-12/schema"} | _schema_of_record(record, direction, names)
    if names:
        out["$defs"] = {name: _schema_of_record(used[key][0], direction, names) for key, name in names.items()}
    return out


def _schema_of_kind(kind: Any, direction: str, names: dict[int, str]) -> dict:
    nested = lambda k, null: {"anyOf": [_schema_of_kind(k, direction, names), {"type": "null"}]} if null else _schema_of_kind(k, direction, names)
    if isinstance(kind, RecordSpec):
        return {"$ref": f"#/$defs/{names[id(kind)]}"} if id(kind) in names else _schema_of_record(kind, direction, names)
    if isinstance(kind, ListOf):
        return {"type": "array", "items": nested(kind.element, kind.nullable)} | ({"maxItems": kind.max_items} if kind.max_items is not None else {})
    if isinstance(kind, MapOf):
        return {"type": "object", "additionalProperties": nested(kind.value, kind.nullable)}
    if isinstance(kind, TupleOf):
        return {"type": "array", "prefixItems": [nested(k, False) for k in kind.kinds], "items": False, "minItems": len(kind.kinds)}
    if kind in INTEGERS:
        return {"type": "integer", "minimum": INTEGERS[kind][0], "maximum": INTEGERS[kind][1]}
    if kind in ("float", "double") or kind.startswith("decimal"):
        return {"type": "number"}
    if kind == "boolean":
        return {"type": "boolean"}
    if kind == "raw":
        return {}
    return {"type": "string"} | ({"format": {"timestamp": "date-time", "date": "date"}[kind]} if kind in ("timestamp", "date") else {}) | ({"contentEncoding": "base64"} if kind == "binary" else {})


def _schema_of_record(record: RecordSpec, direction: str, names: dict[int, str]) -> dict:
    decode = direction == "decode"
    properties: dict[str, dict] = {}
    required, alternatives = [], []
    for f in record.fields:
        if (f.skip_decode and decode) or (f.skip_encode and not decode):
            continue
        s = _schema_of_kind(f.kind, direction, names)
        if f.minimum is not None:
            s = s | {"minimum": f.minimum}
        if f.maximum is not None:
            s = s | {"maximum": f.maximum}
        if f.max_len is not None:
            s = s | {"maxLength": f.max_len}
        if f.allowed:
            s = s | {"enum": list(f.allowed)}
        if f.constant is not MISSING:
            s = {"const": f.constant}
        if f.nullable and s:
            s = s | {"type": [s["type"], "null"]} if isinstance(s.get("type"), str) and "enum" not in s else {"anyOf": [s, {"type": "null"}]}
        if f.description:
            s = s | {"description": f.description}
        name = record.wire_name(f)
        for n in (name, *(f.aliases if decode else ())):
            properties[n] = s
        if decode and f.default is MISSING and not f.nullable:
            if f.aliases:
                alternatives.append({"anyOf": [{"required": [n]} for n in (name, *f.aliases)]})
            else:
                required.append(name)
        elif not decode and f.omit == "never":
            required.append(name)
    out: dict[str, Any] = {"type": "object", "properties": properties}
    if required:
        out["required"] = required
    if alternatives:
        out["allOf"] = alternatives
    if not decode or record.unknown_fields == "reject":
        out["additionalProperties"] = False
    if record.description:
        out["description"] = record.description
    return out
