"""CBOR and MessagePack of flat records: written by expressions, read by a small Arrow function."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def _bytes(value: Column, n: int) -> Column:
    """A non-negative integer as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def _head(major: int, n: Column) -> Column:
    """A CBOR head in its shortest form."""
    m = major << 5
    head = lambda low, size: F.concat(F.unhex(F.lit(f"{m | low:02X}")), _bytes(n, size))
    return F.when(n < 24, _bytes(n + m, 1)).when(n < 1 << 8, head(24, 1)).when(n < 1 << 16, head(25, 2)).when(n < 1 << 32, head(26, 4)).otherwise(head(27, 8))


def cbor_int(c: Column) -> Column:
    return F.when(c >= 0, _head(0, c)).otherwise(_head(1, -1 - c))


def cbor_text(c: Column) -> Column:
    return F.concat(_head(3, F.octet_length(c)), c.cast("binary"))


def cbor_bool(c: Column) -> Column:
    return F.when(c, F.unhex(F.lit("F5"))).otherwise(F.unhex(F.lit("F4")))


CBOR_NULL = "F6"


def cbor_map(members: dict[str, tuple[Column, Column]]) -> Column:
    """A deterministic CBOR map: keys in the order of their encoded bytes; a member is (is null, encoded)."""
    order = sorted(members, key=lambda k: (_head_bytes(len(k.encode())) + k.encode()))
    parts = [_head(5, F.lit(len(order)))]
    for k in order:
        null, value = members[k]
        parts += [cbor_text(F.lit(k)), F.when(null, F.unhex(F.lit(CBOR_NULL))).otherwise(value)]
    return F.concat(*parts)


def _head_bytes(n: int) -> bytes:
    return bytes([0x60 | n]) if n < 24 else bytes([0x78, n]) if n < 256 else b"\x79" + n.to_bytes(2, "big")


def msgpack_int(c: Column) -> Column:
    """The smallest form of a 64-bit integer."""
    form = lambda code, v, n: F.concat(F.unhex(F.lit(code)), _bytes(v, n))
    return (
        F.when(c >= 0, F.when(c < 128, _bytes(c, 1)).when(c < 1 << 8, form("CC", c, 1)).when(c < 1 << 16, form("CD", c, 2)).when(c < 1 << 32, form("CE", c, 4)).otherwise(form("CF", c, 8)))
        .when(c >= -32, _bytes(c + 256, 1))
        .when(c >= -(1 << 7), form("D0", c + (1 << 8), 1))
        .when(c >= -(1 << 15), form("D1", c + (1 << 16), 2))
        .when(c >= -(1 << 31), form("D2", c + (1 << 32), 4))
        .otherwise(F.concat(F.unhex(F.lit("D3")), F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "F"))))
    )


def msgpack_text(c: Column) -> Column:
    n = F.octet_length(c)
    form = lambda code, size: F.concat(F.unhex(F.lit(code)), _bytes(n, size))
    head = F.when(n < 32, _bytes(n + 0xA0, 1)).when(n < 1 << 8, form("D9", 1)).when(n < 1 << 16, form("DA", 2)).otherwise(form("DB", 4))
    return F.concat(head, c.cast("binary"))


def _msgpack_map_head(n: int) -> str:
    """The smallest head of a map of n members, in hexadecimal digits."""
    return f"{0x80 | n:02X}" if n < 16 else f"DE{n:04X}" if n < 1 << 16 else f"DF{n:08X}"


def msgpack_map(members: dict[str, tuple[Column, Column]]) -> Column:
    """A MessagePack map with keys in byte order."""
    parts = [F.unhex(F.lit(_msgpack_map_head(len(members))))]
    for k in sorted(members, key=str.encode):
        null, value = members[k]
        parts += [msgpack_text(F.lit(k)), F.when(null, F.unhex(F.lit("C0"))).otherwise(value)]
    return F.concat(*parts)


def msgpack_timestamp(seconds: Column, nanos: Column) -> Column:
    """Extension -1 in its smallest form; null for nanoseconds over a second."""
    four = F.concat(F.unhex(F.lit("D6FF")), _bytes(seconds, 4))
    eight = F.concat(F.unhex(F.lit("D7FF")), _bytes(F.shiftleft(nanos.cast("bigint"), 34) + seconds, 8))
    twelve = F.concat(F.unhex(F.lit("C70CFF")), _bytes(nanos, 4), F.unhex(F.lpad(F.hex(seconds.cast("bigint")), 16, "0")))
    small = (seconds >= 0) & (seconds < 1 << 34)
    made = F.when((nanos == 0) & (seconds >= 0) & (seconds < 1 << 32), four).when(small, eight).otherwise(twelve)
    return F.when(nanos.between(0, 999_999_999), made)


def _read(data: bytes, at: int):
    """One flat CBOR item and where it ends: integers, text, booleans, null, maps of text keys."""
    major, low = data[at] >> 5, data[at] & 31
    if data[at] in (0xF4, 0xF5, 0xF6):
        return {0xF4: False, 0xF5: True, 0xF6: None}[data[at]], at + 1
    if data[at] == 0xFB:
        return struct.unpack_from(">d", data, at + 1)[0], at + 9
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(low, 0)
    if low > 27:
        raise ValueError("UnsupportedValue")
    n = int.from_bytes(data[at + 1 : at + 1 + size], "big") if size else low
    at += 1 + size
    if major == 0 or major == 1:
        return (n if major == 0 else -1 - n), at
    if major == 3:
        return data[at : at + n].decode(), at + n
    if major == 5:
        out = {}
        for _ in range(n):
            k, at = _read(data, at)
            if k in out:
                raise ValueError("DuplicateField")
            out[k], at = _read(data, at)
        return out, at
    raise ValueError("UnsupportedValue")


@F.pandas_udf(MapType(StringType(), StringType()))
def cbor_flat(data: pd.Series) -> pd.Series:
    """The members of a flat CBOR map as text; null for anything else."""

    def one(raw):
        try:
            value, end = _read(bytes(raw), 0)
        except (ValueError, IndexError, TypeError, UnicodeDecodeError):
            return None
        spell = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        return {k: spell(v) for k, v in value.items()} if end == len(raw) and isinstance(value, dict) else None

    return data.map(one, na_action="ignore")
