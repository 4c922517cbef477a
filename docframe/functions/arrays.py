"""Arrays and values inside one expression: a value bound once, and running folds of long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold goes over; folds copy what they carry, so a long array is folded in pieces.
FOLD = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prefix(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    kind = "struct<at:bigint,out:array<bigint>>"
    first = F.struct(start.alias("at"), F.array().alias("out")).cast(kind)
    return F.aggregate(values, first, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each long of an array ``op`` of all before it, 0 for the first; ``op`` is associative with 0 neutral.

    Pieces of ``FOLD`` elements are folded apart, from bases that a fold over whole pieces gives.
    """
    zero = F.lit(0).cast("bigint")

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / FOLD).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * FOLD + 1, F.lit(FOLD)))

    def run(pieces: Column) -> Column:
        bases = _prefix(F.transform(pieces, lambda p: F.aggregate(p, zero, lambda a, x: op(a, x))), zero, op)
        return let(bases, lambda b: F.flatten(F.transform(pieces, lambda p, k: _prefix(p, F.get(b, k), op))))

    return let(values, lambda v: F.when(F.size(v) > FOLD, let(cut(v), run)).otherwise(_prefix(v, zero, op)))


#: Characters of a piece of a text; a cut never reads the text from its start.
PIECE = 1024


def text_pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` characters, to cut from many times."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (characters, exclusive) out of its pieces."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(start >= end, "").otherwise(F.substr(held, (start % PIECE + 1).cast("int"), (end - start).cast("int")))
