"""Framing: lines of text columns and files, with number, offset and what is wrong with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.route import index_of_control

MARK = "﻿"
SEPARATOR = "\x1e"


@dataclass(frozen=True)
class Framing:
    """How lines are framed: CRLF trimmed, byte limit, and whether a record separator leads each record."""

    trim_cr: bool = True
    skip_blank: bool = True
    max_line_bytes: int = 1 << 20
    separator: bool = False
    control: str = "reject"  # reject, keep
    require_terminator: bool = False


def lines_of(text: Column) -> Column:
    """Array of line, number (from 1), offset (bytes) of the lines of a buffer; the last needs no line end."""
    parts = F.split(text, "\n")
    held = F.when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)
    ends = F.aggregate(
        held,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")),
        lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")),
        lambda a: a["starts"],
    )
    return F.transform(F.arrays_zip(held.alias("l"), ends.alias("o")), lambda x, i: F.struct(x["l"].alias("line"), (i + 1).cast("long").alias("number"), x["o"].alias("offset")))


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, number and offset (bytes) of every line of every text, in one pass without a growing array.

    Offsets are running sums over a text's own lines.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line"), F.endswith(F.col(text), F.lit("\n")).alias("ended"))
    order = Window.partitionBy(key).orderBy("p")
    rows = rows.withColumn("offset", F.sum(F.octet_length("line") + 1).over(order) - F.octet_length("line") - 1)
    last = (F.col("line") == "") & F.lead("p").over(order).isNull() & (F.col("ended") | (F.col("p") == 0))
    return rows.withColumn("last", last).where(~F.col("last")).select(key, "line", (F.col("p") + 1).cast("long").alias("number"), "offset")


def frame(line: Column, offset: Column, rules: Framing = Framing()) -> Column:
    """struct<record, torn, fault> of a raw line: its record, torn records before it, and why it is refused.

    A null record without a fault is a blank line.
    """
    body = F.when(offset == 0, F.regexp_replace(line, f"^{MARK}", "")).otherwise(line)
    if rules.trim_cr:
        body = F.regexp_replace(body, "\r$", "")
    torn = F.lit(0)
    missing = F.lit(None).cast("string")
    if rules.separator:
        marks = F.char_length(body) - F.char_length(F.replace(body, F.lit(SEPARATOR), F.lit("")))
        head = F.substring_index(body, SEPARATOR, 1)
        torn = F.when(marks > 0, marks - 1 + F.when(F.regexp_like(head, F.lit(r"[^ \t]")), 1).otherwise(0)).otherwise(0)
        missing = F.when((marks == 0) & F.regexp_like(body, F.lit(r"[^ \t]")), "MissingSeparator")
        body = F.substring_index(body, SEPARATOR, -1)
    long = F.when(F.octet_length(body) > rules.max_line_bytes, "LineTooLong")
    control = F.when(index_of_control(body).isNotNull(), "ControlByte") if rules.control == "reject" else F.lit(None).cast("string")
    fault = F.coalesce(long, missing, control)
    blank = F.regexp_like(body, F.lit(r"^[ \t]*$"))
    record = F.when(fault.isNull() & ~(blank & F.lit(rules.skip_blank)), body)
    return F.struct(record.alias("record"), torn.alias("torn"), fault.alias("fault"))


def last_lines(lines: DataFrame, n: int, order: str = "offset") -> DataFrame:
    """The last n lines, latest first (a top-n, not a sort of all)."""
    return lines.orderBy(F.col(order).desc()).limit(n)
