"""Writers: JSON Lines with or without record separators, bounded lines, and CSV, by Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import csv_field, csv_line
from docframe.operators.lines import SEPARATOR


def line_text(record: Column, separator: bool = False, max_line_bytes: int | None = None) -> Column:
    """A record's line; a line over the limit fails the write before anything of its task is published."""
    line = F.concat(F.lit(SEPARATOR), record) if separator else record
    if max_line_bytes is None:
        return line
    return F.when(F.octet_length(line) > max_line_bytes, F.raise_error(F.lit("LineTooLong")).cast("string")).otherwise(line)


def write_json_lines(df: DataFrame, path: str, record: Column, separator: bool = False, max_line_bytes: int | None = None, mode: str = "errorifexists") -> None:
    df.select(line_text(record, separator, max_line_bytes).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists", header: bool = True) -> None:
    """CSV files with a header row each, CRLF line ends, quotes only where needed and around empty text."""
    names = df.columns
    line = csv_line(*[F.col(f"`{c}`") for c in names], delimiter=delimiter).alias("value")
    first = csv_line(*map(F.lit, names), delimiter=delimiter).alias("value")
    head = df.sparkSession.range(1).select(first).first()[0]

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], ["value"])
        yield from batches

    lines = df.select(line)
    lines = lines.mapInArrow(with_header, "value string") if header else lines
    lines.write.mode(mode).option("lineSep", "\r\n").text(path)


__all__ = ["csv_field", "line_text", "write_csv", "write_json_lines"]
