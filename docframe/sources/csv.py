"""CSV files by the rules: exact quoting, rows of the header's width, numbers and offsets, typed columns.

A quoted field may hold line ends, so lines are joined into rows where the count of
quotes before a line, summed over the file as in ``sources.lines``, is odd. A quote
in the wrong place is refused, and the rows behind it, up to the next quote, with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.arrays import let
from docframe.functions.route import whole_of
from docframe.functions.text import csv_fields
from docframe.operators.records import ERROR, error
from docframe.sources.lines import before_in_file, split_lines
from docframe.spec import INTEGERS, MISSING, FieldSpec, RecordSpec

_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def read_csv_rows(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """path, row (from 0), line (from 1) and offset (bytes) of its first line, fields (null for an empty unquoted one; null as a whole for a malformed row)."""
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    rows = before_in_file(split_lines(spark, path), number=F.lit(1), offset=F.octet_length("line") + 1, quotes=quotes)
    # blank lines between rows are no rows
    first = (F.col("quotes") % 2 == 0) & ~F.col("line").isin("", "\r")
    rows = rows.withColumn("first", first).where((F.col("quotes") % 2 == 1) | F.col("first"))
    rows = before_in_file(rows, row=F.col("first").cast("int")).withColumn("row", F.col("row") + F.col("first").cast("int") - 1)
    whole = rows.groupBy("path", "row").agg(F.sort_array(F.collect_list(F.struct("number", "offset", "line"))).alias("parts"))
    head = F.get("parts", F.lit(0))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"), "\r$", "")
    text = F.when(head["offset"] == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return whole.select("path", "row", (head["number"] + 1).alias("line"), head["offset"].alias("offset"), csv_fields(text, delimiter).alias("fields"))


def csv_value(text: Column, f: FieldSpec) -> Column:
    """struct<value, error> of one field's text; an empty unquoted one is null, or an empty text where there are no nulls."""
    out = lambda value, bad: F.struct(value.cast(f.spark_type).alias("value"), bad.cast(ERROR).alias("error"))
    wrong = error("UnexpectedType")
    if f.kind in INTEGERS:
        value = whole_of(text, f.kind)
        bad = F.when(~F.regexp_like(text, F.lit(_NUMBER)), wrong).when(value.isNull(), error("NumberOutOfRange"))
    elif f.kind in ("float", "double") or f.kind.startswith("decimal"):
        value = F.when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast(f.kind))
        bad = F.when(~F.regexp_like(text, F.lit(_NUMBER)), wrong).when(value.isNull() | (F.abs(value.cast("double")) == float("inf")), error("NumberOutOfRange"))
    elif f.kind == "boolean":
        value = F.when(text == "true", True).when(text == "false", False)
        bad = F.when(value.isNull(), wrong)
    else:
        value, bad = text, F.lit(None)
    checks = [bad.cast(ERROR)]
    if f.minimum is not None:
        checks.append(F.when(value < F.lit(f.minimum), error("NumberOutOfRange")))
    if f.maximum is not None:
        checks.append(F.when(value > F.lit(f.maximum), error("NumberOutOfRange")))
    if f.allowed is not None:
        checks.append(F.when(~value.isin(*f.allowed), error("UnknownVariant")))
    empty = out(F.lit(None), F.lit(None)) if f.nullable else out(F.lit(""), F.lit(None)) if f.kind == "string" else out(F.lit(None), wrong)
    return F.when(text.isNull(), empty).otherwise(out(value, F.coalesce(*checks)))


def read_csv(spark: SparkSession, path: str, record: RecordSpec, delimiter: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows with the record's fields, and refused rows (path, row, line, offset, code, field).

    With a header, columns are bound by name in any order and must be the record's;
    without one they are its fields in order.
    """
    rows = read_csv_rows(spark, path, delimiter)
    if header:
        heads = rows.where(F.col("row") == 0).select("path", F.col("fields").alias("names"))
        rows = rows.where(F.col("row") > 0).join(heads, "path")
    else:
        rows = rows.withColumn("names", F.array(*map(F.lit, record.wire_names())))
    names = F.transform("names", lambda n: F.coalesce(n, F.lit("")))

    def read(s: Column) -> Column:
        names, fields = s["names"], s["fields"]
        known = [n for f in record.fields for n in (record.wire_name(f), *f.aliases)]
        extra = F.array_except(names, F.array(*map(F.lit, known)))
        checks = [F.when(names.isNull() | fields.isNull(), error("SyntaxError")), F.when(F.size(names) != F.size(F.array_distinct(names)), error("DuplicateField"))]
        if record.unknown_fields == "reject":
            checks.append(F.when(F.size(extra) > 0, F.struct(F.lit("UnknownField").alias("code"), F.get(extra, F.lit(0)).alias("field")).cast(ERROR)))
        checks.append(F.when(F.size(names) != F.size(fields), error("SyntaxError")))
        parts = []
        for f in record.fields:
            wire = record.wire_name(f)
            place = F.coalesce(*[F.nullif(F.array_position(names, n), F.lit(0)) for n in (wire, *f.aliases)])
            optional = f.nullable or f.default is not MISSING
            missing = F.struct(F.lit(None if f.default is MISSING else f.default).cast(f.spark_type).alias("value"), (F.lit(None).cast(ERROR) if optional else error("MissingField", wire)).alias("error"))
            given = csv_value(F.get(fields, (place - 1).cast("int")), f)
            parts.append(F.when(place.isNull(), missing).otherwise(F.struct(given["value"].alias("value"), F.when(given["error"].isNotNull(), F.struct(given["error"]["code"].alias("code"), F.lit(wire).alias("field"))).cast(ERROR).alias("error"))).alias(f.field))
        return let(F.struct(*parts), lambda p: F.struct(F.struct(*[p[f.field]["value"].alias(f.field) for f in record.fields]).alias("value"), F.coalesce(*checks, *[p[f.field]["error"] for f in record.fields]).alias("error")))

    parsed = rows.withColumn("p", let(F.struct(names.alias("names"), "fields"), read))
    good = parsed.where(F.col("p.error").isNull()).select("p.value.*")
    bad = parsed.where(F.col("p.error").isNotNull()).select("path", "row", "line", "offset", "p.error.code", "p.error.field")
    return good, bad
