"""Lines and records of files with their number and byte offset, by Spark's own readers.

What runs along a file (numbers, offsets, depths) is summed inside each split, and
the totals of a file's splits are summed before them, so no file is read, sorted or
summed by one task alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docframe.operators.lines import Framing, frame


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block and seen (where a line stands), line and file_size."""
    meta = {"path": "file_path", "block": "file_block_start", "file_size": "file_size"}
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("value").alias("line"), *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()], F.monotonically_increasing_id().alias("seen"))


def before_in_file(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` (with path, block, seen) with, for each value, its sum over all earlier lines of the file."""
    held = rows.select("*", *[v.cast("long").alias(f"__{n}") for n, v in values.items()])
    inside = Window.partitionBy("path", "block").orderBy("seen").rowsBetween(Window.unboundedPreceding, -1)
    splits = held.groupBy("path", "block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in values])
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in values])
    held = held.select("*", *[F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)).alias(n) for n in values])
    joined = held.join(splits, ["path", "block"])
    sums = [(F.col(n) + F.col(f"__before_{n}")).cast("long").alias(n) for n in values]
    return joined.select(*[c for c in rows.columns if c not in values], *sums)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines with number, offset and ended (a line feed stands behind the line)."""
    rows = before_in_file(split_lines(spark, path), number=F.lit(1), offset=F.octet_length("line") + 1)
    return rows.withColumn("number", F.col("number") + 1).withColumn("ended", F.col("offset") + F.octet_length("line") < F.col("file_size"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, number (from 1) and offset (bytes) of every line of text files."""
    return _numbered(spark, path).select("path", "line", "number", "offset")


def read_records(
    spark: SparkSession, path: str, rules: Framing = Framing(), on_malformed: str = "split", counter: Observation | None = None, start_offset: int = 0, pretty: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Framed records (path, record, number, offset) and refused lines (with fault) of JSON Lines files.

    ``on_malformed`` "fail" ends the job at a refused line; ``counter`` observes, as
    ``skipped``, how many there were. ``start_offset`` resumes behind the lines before
    it, whose numbers still count. Under ``require_terminator`` a last line without a
    line feed is no line. ``pretty`` joins lines until the value ends; a blank line
    ends a record too. A line over the byte limit is refused whole.
    """
    rows = _numbered(spark, path).where(F.col("offset") >= start_offset)
    if rules.require_terminator:
        rows = rows.where("ended")
    framed = rows.withColumn("f", frame(F.col("line"), F.col("offset"), rules))
    if pretty:
        framed = _joined_records(framed, rules)
    fault = F.col("f.fault")
    if on_malformed == "fail":
        where = F.concat(fault, F.lit(" at line "), F.col("number").cast("string"), F.lit(" of "), F.col("path"))
        framed = framed.withColumn("f", F.when(fault.isNotNull(), F.raise_error(where).cast(framed.schema["f"].dataType)).otherwise(F.col("f")))
    if counter is not None:
        framed = framed.observe(counter, F.count_if(fault.isNotNull()).alias("skipped"))
    good = framed.where(F.col("f.record").isNotNull()).select("path", F.col("f.record").alias("record"), "number", "offset")
    bad = framed.where(fault.isNotNull()).select("path", "line", "number", "offset", fault.alias("fault"))
    return good, bad


def _joined_records(framed: DataFrame, rules: Framing) -> DataFrame:
    """Lines joined from one where no bracket is open to the one that closes the last, or to a blank line or a fault."""
    bare = F.regexp_replace(F.coalesce(F.col("f.record"), F.lit("")), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    opened = F.char_length(F.regexp_replace(bare, r"[^{\[]", "")) - F.char_length(F.regexp_replace(bare, r"[^}\]]", ""))
    apart = F.col("f.record").isNull() | F.regexp_like("f.record", F.lit(r"^[ \t]*$"))
    rows = before_in_file(framed, depth=opened, part=apart.cast("int"))
    # a blank or refused line starts a new part, where no bracket is open, whatever was left open before it
    base = rows.groupBy("path", "part").agg(F.min_by("depth", "number").alias("base"))
    rows = rows.join(base, ["path", "part"])
    first = ~apart & (F.col("depth") <= F.col("base"))
    rows = before_in_file(rows.withColumn("first", first), record=F.col("first").cast("int")).withColumn("record", F.col("record") + F.col("first").cast("int"))
    whole = rows.where(~apart).groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("number", "offset", "f.record", "f.torn"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    long = F.when(F.octet_length(text) > rules.max_line_bytes, "LineTooLong")
    head = F.get("parts", F.lit(0))
    joined = whole.select("path", text.alias("line"), head["number"].alias("number"), head["offset"].alias("offset"), F.struct(F.when(long.isNull(), text).alias("record"), head["torn"].alias("torn"), long.alias("fault")).alias("f"))
    return joined.unionByName(rows.where(F.col("f.fault").isNotNull()).select("path", "line", "number", "offset", "f"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """XML rows with attributes as @name and text as $text; nothing external is fetched."""
    return spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="$text").schema(schema).load(path)


#: Options of Spark's JSON parser for the commented and the relaxed dialect.
JSONC = {"allowComments": "true"}
JSON5 = JSONC | {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNonNumericNumbers": "true", "allowBackslashEscapingAnyCharacter": "true"}


def strip_trailing_commas(text):
    """A commented JSON text without commas before a closing bracket; strings are left alone."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|,(?=(?:\s|//[^\n]*|/\*(?s:.)*?\*/)*[\]}])', "$1")
