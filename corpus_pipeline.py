"""A training-data pipeline over ``documents``: five stages, each written before the next reads it.

1. ``quality_rules``: documents that a rule rejects go.
2. ``line_dedup``: later copies of repeated runs of lines are cut from texts.
3. ``near_duplicates``: of each component of near-duplicate texts (five-word
   shingles, similarity 0.8) one row stays, that of the least id; among rows of
   one id and among those without an id, which come last, the first in the table.
4. ``mask_pii``: personal data and terms that reveal it are masked in texts.
5. ``pack``: texts are cut and packed into sequences of 1,024 tokens.

All stages but the last return the columns of their input. Null texts are empty
and are rejected by the first stage; texts may be of any length; repeated rows are
copies of one another; an empty table gives an empty table; columns of any other
name are carried along. Scratch tables of a stage are removed once its result is
written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import line_dedup as lines
from docframe.llm import ngram_jaccard, packing, pii, quality_rules
from docframe.llm.common import Scratch, free_name
from docframe.llm.queries import tokenizer_path


def _aside(docs: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose own column of a name that the work adds is kept out of its way and put back."""
    own = free_name(docs, f"__own_{name}")
    done = work(docs.withColumnRenamed(name, own))
    return done.drop(name).withColumnRenamed(own, name).select(*docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return _aside(docs, "kept", lambda d: quality_rules.quality_rules(d).where("kept"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later copies of repeated runs of lines cut from their texts; n_chars follows."""

    def work(d: DataFrame) -> DataFrame:
        edited = lines.line_dedup(d)
        if "n_chars" in d.columns:
            kind = d.schema["n_chars"].dataType
            edited = edited.withColumn("n_chars", F.when(F.size("deleted") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
        return edited

    return _aside(docs, "deleted", work)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: ids may repeat or be missing, so rows are told apart by their own number."""
    scratch = Scratch(spark, "near-duplicates")
    key = free_name(docs, "row")
    rows = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.monotonically_increasing_id().alias("number")))
    rows = scratch.keep(rows, "rows")
    found = ngram_jaccard.near_components(rows, n=5, num=80, den=100, id_column=key)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text."""

    def work(d: DataFrame) -> DataFrame:
        masked = pii.mask_pii(d)
        if "n_chars" in d.columns:
            kind = d.schema["n_chars"].dataType
            masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
        return masked

    return _aside(docs, "spans", work)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts with the sequence and the offset that they are packed at."""
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    packed = packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("mask_pii", stage_pii),
    ("pack", stage_pack),
]

#: Shingle components and tokenisation are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        mark = len(Scratch.made)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.remove_since(mark, scratch)
        if last:
            scratch.drop(last)
        last = name
    return docs
