"""Token counts with a digest cache.

Each normalised text and tokenizer version has a digest. The cache, a Parquet
table in a folder that the caller names, stores counts by version and digest.
Documents are counted in passes: a pass looks its digests up in the cache, encodes
each distinct text that misses once, and appends the new counts, which later
passes and later calls find. Rows then take their counts from the cache.

Normalisation reads null as the empty text and changes nothing else, since any
other change could change the count. Defined results: an empty text has no
tokens; repeated rows and repeated ids give a row each and are encoded once; an
empty table gives an empty table; further columns of the input are ignored. A
digest that was stored twice (by calls at the same time) counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm import tokens
from docframe.llm.common import Scratch, join_salted, text_of

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def count_texts(texts: DataFrame, path: str) -> DataFrame:
    """digest and text to digest and n_tokens, in Arrow batches; memory is bounded by ``tokens.RUN_CHARS`` and a text."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = f["text"].tolist()
            for i, j in tokens.runs(held):
                yield pd.DataFrame({"digest": f["digest"].iloc[i:j], "n_tokens": tokens.count_run(path, held[i:j])})

    return texts.select("digest", "text").mapInPandas(batches, "digest binary, n_tokens long")


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """digest and n_tokens of the version's stored counts; None while there is no cache."""
    if not _exists(spark, cache):
        return None
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(keyed: DataFrame, path: str, cache: str, version: str) -> None:
    """Encodes the distinct texts of ``keyed`` (h, digest, text) that have no stored count, and appends their counts."""
    spark = keyed.sparkSession
    # One holder of each digest is chosen from hashes alone, so copies of a text never meet in one task.
    holders = keyed.groupBy("digest").agg(F.min("h").alias("h"))
    stored = stored_counts(spark, cache, version)
    if stored is not None:
        holders = holders.join(stored.select("digest"), "digest", "left_anti")
    # rows that repeat a document are dropped before the shuffle and in it
    texts = keyed.groupBy("h", "digest").agg(F.first("text").alias("text"))
    misses = texts.join(holders.hint("shuffle_hash"), ["h", "digest"], "left_semi")
    fresh = count_texts(misses, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, passes: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``; ``cache`` is the folder of stored counts."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column).alias("h"), text_of(text_column).alias("text"))
    for k in range(passes):
        mine = keyed.where(F.pmod("h", F.lit(passes)) == k)
        count_misses(mine.withColumn("digest", digest_of(F.col("text"))), path, cache, version)
    rows = keyed.select("doc_id", "h", digest_of(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    scratch = Scratch(spark, "token-counts")
    rows = scratch.keep(rows, "rows")
    sizes = scratch.keep(rows.groupBy("digest").count().where(F.col("count") > 1), "sizes")
    known = stored_counts(spark, cache, version)
    joined = join_salted(rows, known, sizes, ["digest"], rows.count(), ["h"])
    return joined.select("doc_id", "n_bytes", "n_tokens")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
