"""The numbered queries, one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import bpe_codec, chat_format, line_dedup, media, ngram_jaccard, packing, pii, quality_fm, quality_rules, token_counts
from docframe.llm.common import Scratch, documents


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack_pieces(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.bpe_round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so that every call does the whole work: the second pass hits what the first one stored
    cache = f"{Scratch(spark, 'token-cache').root}/cache"
    counts = token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    edited = line_dedup.line_dedup(docs)
    return edited.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted_lines"), "text")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_media(documents(spark, sf_dir))
    return media.media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    turn = F.col("id")
    own = spark.range(2).select(F.lit(-7).cast("long"), turn, F.when(turn == 0, "user").otherwise("assistant"), F.lit(hard))
    done = chat_format.format_chat(rows.unionAll(own))
    turns = chat_format.read_chat(F.col("formatted"))
    done = done.withColumn("turns", turns).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", pii.is_base)
    counts = [pii.count_kind(F.col("spans"), k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return marked.select("doc_id", *counts, F.sha2(pii.spell(base), 256).alias("base_sha256"), pii.spell(F.col("spans")).alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scores = quality_fm.quality_scores(docs, quality_fm.train(docs, labels))
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = quality_rules.quality_rules(docs, measures=True)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality_rules.MEASURES, base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "rules_run", "rejected_by")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_components(documents(spark, sf_dir), n=4, num=85, den=100)


OP6_SQL = r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_,
           replace(replace(text, '\', '\\'), '<|', '<\|') AS escaped,
           replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS escaped_role
    FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(escaped) + CASE WHEN before_ = role THEN 7 ELSE length(escaped_role) + 11 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_bpe_codec, op3_token_counts, op4_line_dedup, op5_media_columns, op6_chat_format, op7_pii, op8_quality_classifier, op9_quality_rules, op10_ngram_jaccard]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL}
