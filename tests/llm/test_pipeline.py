import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_against_brute_force(spark):
    import corpus_pipeline
    from docframe.llm import quality_rules
    from tests.llm import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, SF)
    kept = {i for i, t in texts.items() if not any(r.rejects(quality_rules.Measures(t or "")) for r in quality_rules.RULES)}
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = stages["line_dedup"](spark, one, SF)
    order = sorted(kept)
    gone = brute.deleted_lines([(i, texts[i]) for i in order], 50)
    edited = {i: "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in g) for i, g in zip(order, gone)}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == edited and two.columns == docs.columns
    three = stages["near_duplicates"](spark, two, SF)
    roots = brute.components(sorted(edited.items()), 5, 80, 100)
    left = {i for i, (_, root) in roots.items() if root == i}
    assert {r["doc_id"] for r in three.collect()} == left and three.columns == docs.columns
    four = stages["mask_pii"](spark, three, SF)
    for r in four.collect():
        clean = not brute.pii_spans(edited[r["doc_id"]])
        assert not brute.pii_spans(r["text"]) and (r["text"] == edited[r["doc_id"]] or not clean)
    run = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in run.select("doc_id").distinct().collect()} == left


def test_stages_keep_columns_that_clash(spark):
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good + " a@b.co", "k", "d", "s", 7), (2, None, "k", "d", "s", 7), (3, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, deleted string, spans string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "kept", "deleted", "spans", "n_chars"], name
    assert [tuple(r) for r in docs.collect()] == [(1, good + " [EMAIL]", "k", "d", "s", len(good) + 8)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.withColumnRenamed("kept", "length").withColumnRenamed("spans", "ids").withColumnRenamed("deleted", "piece"), "")
    assert packed.select("doc_id", "piece", "start", "offset").collect() == [(1, 0, 0, 0)]


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(7, a), (7, b), (3, a), (3, a), (None, a), (None, b + " x"), (None, " ".join(f"c{i}" for i in range(60))), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own"))
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert left.columns == ["doc_id", "text", "row"]
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:2]) for r in left.collect()) == [(-1, "c0"), (3, "a0"), (7, "b0"), (9, "")]


def test_packed_pieces_hold_the_tokens_of_what_was_kept(spark):
    import zlib

    import numpy as np

    import corpus_pipeline
    from docframe.llm import tokens
    from docframe.llm.common import Scratch

    path = corpus_pipeline.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, " ".join(f"word{j % 97} é" for j in range(i * 60))) for i in range(1, 30)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["pack"]
    rows = stage(spark, docs, "").collect()
    ids = {r["doc_id"]: [*tokens.tokenizer(path).encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 1024 and sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert len(Scratch.made) > 0
