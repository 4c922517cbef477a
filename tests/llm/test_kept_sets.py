"""What the n-gram join keeps on disk: sets of nodes only that share a shingle with another node."""

import numpy as np

from docframe.llm import ngram_jaccard
from docframe.llm.common import Scratch


def test_sets_are_kept_of_nodes_that_share_shingles(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 60)) for _ in range(30)]
    near = texts[0] + " more"
    rows = [(i, t) for i, t in enumerate(texts * 3 + [near])]
    kept, keep = {}, Scratch.keep

    def counted(self, df, table):
        out = keep(self, df, table)
        kept[table] = (out.count(), out.columns)
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    got = {x["doc_id"]: x["component_id"] for x in ngram_jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == {i: i % 30 for i in range(90)} | {90: 0}
    assert kept["shingles"][0] == 2 and "shingles" not in kept["sets"][1]


def test_shared_tokens_are_all_kept_and_few_others(spark):
    r = np.random.default_rng(6)
    own = r.integers(-(2**63), 2**63 - 1, (200, 100))
    rows = [(i, 0, [int(x) for x in own[i]] + ([7, -7, int(own[0][0])] if i % 50 == 1 else [])) for i in range(200)] + [(200, 0, [])]
    found = {x["node"]: x["tokens"] for x in ngram_jaccard.shared_tokens(spark.createDataFrame(rows, "node long, rare long, tokens array<long>").repartition(3)).collect()}
    assert len(found) == 201
    assert all({7, -7, int(own[0][0])} <= set(found[i]) for i in range(1, 200, 50)) and int(own[0][0]) in found[0]
    assert sum(map(len, found.values())) < 40
    assert [x.tolist() for x in (ngram_jaccard._bits(np.full(1 << (ngram_jaccard.SEEN_BITS - 3), 255, np.uint8), np.array([1, 2**63], np.uint64)),)] == [[True, True]]
