"""What passes through the driver, and is planned on it, stays small where there is little to do."""

import numpy as np
import pytest

from docframe.llm import ngram_jaccard as nj
from docframe.llm.common import Scratch, components


def test_pieces_of_sparse_tables_are_sent_squeezed():
    counts = nj.RangeCounts()
    counts.add(np.array([5, 5, 1 << 20]))
    row = nj._table_row(3, counts).iloc[0]
    assert len(row["seen"]) + len(row["level"]) < 1000
    whole = nj.unsqueezed(row["seen"], 1 << (nj.SEEN_BITS - 11))
    assert whole.sum() > 0 and whole.tobytes() == counts.slices()[0]


def test_squeezed_tables_come_back_whole():
    noise = np.random.default_rng(1).bytes(1 << 16)
    assert nj.squeezed(noise) == noise
    for table in (noise, bytes(1 << 16), bytearray(noise[:100] + bytes((1 << 16) - 100))):
        assert nj.unsqueezed(nj.squeezed(table), 1 << 16).tobytes() == bytes(table)


def _least(links):
    root = {n: n for link in links for n in link}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


CASES = {
    "none": ([], 0),
    "stars": ([(1, 0), (2, 0), (9, 7), (0, 3)], 0),
    "two parents": ([(5, 1), (5, 2)], 1),
    "path": ([(i, i + 1) for i in range(40)], 1),
    "ring": ([(i, (i * 7 + 1) % 31) for i in range(31)] + [(40, 40)], 1),
    "mixed": ([(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 60, (40, 2))], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_rounds_end_as_soon_as_links_are_stars(spark, monkeypatch, name):
    links, least = CASES[name]
    made, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, table: made.append(table) or keep(self, df, table))
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test-stars"), "c").collect()
    want = {n: r for n, r in _least(links).items() if any(a != b for a, b in links if n in (a, b))}
    assert sorted((x["node"], x["root"]) for x in found) == sorted(want.items())
    assert ("c1" in made) == bool(least)
