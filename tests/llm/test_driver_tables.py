"""The driver holds a table once: pieces go as they are put in."""

from docframe.llm import ngram_jaccard as nj


class _Counted:
    def __init__(self, rows):
        self.rows = rows

    def collect(self):
        return self.rows

    repartition = sortWithinPartitions = mapInPandas = lambda self, *a: self


def test_pieces_of_tables_go_as_they_are_put_in():
    piece = lambda part, x: {"part": part, "seen": bytes([x]) * (1 << (nj.SEEN_BITS - 11)), "level": bytes([x]) * (1 << (nj.LEVEL_BITS - 8))}
    rows = [piece(0, 1), piece(255, 2)]
    seen, level = nj._tables(_Counted(rows))
    assert rows == []
    assert (seen[0], seen[-1], level[0], level[-1], len(seen), len(level)) == (1, 2, 1, 2, 1 << 24, 1 << 22)
