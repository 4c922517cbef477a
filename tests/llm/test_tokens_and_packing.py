import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from docframe.llm import bpe_codec, packing, token_counts, tokens  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", "a  b", "<|endoftext|> x", " lead", "trail ", "a\n\nb", "a\tb c", "é\xa0b c", "it's 's I'LL", "x\x1cy z", "日本 語", "ΣΑΣ σς a", "İstanbul x", "a \nb", "\n", "  ",
    "'s 12345 ½²x", "é x ́y", "<|startoftext|> <|x", "A\r\nB c", "foo\n bar", "ſ K ½ ª", "don't\nI've", "ab​cd ef", "a b c", "a\x00b c", "x " + "ab" * 3000 + " y", "🙂 🙂🙂", "ß ẞ µ ª",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_runs_equal_the_library(path):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "\n", "é", "'", "s", "1", ".", "  ", "Ü", "the", "\t"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, cut = tokens.encode_run(path, texts)
    lib = tokens.tokenizer(path)
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_tree_concatenation_equals_encoding_at_once():
    core, ids, sizes = tokens.ranks(WORD)
    rng = random.Random(5)
    for leaf in (3, 16, 50):
        tree = bpe_codec.TreeEncoder(core._encode_single_piece, sizes, leaf)
        for _ in range(60):
            word = bytes(rng.choice(b"aeinrst") for _ in range(rng.randrange(1, 700))) + tokens.WORD_END
            assert tree(word) == core._encode_single_piece(word)
        assert tree.joins > 60
        assert tree(b"a" * 5000 + tokens.WORD_END) == core._encode_single_piece(b"a" * 5000 + tokens.WORD_END)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length long")


def unsplit(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


LETTERS = ("etaoinshrdlu", "ÄÖÜabcß", "日本語中文字東京都", "абвгдежзийклмнопрстуфхцчшщ", "🙂🚀👍🏽", "αβγδεσςΣ", "é́ñ̃aIİ", "@#$%&*-_=+", "คำไทยภาษา")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_unsplit_text_of_any_script_goes_through_the_tree(path):
    rng = random.Random(11)
    encode = bpe_codec.LongPieces(path)
    lib = tokens.tokenizer(path)
    for letters in LETTERS:
        for n in (33, 200, 3000):
            before, text = encode.tree.joins, unsplit(rng, letters, n)
            assert encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, (letters, n)
            assert n < 200 or encode.tree.joins > before or letters[0] in "é@", letters
    marked = f"{unsplit(rng, 'abc', 90)}<|endoftext|>{unsplit(rng, 'abc', 90)}<|endoftext|"
    assert encode(marked).tolist() == lib.encode(marked, add_special_tokens=False).ids
    texts = [unsplit(rng, rng.choice(LETTERS), rng.randrange(400)) + rng.choice(["", " ", "  ", "\n"]) + unsplit(rng, rng.choice(LETTERS), 90) for _ in range(150)]
    ids, cut = tokens.encode_run(path, texts, encode)
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_round_trip_of_long_unsplit_text(spark, path):
    rng = random.Random(7)
    texts = [None, *ODD, unsplit(rng, "etaoinshrdlu", 20_000), "ÄÖÜ" * 4000, unsplit(rng, "日本語中文字", 20_000)]
    docs = frame(spark, texts).unionAll(frame(spark, texts).limit(2))  # repeated rows
    rows = bpe_codec.bpe_round_trip(docs, path).collect()
    assert len(rows) == len(texts) + 2 and bpe_codec.bpe_round_trip(docs.limit(0), path).count() == 0
    got = {r["doc_id"]: r for r in rows}
    lib = tokens.tokenizer(path)
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["decoded"] == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_counts_and_their_cache(spark, tmp_path, path):
    texts = [None, "", "one two", "one two", "three", "é" * 3000]
    docs = frame(spark, texts).unionAll(frame(spark, texts).limit(3))  # repeated rows
    cache = f"file://{tmp_path}/cache"
    want = tokens.count_run(path, [t or "" for t in texts])
    for _ in range(2):
        got = token_counts.token_counts(docs, path, cache).collect()
        assert len(got) == 9
        for r in got:
            t = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), want[r["doc_id"]])
    stored = spark.read.parquet(cache)
    assert stored.count() == 4 and stored.select("digest").distinct().count() == 4
    more = frame(spark, ["new", "three"])
    token_counts.token_counts(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == 5
    assert token_counts.token_counts(docs.limit(0), path, f"file://{tmp_path}/none").count() == 0


def test_hits_are_not_encoded_and_misses_once(spark, tmp_path, monkeypatch):
    encoded = []

    def counted(texts, path):
        encoded.append(sorted(r["text"] for r in texts.select("text").collect()))
        return count(texts, path)

    count = token_counts.count_texts
    monkeypatch.setattr(token_counts, "count_texts", counted)
    copies = [(i, "same text") for i in range(40)] + [(7, "twice")] * 5 + [(None, "nameless")] * 3 + [(8, None)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(docs, BYTE, cache).collect()
    assert len(got) == 49 and len(encoded) == 2
    assert sorted(sum(encoded, [])) == ["", "nameless", "same text", "twice"]  # the second pass finds what the first stored
    token_counts.token_counts(docs, BYTE, cache).collect()
    assert encoded[2:] == [[], []]


def test_packing_is_whole_gapless_and_tight(spark):
    rng = random.Random(1)
    texts = [None, "", *(" ".join(rng.choice(["the", "of", "thing", "é"]) for _ in range(rng.randrange(3000))) for _ in range(60))]
    docs = frame(spark, texts).unionAll(frame(spark, texts).limit(2))
    pieces = packing.token_pieces(docs, BYTE).cache()
    rows = packing.pack_pieces(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), island=16).collect()
    lib = tokens.tokenizer(BYTE)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["crc"]
        assert r["length"] == 1024 or r["piece"] == 0
    total = sum(r["length"] for r in rows)
    assert total == sum(map(len, ids.values())) + 2
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 1024 and len(by) <= -(-total // 1024) + 3
    assert packing.pack_pieces(pieces.limit(0).drop("ids")).count() == 0


def test_islands_find_what_best_fit_misses():
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2] * 3)
    bins = packing.evolve(lengths, 10, 1)
    assert sorted(sum(bins, [])) == sorted(lengths) and all(sum(b) <= 10 for b in bins) and len(bins) == 9


INSTANCES = [(lambda r: np.clip(r.lognormal(6, 0.6, 300).astype(int), 1, 1023), s) for s in range(2)]
INSTANCES += [(lambda r: r.integers(200, 501, 300), s) for s in range(3)] + [(lambda r: r.integers(300, 421, 300), s) for s in range(3)]
INSTANCES += [(lambda r: r.integers(260, 701, 300), s) for s in range(2)]


def test_evolution_beats_its_greedy_start():
    fewer = 0
    for make, seed in INSTANCES:
        lengths = make(np.random.default_rng(seed))
        greedy = len(packing.best_fit(np.bincount(lengths, minlength=1025).tolist(), 1024))
        bins = packing.evolve(lengths, 1024, seed)
        assert sorted(sum(bins, [])) == sorted(lengths) and max(map(sum, bins)) <= 1024
        assert len(bins) <= greedy
        fewer += len(bins) < greedy
    assert fewer >= 7


def test_what_arrives_on_an_island_is_never_lost():
    rng = np.random.default_rng(3)
    bins = [tuple(map(int, np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, 1024), 3, replace=False)), 1024]))) for _ in range(150)]
    lengths = np.array([x for b in bins for x in b])
    assert len(packing.evolve(lengths, 1024, 1, bins)) == 150


def test_crossover_keeps_partly_filled_bins_and_every_length():
    rng = np.random.default_rng(4)
    a, b = [(5, 4), (3, 3), (2,)], [(5, 3, 2), (4, 3)]
    for _ in range(20):
        child = packing.crossover(a, b, [0, 0, 1, 2, 1, 1, 0, 0, 0, 0, 0], 10, rng)
        assert sorted(x for c in child for x in c) == [2, 3, 3, 4, 5] and max(map(sum, child)) <= 10 and len(child) == 2


def test_digest_names_the_vocabulary():
    with open(BYTE, "rb") as f:
        assert token_counts.tokenizer_version(BYTE) == hashlib.sha256(f.read()).hexdigest()[:32]
