"""Every numbered query as registered, on a small table of awkward rows, against plain restatements."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")
from docframe.llm import queries, tokens  # noqa: E402
from tests.llm import brute  # noqa: E402

BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnpr')}{rng.randrange(words)}" for _ in range(n))


def rows():
    rng = random.Random(12)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randrange(40, 160)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1] + " tail", passage + "\n" + texts[2], texts[3] + "\n" + passage, passage]
    texts += [None, "", " \n\t ", "a b c", "A b C", "é" * 700, "日本語" * 200, "x" * 5000, "#*$ " * 60, "\n".join(["same line here"] * 30), prose(rng, 3000)]
    texts += [f"{texts[5]} mail a.b@c.de, ip 10.0.0.1 and 999.1.1.1 card 4111 1111 1111 1111 phone +1 (415) 555-2671", "<|endoftext|> a <|startoftext|>", "x\x0by\x1cz"]
    found = [(i * 7, t) for i, t in enumerate(texts)]
    return [*found, (0, texts[0]), (35, "another text of a repeated id " + prose(rng, 60)), (None, "no id " + prose(rng, 60))]


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    where, held = tmp_path_factory.mktemp("sf"), rows()
    n = len(held)
    columns = {"doc_id": pa.array([i for i, _ in held], pa.int64()), "text": pa.array([t for _, t in held], pa.string()), "lang": pa.array(["en"] * n), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([len(t) if t else None for _, t in held], pa.int64())}
    pq.write_table(pa.table(columns), where / "documents.parquet")
    labels = {"doc_id": pa.array([i * 7 for i in range(40)], pa.int64()), "quality": pa.array([int(i < 30) for i in range(40)], pa.int64()), "toxic": pa.array([0] * 40, pa.int64())}
    pq.write_table(pa.table(labels), where / "labels.parquet")
    return str(where), held


def got(spark, table, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in queries.queries()[name](spark, table[0]).collect()), key=repr)


def expected(pairs):
    return sorted(pairs, key=repr)


def lib(path, text):
    return tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_op1(spark, table):
    want = []
    for i, t in table[1]:
        ids = [*lib(BYTE, t), 2]
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    found = queries.queries()["op1_best_fit_packing"](spark, table[0]).collect()
    assert expected((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected(want)
    by = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 1024 and len(by) <= -(-sum(by.values()) // 1024) + 1


def test_op2(spark, table):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in table[1]:
        ids = lib(WORD, t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokens.tokenizer(WORD).decode(ids, skip_special_tokens=False))))
    assert got(spark, table, "op2_bpe_codec", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)


def test_op3(spark, table):
    want = [(i, len((t or "").encode()), len(lib(BYTE, t)), len(lib(BYTE, t)) > 512) for i, t in table[1]]
    assert got(spark, table, "op3_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == expected(want)


def test_op4(spark, table):
    # rows equal in id and text are one document; ids in order, none first, then by hash: here no order of equal ids matters
    distinct = sorted(set(table[1]), key=lambda r: (r[0] is not None, r[0] or 0))
    gone = dict(zip(distinct, brute.deleted_lines([(i, t or "") for i, t in distinct], 50)))
    want = []
    for i, t in table[1]:
        g = gone[i, t] if t is not None else []
        cut = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g)
        want.append((i, len(g), ",".join(map(str, g)), cut))
    assert got(spark, table, "op4_line_dedup", "doc_id", "n_deleted", "deleted_lines", "text") == expected(want)
    assert sum(w[1] for w in want) >= 3


def test_op5(spark, table):
    want = []
    for i, t in table[1]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got(spark, table, "op5_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == expected(want)
    made = {}
    for r in queries.queries()["op5_media_columns"](spark, table[0]).collect():
        assert made.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_op7(spark, table):
    kinds = list(brute.PATTERNS)
    want = []
    for i, t in table[1]:
        spans = brute.pii_spans(t or "")
        spelled = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *(sum(s[3] == k for s in spans) for k in kinds), hashlib.sha256(spelled.encode()).hexdigest()))
    assert got(spark, table, "op7_pii", "doc_id", *(f"n_{k}" for k in kinds), "base_sha256") == expected(want)


def test_op8(spark, table):
    found = queries.queries()["op8_quality_classifier"](spark, table[0]).collect()
    assert expected((r["doc_id"], r["held_out"]) for r in found) == expected((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in table[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_op9(spark, table):
    found = queries.queries()["op9_quality_rules"](spark, table[0]).collect()
    want = []
    for i, t in table[1]:
        m = brute.measures(t or "")
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert expected((r["doc_id"], *(r[n] for n in names)) for r in found) == expected(want)
    assert all(not r["kept"] for r in found if r["base_failed"]) and any(r["kept"] for r in found)


def test_op10(spark, table):
    # brute force over rows of their own, then ids: the least id of a component
    numbered = list(enumerate(t for _, t in table[1]))
    roots = brute.components([(n, t) for n, t in numbered if table[1][n][0] is not None], 4, 85, 100)
    least = {}
    for n, (_, root) in roots.items():
        least[root] = min(least.get(root, 1 << 60), table[1][n][0])
    none = brute.components(numbered, 4, 85, 100)
    want = [(i, none[n][0], None if i is None else least[roots[n][1]]) for n, (i, _) in enumerate(table[1])]
    assert got(spark, table, "op10_ngram_jaccard", "doc_id", "n_shingles", "component_id") == expected(want)


def test_names_and_registration():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert len(names) == 10 and {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and json.dumps(sorted(__spark_entry__.oracle_sql()))
