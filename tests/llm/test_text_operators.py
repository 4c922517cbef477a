import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docframe.llm import chat_format, line_dedup, ngram_jaccard, pii, quality_fm, quality_rules
from tests.llm import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, spans int, deleted int")


def docs(spark, texts):
    return frame(spark, [(i, t, "k", 1, 2) for i, t in enumerate(texts)])


def text(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- chat ---


def test_chat_reads_back(spark):
    hard = ["", None, "<|end|>", "\\", "\\<|", "<|and|>x<", "<|user|>", "a\\|>b", "</s>[INST] ok [/INST]", "<", "é\n"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "o<|d|>\\"]), rng.choice(hard), "extra") for c in (1, 2, None) for t in range(30)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = chat_format.format_chat(df)
    got = made.select("conv_id", chat_format.read_chat(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    assert len(got) == 3
    for r in got:
        want = sorted((t, role or "", x or "") for c, t, role, x, _ in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["t"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        marks = sum(1 for a, b in zip(want, [(0, None), *want]) if a[1] != b[1])
        assert r["formatted"].count("<|end|>") == marks
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    n = 20_000
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} <|end|> é") for t in range(n)]
    made = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = made.select(F.size("loss_spans").alias("n"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r["n"] == n // 2 and r["loss"] == "".join(x[3] for x in rows if x[2] == "assistant")


# --- line dedup ---


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [text(rng, rng.randrange(0, 6)) for _ in range(7)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(25)] + ["", "a b c d e f g h"] * 2 + ["\n".join(["x y"] * 20)]
    want = brute.deleted_lines(list(enumerate(texts)), 8)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, texts), 8).collect()}
    for i, t in enumerate(texts):
        assert got[i]["deleted"] == want[i], i
        assert got[i]["text"] == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i])
        assert got[i]["kept"] == "k"


def test_line_dedup_edges(spark):
    long = text(random.Random(1), 60)
    rows = [(1, long), (1, long), (2, None), (None, long), (3, long + "\nend"), (3, "other\n" + long)]
    df = frame(spark, [(*r, "k", 1, 2) for r in rows])
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in line_dedup.line_dedup(df).collect())
    assert got == sorted([(-1, long), (1, ""), (1, ""), (2, ""), (3, "end"), (3, "other")])
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# --- near duplicates ---


def near_texts(seed):
    rng = random.Random(seed)
    base = [text(rng, 60, 900) for _ in range(6)]
    out = []
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
            out.append(" ".join(w))
    shared = text(rng, 50, 900)
    out += [shared + " " + text(rng, rng.randrange(3, 30), 900) for _ in range(25)]
    out += [base[0].upper(), base[0], "", None, "a", "A", "b c", " ", "a b c d", base[1] + "\n" + base[1]]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_near_components_equal_brute_force(spark, seed, n, num, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    monkeypatch.setattr(ngram_jaccard, "QUERIES", 5)
    texts = near_texts(seed)
    want = brute.components(list(enumerate(texts)), n, num, 100)
    got = ngram_jaccard.near_components(docs(spark, texts), n, num, 100).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_near_components_edges(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (4, "A B c d e"), (4, "other text here now")]
    got = ngram_jaccard.near_components(frame(spark, [(*r, "k", 1, 2) for r in rows]), 4, 85, 100).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (4, 4), (4, 4), (5, 4), (5, 4)]
    assert ngram_jaccard.near_components(docs(spark, ["x"]).limit(0)).count() == 0


def test_opening_a_block_finds_chains_between_components():
    import numpy as np
    import pandas as pd

    sets = [np.arange(a, a + 40, dtype=np.uint64) for a in (0, 2, 4, 30)]
    members = pd.DataFrame({"ord": [9, 8, 7, 6], "shingles": [s.tobytes() for s in sets]})
    asks = pd.DataFrame({"own": [1, 8], "asked": [sets[1].tobytes(), sets[1].tobytes()]})
    assert sorted(ngram_jaccard.open_block(members, asks, 85, 100)) == [(1, 7), (1, 8), (1, 9), (8, 9)]


def test_packed_tokens_read_back():
    import numpy as np

    found = np.array([0, 1, 1, 65535, 65536, 300_000, 16_000_000])
    assert ngram_jaccard.unpack_tokens(ngram_jaccard.pack_tokens(found)).tolist() == found.tolist()


# --- personal data ---

HARD = [
    "a@b.c_d@e.f", "x@y", "@a.b a.b@c..d", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111110000",
    "+1 (415) 555-2671 x", "+1((((", "+12345678901234567", "é+44 20 7946 0958é 🙂 a@b.co", "9" * 3000, "a" * 3000 + "@", "1." * 2000, "a.a" * 500 + "@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "card 4532015112830366, +1-202-555-0143",
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", *HARD] + ["".join(rng.choice(["@", ".", "1", "23", "a", "+", " ", "-", "(", ")", "4", "\n", "é", "255"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs(spark, texts)).select("doc_id", pii.spell(F.filter("spans", pii.is_base)).alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute.pii_spans(t or "")), repr(t)


def test_revealing_terms(spark):
    rng = random.Random(6)
    plain = [text(rng, 30) for _ in range(120)]
    named = [f"please write {x} Zaphod {y} at zaphod.b@mail.example.com {x} today" for x, y in (("kindly", "soon"), ("quickly", "then"), ("again", "always"), ("later", "twice"))]
    copies = ["only Xylophone here at one@mail.example.com now"] * 6
    texts = plain + named + copies + ["zaphod, alone", "Zaphods are others"]
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(docs(spark, texts)).select("doc_id", pii.spell(F.col("spans")).alias("s")).collect()}
    n = len(plain)
    where = texts[n].index("Zaphod")
    assert f"term:{where}:{where + 6}" in got[n] and "email" in got[n]
    assert got[n + 10] == "term:0:6" and got[n + 11] == ""
    assert all(got[i] == "" for i in range(n)) and "term" not in got[n + 4]
    masked = {r["doc_id"]: r for r in pii.mask_pii(docs(spark, texts)).collect()}
    assert "zaphod" not in masked[n]["text"].lower() and "[EMAIL]" in masked[n]["text"]
    assert masked[0]["text"] == texts[0] and masked[0]["kept"] == "k"
    assert pii.find_pii(docs(spark, ["x"]).limit(0)).count() == 0


def prose(rng, n):
    """Words of letters, 40 different ones."""
    return text(rng, n).translate(str.maketrans("w0123456789", "vabcdefghij")).replace("v", "vor")


def spelled(spark, rows):
    got = pii.find_pii(frame(spark, [(i, t, "k", 1, 2) for i, t in rows])).select("doc_id", "text", pii.spell(F.col("spans")).alias("s")).collect()
    return [(r["doc_id"], r["text"], r["s"]) for r in got]


def marks(found, term):
    """Whether the term is marked in each row that holds it."""
    for _, t, s in found:
        if term in (t or ""):
            at = t.index(term)
            yield f"term:{at}:{at + len(term)}" in s


def test_rarely_named_entities_have_revealing_terms(spark):
    rng = random.Random(7)
    plain = [prose(rng, 30) for _ in range(150)]
    twice = [f"{prose(rng, 5)} Zebulon {prose(rng, 5)} zeb@x.com {prose(rng, 12)}" for _ in range(2)]
    once = [f"{prose(rng, 5)} Quuxley {prose(rng, 5)} q{i}@y.com {prose(rng, 12)}" for i in range(4)]
    lone = [f"{prose(rng, 5)} Solitary {prose(rng, 5)} 10.1.2.3 {prose(rng, 12)}"]
    found = spelled(spark, enumerate(plain + twice + once + lone))
    assert all(marks(found, "Zebulon")) and all(marks(found, "Quuxley"))
    assert not any(marks(found, "Solitary")) and all("term" not in s for i, _, s in found if i < 150)


def test_terms_stand_near_across_lines_and_blanks(spark):
    rng = random.Random(8)
    plain = [prose(rng, 30) for _ in range(150)]
    above = [f"{prose(rng, 5)}\nZebulon Quux\n{i}\n\nzeb@x.com" for i in range(3)]
    wide = [f"{prose(rng, 9)} Farrell{' ' * 900}{prose(rng, 3)}   far@x.com {prose(rng, 9)}" for _ in range(3)]
    line = [f"{prose(rng, 60)}\nContact Ordway: ord@x.com\n{prose(rng, 60)}" for _ in range(3)]
    copies = [f"{p}\n{prose(random.Random(1), 120)} Copycat cop@x.com {prose(random.Random(2), 120)}" for p in plain[:3]]
    far = [f"Distant {prose(rng, 10)} dis@x.com {prose(rng, 30)}" for _ in range(3)]
    found = spelled(spark, enumerate(plain + above + wide + line + copies + far))
    for name in ("Zebulon", "Quux", "Farrell", "Ordway"):
        assert all(marks(found, name)), name
    assert not any(marks(found, "Copycat")) and not any(marks(found, "Distant"))


def test_words_near_equal_brute_force(spark, monkeypatch):
    import re

    from docframe.llm.common import Scratch

    monkeypatch.setattr(pii, "WINDOW", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["aaa", "bbb ", "ccc", "ddd\n", " ", ", ", "éèê", "\U00010400" * 3, "x@y.zzz", "1.2.3.4", "@", "日本語", "-"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    want = set()
    for i, t in enumerate(texts):
        runs = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", t)]
        for a, _, b, kind in brute.pii_spans(t):
            near = [r[2] for r in runs if r[1] <= a][-3:] + [r[2] for r in runs if r[0] >= b][:3]
            want |= {(t[a:b], w, i) for w in near}
    keyed = docs(spark, texts).select(F.col("doc_id").alias("doc"), "text", pii.base_spans(F.col("text")).alias("base"))
    got = {(r["entity"], r["term"], r["doc"]) for r in pii.nearby_terms(pii.named_rows(keyed, Scratch(spark, "near"))).collect()}
    assert got == want and len(want) > 200


def test_counts_are_over_distinct_documents(spark):
    rng = random.Random(9)
    plain = [(i, prose(rng, 30)) for i in range(150)]
    mention = lambda name, mail: f"{prose(rng, 6)} {name} {prose(rng, 4)} {mail} {prose(rng, 12)}"
    thrice = [(200 + i, mention("Zebulon", "zeb@x.com")) for i in range(2)]
    nameless = [(300, mention("Farrell", "far@x.com")), (None, mention("Farrell", "far@x.com"))]
    found = spelled(spark, (plain + thrice + nameless) * 3)
    assert len(found) == 3 * 154
    assert all(marks(found, "Zebulon")) and all(marks(found, "Farrell"))


def test_terms_of_any_length_are_found_by_both_plans(spark, monkeypatch):
    rng = random.Random(10)
    long = "Q" + "uux" * 25
    plain = [(i, prose(rng, 30)) for i in range(150)]
    named = [(200 + i, f"{prose(rng, 5)} {long} Xq {prose(rng, 5)} q@y.com {prose(rng, 12)}") for i in range(4)]
    first = spelled(spark, plain + named)
    assert all(marks(first, long)) and all(marks(first, "Xq"))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(first) == sorted(spelled(spark, plain + named))


def test_very_many_matches_in_a_text(spark):
    n = 100_000
    body = "é" + "a1@b.co 10.0.0.1 " * n
    held = docs(spark, [body]).withColumn("spans", pii.base_spans(F.col("text"))).cache()
    r = held.select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("end"), pii.mask_spans(F.col("text"), F.col("spans")).alias("masked")).first()
    assert (r["n"], r["end"], r["masked"]) == (2 * n, len(body) - 1, "é" + "[EMAIL] [IP] " * n)
    held.unpersist()
    got = pii.mask_pii(docs(spark, ["é" + "a1@b.co 10.0.0.1 " * 3000, "x"])).orderBy("doc_id").collect()
    assert got[0]["text"] == "é" + "[EMAIL] [IP] " * 3000 and got[1]["text"] == "x"


def test_running_folds_equal_a_loop(spark):
    from itertools import accumulate

    from docframe.functions.arrays import running

    rng = random.Random(1)
    for n in (0, 1, 255, 256, 257, 1000):
        values = [rng.randrange(100) for _ in range(n)]
        r = spark.createDataFrame([(values,)], "v array<long>").select(running(F.col("v")).alias("s"), running(F.col("v"), F.greatest).alias("m")).first()
        assert r["s"] == [0, *accumulate(values)][:n] and r["m"] == [0, *accumulate(values, max)][:n]


def test_overlapping_spans_mask_once(spark):
    got = pii.mask_pii(docs(spark, ["call +4111 1111 1111 1111 or 10.0.0.1@a.b", None])).orderBy("doc_id").collect()
    assert got[0]["text"].count("[") == 2 and "1111" not in got[0]["text"] and got[1]["text"] is None


# --- quality ---


def test_measures_and_verdict(spark):
    rng = random.Random(8)
    texts = [None, "", "a b c a b c a b c", "x\x0by\x1cz é # | <b>", *(text(rng, 80, 30) + "\n" + text(rng, 5, 2) + "\n\n" for _ in range(30)), text(rng, 80, 900), "#a " * 60, ("SHOUT " + text(rng, 9)).upper() * 9]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts), measures=True).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][m] for m in quality_rules.MEASURES) == brute.measures(t or ""), repr(t)
        m = quality_rules.Measures(t or "")
        assert got[i]["kept"] == (not any(r.rejects(m) for r in quality_rules.RULES))
    plain = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs(spark, texts)).collect()}
    assert plain == {i: r["kept"] for i, r in got.items()}
    assert quality_rules.quality_rules(docs(spark, texts).limit(0)).count() == 0


def test_a_rejected_text_runs_no_further_rule(spark):
    seen = []

    class Watched(quality_rules.Measures):
        def __getattribute__(self, name):
            if name.startswith("n_") or name == "word_chars":
                seen.append(name)
            return super().__getattribute__(name)

    order = [r for n in ("shouting", "too_few_words", "few_letters") for r in quality_rules.RULES if r.name == n]
    assert quality_rules.cascade(Watched("LOUD WORDS"), tuple(order)) == (1, "shouting")
    assert set(seen) == {"n_upper_words", "n_words"} and "n_marks" not in seen
    assert quality_rules.cascade(Watched("soft " * 60), tuple(order)) == (3, None)
    good = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{'qrst'[i % 4]}" for i in range(80))
    texts = [good, "too short", "1.5 2,3 " * 40, "\n".join(f"- item {w}" for w in good.split()), "\n".join(f"{w} and so on..." for w in good.split()), None]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts), measures=True).collect()}
    n = len(quality_rules.RULES)
    assert (got[0]["kept"], got[0]["rules_run"], got[0]["rejected_by"]) == (True, n, None)
    for i in range(1, len(texts)):
        by = [r.name for r in quality_rules.RULES if r.rejects(quality_rules.Measures(texts[i] or ""))]
        assert not got[i]["kept"] and got[i]["rejected_by"] in by and got[i]["rules_run"] <= n - len(by) + 1, i


def test_big_and_null_ids_pass_through_the_rules(spark):
    got = quality_rules.quality_rules(frame(spark, [(2**60 + 1, "x", "k", 1, 2), (None, "x", "k", None, 2)]), measures=True).collect()
    assert {(r["doc_id"], r["spans"], r["kept"]) for r in got} == {(2**60 + 1, 1, False), (None, None, False)}


def test_rules_run_by_rejection_per_cost():
    profile = [{"rule": "shouting", "cost": 1.0, "selectivity": 0.9}, {"rule": "too_few_words", "cost": 0.1, "selectivity": 0.2}]
    assert [r.name for r in quality_rules.cascade_order(profile)][:2] == ["too_few_words", "shouting"]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 60, 300) if i % 4 else " ".join(f"w{rng.randrange(300)}###" for _ in range(60)), int(i % 4 > 0)) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None, None), (601, "", None), (1, rows[1][1], None)], "doc_id long, text string, quality int")
    model = quality_fm.train(df, df.where("doc_id < 400"))
    scores = {r["doc_id"]: r["score"] for r in quality_fm.quality_scores(df, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 602
    held = [(scores[i], q) for i, _, q in rows if i >= 400]
    assert sum((s >= 0.3) == q for s, q in held) / len(held) > 0.97
    assert quality_fm.quality_scores(df.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, rows[1][1], 7), (2**60 + 1, rows[1][1], 7), (3, rows[1][1], None), (3, "", -4)], "doc_id long, text string, n_chars long")
    got = quality_fm.quality_scores(odd, model).collect()
    assert {r["doc_id"] for r in got} == {None, 2**60 + 1, 3} and len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    none = quality_fm.train(df, df.limit(0))
    assert {r["score"] for r in quality_fm.quality_scores(df.limit(5), none).collect()} == {0.5}


def test_factorisation_learns_what_no_single_feature_tells():
    """Exclusive or of two words: only their interaction separates the classes."""
    import numpy as np

    rows, y = [], []
    rng = np.random.default_rng(1)
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.array([0.7, 0.7])))
        y.append(int(a != b))
    model = quality_fm.fit(rows, y)
    scores = quality_fm.score_rows(model, rows)
    assert ((scores > 0.5) == np.array(y, bool)).mean() > 0.95
    flat = model | {"v": np.zeros_like(model["v"])}
    assert ((quality_fm.score_rows(flat, rows) > 0.5) == np.array(y, bool)).mean() < 0.8


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    model = {"w0": 0.1, "w": rng.normal(size=quality_fm.SIZE), "v": rng.normal(size=(quality_fm.SIZE, quality_fm.FACTORS)) * 0.1}
    i, x = np.array([3, 9, 40]), np.array([0.5, 1.0, 0.2])
    pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    raw = 0.1 + model["w"][i] @ x + pairs
    assert abs(quality_fm.score_rows(model, [(i, x)])[0] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
