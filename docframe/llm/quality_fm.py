"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score of a text with features x is
``sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).(x^2)))``, the sum-of-squares
identity of the pairwise interactions, linear in the number of features. It is
fitted by mini-batch AdaGrad in one task on at most ``TRAIN_ROWS`` labelled rows
(those with the least hash of their id), and applied to all rows in Arrow batches.

Inputs are hashed lower-cased words (counts damped by a logarithm, to unit
length), bucketed statistics of the text's structure, and one number of metadata
(``n_chars`` by default, a bucket of its own where it is missing). Labels,
language, source and id are never features.

Features are made where the texts are, so the task that fits sees at most
``BUCKETS`` numbers of each labelled row, however long its text.

Defined results: null reads as empty, which scores by its statistics; repeated
rows score alike; a null or missing label is not learnt from; with no labelled
row every score is 0.5; an empty table gives an empty table; a table without the
metadata column counts as one where it is null; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import text_of

BUCKETS = 1 << 14
STATS = 10
BINS = 16
FACTORS = 4
#: Bound of the sample of labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.1, 1e-5
SIZE = BUCKETS + (STATS + 1) * BINS
METADATA = "n_chars"


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    """Shares and sizes between 0 and 1 that describe the structure of a text."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>@=_~^"))
    return [
        min(1.0, math.log1p(len(words)) / 10),
        min(1.0, (len(text) / n) / 16),
        min(1.0, symbols / n / 2),
        min(1.0, (text.count("!") + text.count("?")) / n),
        1 - len(set(lines)) / max(1, len(lines)),
        distinct / n,
        sum(map(str.isupper, words)) / n,
        min(1.0, sum(map(text.count, "0123456789")) / chars * 4),
        min(1.0, (text.count(".") + text.count(",")) / n * 2),
        min(1.0, math.log1p(len(lines)) / 7),
    ]


_BUCKET: dict[str, int] = {}


def bucket(word: str) -> int:
    found = _BUCKET.get(word)
    if found is None:
        if len(_BUCKET) > 300_000:
            _BUCKET.clear()
        found = _BUCKET[word] = zlib.crc32(word.encode()) % BUCKETS
    return found


def features(text: str, metadata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a text and of its number of metadata."""
    words = text.split()
    counts = Counter(map(bucket, text.lower().split()))
    index = np.fromiter(counts.keys(), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = math.sqrt(float(value @ value)) or 1.0
    stats = statistics(text, words, len(set(words)))
    bins = [min(BINS - 1, int(s * BINS)) for s in stats]
    bins.append(BINS - 1 if metadata is None else min(BINS - 2, int(math.log1p(max(0.0, metadata)))))
    return np.r_[index, BUCKETS + np.arange(STATS + 1) * BINS + bins], np.r_[value / norm, np.full(STATS + 1, 0.5)]


def score_rows(model: dict, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of rows of features, all at once."""
    if not rows:
        return np.empty(0)
    cut = np.cumsum([0] + [len(i) for i, _ in rows])[:-1]
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    linear = np.add.reduceat(model["w"][index] * value, cut)
    sums = np.add.reduceat(model["v"][index] * value[:, None], cut)
    squares = np.add.reduceat((model["v"][index] * value[:, None]) ** 2, cut)
    raw = model["w0"] + linear + 0.5 * (sums**2 - squares).sum(1)
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 1) -> dict:
    """A model fitted on labelled rows of features, in the order given."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(SIZE), "v": rng.normal(0, 0.05, (SIZE, FACTORS))}
    if not rows:
        return model | {"v": np.zeros((SIZE, FACTORS))}
    y = np.array(labels, float)
    share = min(max(y.mean(), 0.01), 0.99)
    model["w0"] = math.log(share / (1 - share))
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            batch = [rows[i] for i in part]
            error = score_rows(model, batch) - y[part]
            each = np.repeat(np.arange(len(batch)), [len(i) for i, _ in batch])
            index, value = np.concatenate([i for i, _ in batch]), np.concatenate([v for _, v in batch])
            cut = np.searchsorted(each, np.arange(len(batch)))
            vx = model["v"][index] * value[:, None]
            sums = np.add.reduceat(vx, cut)
            e = error[each]
            dv = (e * value)[:, None] * (sums[each] - vx)
            used, where = np.unique(index, return_inverse=True)
            grad_w, grad_v = np.bincount(where, e * value), np.stack([np.bincount(where, dv[:, f]) for f in range(FACTORS)], 1)
            grad_w, grad_v = grad_w / len(batch) + DECAY * model["w"][used], grad_v / len(batch) + DECAY * model["v"][used]
            g0 += error.mean() ** 2
            gw[used] += grad_w**2
            gv[used] += grad_v**2
            model["w0"] -= RATE * error.mean() / math.sqrt(g0)
            model["w"][used] -= RATE * grad_w / np.sqrt(gw[used])
            model["v"][used] -= RATE * grad_v / np.sqrt(gv[used])
    return model


def _picked(docs: DataFrame, id_column: str, text_column: str, metadata: str | None) -> DataFrame:
    number = F.col(metadata).try_cast("double") if metadata in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), number.alias("number"))


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, number in zip(b.column("text"), b.column("number"), strict=True):
        yield features(text.as_py(), number.as_py())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", metadata: str | None = METADATA) -> dict:
    """The model of at most ``rows`` labelled rows of ``docs``; fitted in one task, a few hundred KB in size."""
    known = labels.where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).alias("__label"))
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    sample = _picked(docs, id_column, text_column, metadata).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    sample = sample.select("text", "number", F.col("__label").cast("int").alias("label"), F.crc32("text").alias("h"), F.xxhash64("doc_id").alias("h2"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(_rows(b))
            held = [pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("h2"), b.column("label"), *held], ["h", "h2", "label", "index", "value"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, marks = [], []
        for f in frames:
            found += [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(f["index"], f["value"], strict=True)]
            marks += f["label"].tolist()
        m = fit(found, marks)
        yield pd.DataFrame({"w0": [m["w0"]], "w": [m["w"].astype("<f8").tobytes()], "v": [m["v"].astype("<f8").tobytes()]})

    spelled = sample.mapInArrow(spell, "h long, h2 long, label int, index binary, value binary")
    got = spelled.repartition(1).sortWithinPartitions("h", "h2", "label").mapInPandas(run, "w0 double, w binary, v binary").collect()
    if not got:  # Spark leaves out the task of an empty sample
        return fit([], [])
    return {"w0": got[0]["w0"], "w": np.frombuffer(got[0]["w"], "<f8"), "v": np.frombuffer(got[0]["v"], "<f8").reshape(SIZE, FACTORS)}


def quality_scores(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", metadata: str | None = METADATA) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; the model is small and fixed in size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    picked = _picked(docs, id_column, text_column, metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_rows(sent.value, list(_rows(part))), pa.float64())], ["doc_id", "score"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
