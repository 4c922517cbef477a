"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Only a document longer than a sequence is cut, into full pieces behind a first
shorter one. Full pieces fill sequences of their own. The others are dealt to
islands of bounded size, each with a population of solutions; a solution is a
list of bins. Crossover injects well-filled bins of one parent into another,
drops the bins that now hold a document twice, and fits the displaced documents
anew: first into kept bins, where one or two of them may change places with one
or two documents of a bin that they fill better, then best fit into new bins. A
child takes the place of the worst solution if it is better (fewer bins, then the
sum of squared fills); an island ends at its lower bound or when no generation of
a set number has gained.

After a round full bins are settled, but for an elite of them, which migrates with
all other bins, whole, to fewer islands. What arrives on an island is a solution
already and joins its population, so a round never loses what an earlier one won.

Documents of equal length are interchangeable, so a solution counts lengths
rather than documents, which keeps every step small.

Defined results: null and empty texts hold only the end id; repeated rows and
repeated ids are packed as rows of their own (numbered by ``row``); an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm import tokens
from docframe.llm.common import Scratch, bounded_batches, frugal, text_of

CAPACITY = 1024
#: Documents on an island of the first round, about; twice as many on those of each further round.
ISLAND = 4096
#: Of full bins one in so many migrates.
ELITE = 50
POPULATION, GENERATIONS = 8, 300
#: Generations without a gain after which an island ends, in the last round and in those before it, whose open bins go on anyway.
PATIENCE, PATIENCE_BEFORE = 24, 8
#: Shares of the bins, worst and random ones alike, that a mutation may break up.
BROKEN = (0.02, 0.06, 0.2)
ROUNDS = 3

Bins = list[tuple[int, ...]]


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""
    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            texts, keys = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in tokens.runs(texts):
                ids, cut = tokens.encode_run(path, texts[i:j])
                ids = np.insert(ids, cut[1:], end_id).astype("<u4")
                cut = cut + np.arange(len(cut))
                total = np.diff(cut)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = (total - (n - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                # pieces follow one another in the ids, so their bounds are all that is needed
                bounds = np.r_[0, np.cumsum(length)].astype(np.int64) * 4
                held = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(i + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), held.cast(pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return picked.mapInArrow(frugal(batches), f"doc_id {kind}, piece int, start long, length long, ids binary")


# --- one island: solutions over counts of lengths ---


def best_fit(counts: list[int], capacity: int) -> Bins:
    """Bins of lengths, filled from the longest down, each time with the longest that fits.

    Taking the longest that fits into the open bin equals best fit over the
    lengths left; ``counts`` is used up.
    """
    bins: Bins = []
    sizes = [s for s in range(len(counts) - 1, 0, -1) if counts[s]]
    while sizes:
        room, held, k = capacity, [], 0
        while room and k < len(sizes):
            size = sizes[k]
            take = min(counts[size], room // size)
            if take:
                counts[size] -= take
                held += [size] * take
                room -= size * take
                while k < len(sizes) and (sizes[k] > room or not counts[sizes[k]]):
                    k += 1
            else:
                k += 1
        bins.append(tuple(held))
        sizes = [s for s in sizes if counts[s]]
    return bins


def pair_sums(loose: list[int]) -> tuple[list[int], list[int]]:
    """For each total the largest sum up to it of one or two loose lengths, and for each such sum one of the lengths."""
    counts = np.array(loose)
    sizes = np.flatnonzero(counts)
    one = np.zeros(len(counts), np.int64)
    pair = sizes[:, None] + sizes[None, :]
    pair[np.diag_indices(len(sizes))] = np.where(counts[sizes] > 1, 2 * sizes, len(counts))
    fits = pair < len(counts)
    one[pair[fits]] = np.broadcast_to(sizes[:, None], pair.shape)[fits]
    one[sizes] = sizes
    return np.maximum.accumulate(np.where(one > 0, np.arange(len(counts)), 0)).tolist(), one.tolist()


def exchange(bins: Bins, loose: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Bins that loose lengths fill better: one or two go in, for none, one or two of the bin's own."""
    best, one = pair_sums(loose)
    out = []
    for k in rng.permutation(len(bins)):
        held, room = bins[k], capacity - sum(bins[k])
        while room and best[capacity]:
            drops = {(), *((x,) for x in held), *itertools.combinations(held, 2)}
            gain, drop = max((best[room + sum(d)] - sum(d), d) for d in drops)
            if gain <= 0:
                break
            total = best[room + sum(drop)]
            rest = list(held)
            for x in drop:
                rest.remove(x)
                loose[x] += 1
            for x in (one[total], total - one[total]):
                if x:
                    rest.append(x)
                    loose[x] -= 1
            held, room = tuple(sorted(rest, reverse=True)), room - gain
            best, one = pair_sums(loose)
        out.append(held)
    return out


def refit(bins: Bins, loose: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A whole solution from bins that stay and lengths that were displaced."""
    return exchange(bins, loose, capacity, rng) + best_fit(loose, capacity)


def crossover(a: Bins, b: Bins, counts: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``b`` injected into ``a``, whose bins that hold a document twice over then go."""
    good = sorted(b, key=sum, reverse=True)[: -(-len(b) // 2)]
    injected = [good[i] for i in rng.permutation(len(good))[: max(1, len(good) // 3)]]
    left, child = list(counts), []
    for x in injected + sorted(a, key=sum, reverse=True):
        for k, size in enumerate(x):
            left[size] -= 1
            if left[size] < 0:
                for taken in x[: k + 1]:
                    left[taken] += 1
                break
        else:
            child.append(x)
    return refit(child, left, capacity, rng)


def mutate(a: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Break up the worst bins and a few random ones and fit their documents anew."""
    order = sorted(a, key=sum)
    few = max(1, int(len(order) * rng.choice(BROKEN)))
    broken = {*range(few), *rng.choice(len(order), few).tolist()}
    loose = [0] * (capacity + 1)
    for i in broken:
        for size in order[i]:
            loose[size] += 1
    return refit([x for i, x in enumerate(order) if i not in broken], loose, capacity, rng)


def fitness(bins: Bins) -> tuple[int, int]:
    """Less is better: bins, then the squares of their fills."""
    return len(bins), -sum(sum(b) ** 2 for b in bins)


def evolve(lengths: np.ndarray, capacity: int, seed: int, arrived: Bins | None = None, patience: int = PATIENCE) -> list[list[int]]:
    """Bins of lengths for one island; ``arrived`` is a solution that migrated here."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    bound = -(-int(lengths.sum()) // capacity)
    people = [best_fit(list(counts), capacity), *([arrived] if arrived else [])]
    people = sorted(((fitness(p), p) for p in people), key=lambda x: x[0])
    still = 0
    for _ in range(GENERATIONS):
        if people[0][0][0] <= bound or still >= patience:
            break
        if len(people) < POPULATION:
            child = mutate(people[0][1], capacity, rng)
        else:
            a, b = rng.choice(POPULATION // 2, 2, replace=False)
            child = crossover(people[a][1], people[b][1], counts, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, capacity, rng)
        made = (fitness(child), child)
        still = 0 if made[0] < people[0][0] else still + 1
        if all(made[0] != p[0] for p in people):
            people = sorted([*people, made], key=lambda x: x[0])[:POPULATION]
    return [list(b) for b in people[0][1]]


def place(frame: pd.DataFrame, capacity: int, seed: int, patience: int) -> pd.DataFrame:
    """Adds bin (number on the island), offset and fill to the island's rows (row, length, home)."""
    order = frame.sort_values(["length", "row"], kind="stable").reset_index(drop=True)
    lengths = order["length"].to_numpy()
    arrived = [tuple(x) for x in order.groupby("home")["length"].agg(list)]  # none in the first round: no row has a home
    bins = evolve(lengths, capacity, seed, arrived, patience)
    first = np.searchsorted(lengths, np.arange(capacity + 2))
    used = np.zeros(capacity + 2, np.int64)
    where, offset, fill = (np.empty(len(order), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        at, total = 0, sum(b)
        for size in b:
            i = first[size] + used[size]
            used[size] += 1
            where[i], offset[i], fill[i] = k, at, total
            at += size
    return order[["row", "length", "island"]].assign(bin=where, offset=offset, fill=fill)


def _on_island(capacity: int, salt: int, patience: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return place(frame, capacity, 7919 * salt + int(frame["island"].iloc[0]), patience)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with ``length`` up to the capacity) with sequence_id and offset.

    Columns other than ``length`` are carried along.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    names = pieces.columns
    rows = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") >= capacity).select(*names, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.where(F.col("length") < capacity).select("row", "length", F.lit(None).cast("long").alias("home"))
    placed = []
    for r in range(rounds + 1):
        n = todo.count()
        if not n:
            break
        islands = -(-n // (island << r))
        dealt = todo.withColumn("island", F.pmod(F.xxhash64(F.coalesce("home", "row"), F.lit(r)), F.lit(islands)))
        # the rows are few bytes and the work is long, so partitions follow the islands, not the bytes
        dealt = dealt.repartition(min(islands, tasks), "island").groupBy("island")
        last = r == rounds or islands == 1
        evolved = _on_island(capacity, r, PATIENCE if last else PATIENCE_BEFORE)
        done = dealt.applyInPandas(evolved, "row long, length long, island long, bin long, offset long, fill long")
        number = F.shiftleft(F.col("bin") * (rounds + 1) + r, 36) + F.col("island")
        done = scratch.keep(done.withColumn("sequence_id", number), f"round{r}")
        kept = F.lit(True) if last else (F.col("fill") >= capacity) & (F.col("bin") % ELITE != 0)
        placed.append(done.where(kept).select("row", "sequence_id", "offset"))
        todo = done.where(~kept).select("row", "length", F.col("sequence_id").alias("home"))
    if not placed:
        return full
    all_placed = placed[0]
    for p in placed[1:]:
        all_placed = all_placed.unionAll(p)
    part = rows.where(F.col("length") < capacity).join(all_placed, "row").select(*names, "sequence_id", "offset")
    return full.unionAll(part)
