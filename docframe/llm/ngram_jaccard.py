"""N-gram Jaccard join by a token-group matrix: exact components of near-duplicate texts.

1. Every text becomes its set of word shingles (64-bit hashes). A first pass
   counts shingles over all texts into two tables of fixed size: which shingles
   may occur twice, and how frequent the frequent ones are.
2. A second pass orders each set from rare to frequent. Two texts that reach the
   threshold share a shingle among the first ``n - ceil(t n) + 1`` of this order,
   whatever the tables say, so only those, less the ones that occur once, are
   kept. Texts of equal sets are one node from here on. A third table, over the
   kept shingles of nodes alone and by other bits of the hash, drops those that
   occur once among them; it fills up far later than the first. Sets are made
   again, and kept, for nodes only that truly share a kept shingle with another.
3. Each node joins the group of the node with whom it shares most of these
   shingles and which holds the fewest shingles of its own; a link to it is
   checked exactly. Linked nodes are one component already and need no more
   checks among themselves.
4. The token-group matrix holds, for blocks of a bounded number of a group's
   nodes, which kept shingles occur there. A node queries the blocks where a
   larger component shares a shingle. In a block the union of its sets bounds the
   overlap; only if the bound reaches the threshold is the block opened and the
   node counted against every set in it, exactly. One link to each further
   component is kept.
5. Components of all links follow by stars.

Joins on shingles, and on the digests that copies share, deal hot keys to several
tasks.

The tables steer the order only; results are exact at any size (but for
collisions of 64-bit hashes within a pair of sets, and 128-bit set digests).

Defined results: null reads as empty; a text without words has no shingles and
is its own component; fewer words than a shingle form one; rows with a null id
link with nothing and have a null component; rows that share an id are rows of
their own; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm import tokens
from docframe.llm.common import Scratch, bounded_batches, components, frugal, join_salted, numbered, text_of

#: Characters of text turned to shingles together.
RUN_CHARS = 2_000_000
#: The tables: 2^27 bits for shingles seen twice, 2^22 bytes for levels of frequency; 20 MB whatever the input.
RANGES, SEEN_BITS, LEVEL_BITS = 256, 27, 22
#: A shingle in this many texts or more has a level, one more for each doubling.
FREQUENT = 8
#: Nodes in a block of a group, and queries that meet a block in one task, at most about.
BLOCK, QUERIES = 512, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    parts = pc.ascii_split_whitespace(low)
    coded = parts.values.dictionary_encode()
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = words[coded.indices.to_numpy()]
    bounds = parts.offsets.to_numpy()
    blank = pc.equal(low, "").to_numpy(zero_copy_only=False)
    if len(flat) >= n:
        rolled = np.zeros(len(flat) - n + 1, np.uint64)
        for k in range(n):
            rolled = _mix(rolled + flat[k : len(flat) - n + 1 + k])
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if blank[i]:
            out.append(np.empty(0, np.uint64))
        elif b - a < n:
            short = np.zeros(1, np.uint64)
            for w in flat[a:b]:
                short = _mix(short + w)
            out.append(_mix(short + np.uint64(b - a)))
        else:
            out.append(np.unique(rolled[a : b - n + 1]))
    return out


# --- pass 1: how often shingles occur ---


def pack_tokens(found: np.ndarray) -> np.ndarray:
    """Sorted 32-bit numbers as 16-bit gaps; 65535 adds to the gap without ending it."""
    gap = np.diff(found.astype(np.int64), prepend=0)
    wide = gap // 65535
    out = np.full(len(gap) + int(wide.sum()), 65535, np.uint16)
    out[np.cumsum(wide + 1) - 1] = gap % 65535
    return out


def unpack_tokens(packed: np.ndarray) -> np.ndarray:
    return np.cumsum(packed, dtype=np.int64)[packed != 65535]


class RangeCounts:
    """How often each number of a range of 2^24 was added; dense only once many were. ``least`` of a number set its bit."""

    def __init__(self, least: int = 2):
        self.least = least
        self.held: list[np.ndarray] = []
        self.size, self.dense = 0, None

    def add(self, found: np.ndarray) -> None:
        self.held.append(found)
        self.size += len(found)
        if self.size > 1 << 22:
            if self.dense is None:
                self.dense = np.zeros(1 << 24, np.uint32)
            where, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.dense[where] += times.astype(np.uint32)
            self.held, self.size = [], 0

    def slices(self) -> tuple[bytes, bytes]:
        """The range's part of both tables."""
        where, times = np.unique(np.concatenate(self.held or [np.empty(0, np.int64)]), return_counts=True)
        if self.dense is not None:
            self.dense[where] += times.astype(np.uint32)
            where = np.flatnonzero(self.dense)
            times = self.dense[where]
        seen, level = np.zeros(1 << (SEEN_BITS - 8), np.uint8), np.zeros(1 << (LEVEL_BITS - 8), np.uint8)
        seen[where[times >= self.least] >> (32 - SEEN_BITS)] = 1
        often = times >= FREQUENT
        np.maximum.at(level, where[often] >> (32 - LEVEL_BITS), (np.log2(times[often] / FREQUENT) + 1).astype(np.uint8))
        return np.packbits(seen).tobytes(), level.tobytes()


def _by_range(numbers: np.ndarray) -> pa.RecordBatch:
    """Rows of a range and what of the 32-bit numbers lies in it, packed."""
    top = np.sort(numbers.astype(np.uint32))
    cut = np.searchsorted(top, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(24))
    rows = [(r, pack_tokens(top[cut[r] : cut[r + 1]] - np.uint32(r << 24)).tobytes()) for r in range(RANGES) if cut[r] < cut[r + 1]]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "packed"])


def squeezed(table: bytes | bytearray) -> bytes:
    """The table, compressed where that is shorter."""
    short = pa.compress(table, codec="zstd", asbytes=True)
    return short if len(short) < len(table) else bytes(table)


def unsqueezed(table: bytes, size: int) -> np.ndarray:
    """The bytes of a squeezed table, which are so many."""
    return np.frombuffer(table if len(table) == size else pa.decompress(table, size, codec="zstd"), np.uint8)


def _tables(packed: DataFrame, least: int = 2) -> tuple[bytearray, bytearray]:
    """The two tables of all packed numbers; their size is fixed. Pieces come squeezed, and the driver holds the tables once, beside the pieces not yet put in."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, counts = None, RangeCounts(least)
        for f in frames:
            for p, packed in zip(f["part"], f["packed"], strict=True):
                if p != part:
                    if part is not None:
                        yield _table_row(part, counts)
                    part, counts = p, RangeCounts(least)
                counts.add(unpack_tokens(np.frombuffer(packed, np.uint16)))
        if part is not None:
            yield _table_row(part, counts)

    rows = packed.repartition("part").sortWithinPartitions("part").mapInPandas(frugal(count), "part int, seen binary, level binary").collect()
    seen, level = bytearray(1 << (SEEN_BITS - 3)), bytearray(1 << LEVEL_BITS)
    while rows:
        r = rows.pop()
        for table, piece in ((seen, r["seen"]), (level, r["level"])):
            size = len(table) // RANGES
            table[r["part"] * size : (r["part"] + 1) * size] = unsqueezed(piece, size).data
    return seen, level


def _seen(table: bytes) -> np.ndarray:
    """The squeezed first table as its tasks read it."""
    return unsqueezed(table, 1 << (SEEN_BITS - 3))


def _bits(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit numbers are set."""
    bit = (numbers >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
    return ((table[bit >> 3] >> (7 - (bit & 7))) & 1).astype(bool)


def shingle_tables(texts: DataFrame, n: int) -> tuple[bytearray, bytearray]:
    """The two tables over all texts."""

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            held = b.column("text").to_pylist()
            for i, j in tokens.runs(held, RUN_CHARS):
                yield _by_range(np.concatenate(shingle_sets(held[i:j], n)) >> np.uint64(32))

    return _tables(texts.mapInArrow(frugal(split), "part int, packed binary"))


def _flat(b: pa.RecordBatch) -> np.ndarray:
    return b.column("tokens").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def shared_tokens(heads: DataFrame) -> DataFrame:
    """``heads`` (node, rare, tokens) with the tokens only that may occur in two rows; the bits are others than those of the first table."""

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield _by_range(_other(_flat(b)) >> np.uint64(32))

    table = heads.sparkSession.sparkContext.broadcast(squeezed(_tables(heads.select("tokens").mapInArrow(frugal(split), "part int, packed binary"))[0]))

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _seen(table.value)
        for b in found:
            flat = _flat(b)
            kept = _bits(seen, _other(flat))
            ends = np.cumsum(b.column("tokens").value_lengths().to_numpy(zero_copy_only=False))
            bounds = np.r_[0, np.cumsum(kept)][np.r_[0, ends]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("rare"), lists], ["node", "rare", "tokens"])

    return heads.select("node", "rare", "tokens").mapInArrow(frugal(keep), "node long, rare long, tokens array<long>")


def _other(numbers: np.ndarray) -> np.ndarray:
    return _mix(_mix(numbers + _MIX))


def _table_row(part: int, counts: RangeCounts) -> pd.DataFrame:
    seen, level = counts.slices()
    return pd.DataFrame({"part": [part], "seen": [squeezed(seen)], "level": [squeezed(level)]})


# --- pass 2: sets and the shingles that candidates must share ---


def least_overlap(n, num: int, den: int):
    """The least overlap of a set of n with any set that reaches the threshold num / den."""
    return -(-num * n // den)


def document_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, Broadcast]:
    """The tables as they are sent to tasks, and doc_id, digest, n, rare (shingles of its own) and tokens (shared ones of the prefix)."""
    tables = docs.sparkSession.sparkContext.broadcast([squeezed(t) for t in shingle_tables(docs.select("text"), n)])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, level = _seen(tables.value[0]), unsqueezed(tables.value[1], 1 << LEVEL_BITS)
        for b in found:
            held = b.column("text").to_pylist()
            for i, j in tokens.runs(held, RUN_CHARS):
                sets = shingle_sets(held[i:j], n)
                rows = [_prefix(u, seen, level, num, den) for u in sets]
                made = [
                    b.column("doc_id").slice(i, j - i),
                    pa.array([_digest(u) for u in sets], pa.binary()),
                    pa.array([len(u) for u in sets], pa.int64()),
                    pa.array([r for r, _ in rows], pa.int64()),
                    pa.array([t.view(np.int64) for _, t in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "digest", "n", "rare", "tokens"])

    return docs.mapInArrow(frugal(run), f"doc_id {kind}, digest binary, n long, rare long, tokens array<long>"), tables


def chosen_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """node and shingles of the chosen rows (digest, doc_id, node); a table of bits keeps nearly all other texts from being read to sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("doc_id").alias("key")
    number = lambda b: b.column("key").to_numpy().view(np.uint64)

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield _by_range(number(b) >> np.uint64(32))

    table = docs.sparkSession.sparkContext.broadcast(squeezed(_tables(chosen.select(key).mapInArrow(frugal(split), "part int, packed binary"), 1)[0]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _seen(table.value)
        for b in found:
            b = b.filter(pa.array(_bits(seen, number(b))))
            held = b.column("text").to_pylist()
            for i, j in tokens.runs(held, RUN_CHARS):
                sets = shingle_sets(held[i:j], n)
                digests = pa.array([_digest(u) for u in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), digests, pa.array([u.tobytes() for u in sets], pa.binary())], ["doc_id", "digest", "shingles"])

    made = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", key).mapInArrow(frugal(run), f"doc_id {kind}, digest binary, shingles binary")
    # rows that share id and text are one; grouped as they are joined, so that sets are shuffled once
    return made.join(chosen, ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select("node", "shingles")


def _digest(u: np.ndarray) -> bytes:
    return hashlib.sha256(u.tobytes()).digest()[:16]


def _prefix(u: np.ndarray, seen: np.ndarray, level: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """Number of shingles that occur once, and those of the prefix that may occur more often."""
    if not len(u):
        return 0, u
    shared = _bits(seen, u)
    rare = len(u) - int(shared.sum())
    room = len(u) - least_overlap(len(u), num, den) + 1 - rare
    if room <= 0:
        return rare, u[:0]
    rest = u[shared]
    order = np.argsort(level[(rest >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)], kind="stable")
    return rare, rest[order[:room]]


# --- groups, blocks and links ---


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both) and both > 0


def _check_pairs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, with sets x, y) that reach the threshold."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in found:
            keep = []
            for x, y in zip(p.column("x"), p.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if den * len(small) < num * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(linked(len(x), len(y), both, num, den))
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def open_block(members: pd.DataFrame, queries: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links between components from queries to members of one block: at most one a query and component."""
    if not len(members) or not len(queries):
        return []
    sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
    sizes, comps = np.array([len(s) for s in sets]), members["ord"].to_numpy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    union, first = np.unique(flat[order], return_index=True)
    bounds = np.r_[first, len(flat)]
    owner = owner[order]
    found = []
    for own, raw in zip(queries["own"], queries["asked"], strict=True):
        q = np.frombuffer(raw, np.uint64)
        at = np.searchsorted(union, q)
        hit = at[union[np.minimum(at, len(union) - 1)] == q]
        fits = (den * sizes >= num * len(q)) & (den * len(q) >= num * sizes) & (comps > own)
        if not fits.any() or den * len(hit) < num * (len(q) + sizes[fits].min() - len(hit)):
            continue  # the union's overlap is too small for any set of the block
        lists = [owner[bounds[h] : bounds[h + 1]] for h in hit]
        both = np.bincount(np.concatenate(lists), minlength=len(sets))
        near = fits & (den * both >= num * (len(q) + sizes - both))
        found += [(int(own), int(c)) for c in np.unique(comps[near])]
    return found


def _open(num: int, den: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(set(open_block(members, queries, num, den))), columns=["a", "b"]).astype("int64")

    return run


#: Bits of a component's order that hold its number; its size stands above them.
_ORD = 41


def near_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every row."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "ngram-jaccard")
    picked = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    made, tables = document_sets(picked, n, num, den)
    sets = scratch.keep(made, "sets")
    tables.destroy()
    holders = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = scratch.keep(numbered(holders, "node", scratch, "numbered"), "reps")
    # by id too, so that the copies of one text do not meet in one task
    heads = sets.where(F.size("tokens") > 0).select("doc_id", "digest", "rare", "tokens").join(reps.select("digest", F.col("rep").alias("doc_id"), "node"), ["digest", "doc_id"])
    heads = scratch.keep(heads.dropDuplicates(["digest", "doc_id"]).select("node", "rare", "tokens"), "heads")
    posts = scratch.keep(shared_tokens(heads).select("node", "rare", F.explode("tokens").alias("token")), "asked")
    scratch.drop("heads")
    lead = posts.groupBy("token").agg(F.min_by("node", "rare").alias("leader"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("count")).where(F.col("lo") < F.col("hi"))
    lead = scratch.keep(lead.select("token", "leader", "count"), "lead")
    total = lead.agg(F.sum("count")).first()[0] or 0
    posts = scratch.keep(join_salted(posts, lead.select("token", "leader"), lead, ["token"], total, ["node"]), "posts")
    scratch.drop("asked")
    scratch.drop("lead")
    # a node's group is that of the leader it meets most often
    votes = posts.groupBy("node", "leader").count()
    group = scratch.keep(votes.groupBy("node").agg(F.max_by("leader", "count").alias("g")), "groups")
    chosen = reps.join(group.select("node"), "node").select("digest", F.col("rep").alias("doc_id"), "node")
    sized = scratch.keep(chosen_sets(picked, scratch.keep(chosen, "chosen"), n), "shingles")
    stars = group.where(F.col("node") != F.col("g")).select(F.col("node").alias("a"), F.col("g").alias("b"))
    x = sized.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sized.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    links = scratch.keep(_check_pairs(stars.join(x, "a").join(y, "b"), num, den), "links")
    root = scratch.keep(components(links, scratch, "stars"), "roots")
    member = group.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    size = member.groupBy("root").agg(F.count("*").alias("size"))
    order = F.shiftleft(F.least("size", F.lit((1 << (62 - _ORD)) - 1)), _ORD) + F.col("root")
    member = member.join(size, "root").withColumn("ord", order)
    blocks = member.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = member.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    member = scratch.keep(member.select("node", "g", "block", "ord", "root"), "members")
    # the token-group matrix, for shingles that two components share
    spread = posts.select("token", "node").join(member.select("node", "g", "block", "ord"), "node")
    spread = scratch.keep(spread, "placed")
    top = spread.groupBy("token").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("count")).where(F.col("lo") < F.col("hi"))
    top = scratch.keep(top, "top")
    total = top.agg(F.sum("count")).first()[0] or 0
    spread = scratch.keep(join_salted(spread, top.select("token", "hi"), top, ["token"], total, ["node"]), "spread")
    scratch.drop("placed")
    matrix = spread.groupBy("token", "g", "block").agg(F.max("ord").alias("most"))
    asks = spread.where(F.col("ord") < F.col("hi")).select("token", F.col("node").alias("q"), F.col("ord").alias("own"))
    asks = join_salted(asks, matrix, top.select("token", "count"), ["token"], total, ["q"]).where(F.col("most") > F.col("own")).select("q", "own", "g", "block").distinct()
    asks = scratch.keep(asks, "asks")
    chunks = asks.groupBy("g", "block").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
    queries = asks.join(chunks, ["g", "block"]).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")))
    queries = queries.join(sized.select(F.col("node").alias("q"), F.col("shingles").alias("asked")), "q")
    queries = queries.select(F.col("g").alias("g2"), F.col("block").alias("block2"), F.col("chunk").alias("chunk2"), "own", "asked")
    opened = member.join(chunks, ["g", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    opened = opened.join(sized, "node").select("g", "block", "chunk", "ord", "shingles")
    more = opened.groupBy("g", "block", "chunk").cogroup(queries.groupBy("g2", "block2", "chunk2")).applyInPandas(_open(num, den), "a long, b long")
    number = F.lit((1 << _ORD) - 1)
    more = more.select(F.col("a").bitwiseAND(number).alias("a"), F.col("b").bitwiseAND(number).alias("b"))
    wider = components(scratch.keep(more.distinct(), "more"), scratch, "wider").select(F.col("node").alias("root"), F.col("root").alias("wide"))
    final = member.join(wider, "root", "left").select("node", F.coalesce("wide", "root").alias("root"))
    named = reps.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = scratch.keep(named.join(least, "root").select("digest", "component_id"), "components")
    scratch.drop_all_but("sets", "components")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    sizes = scratch.keep(rows.groupBy("digest").count().where(F.col("count") > 1), "sizes")
    joined = join_salted(rows, by_set, sizes, ["digest"], rows.count(), ["doc_id"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))
