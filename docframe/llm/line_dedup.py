"""Line dedup: repeated runs of lines, from a suffix array over line ids by prefix doubling.

Lines become ids, and the suffixes of each text's line sequence are named by
their first 1, 2, 4, ... lines. A name stands for an interval of the suffix array
whose suffixes share that prefix (a longest-common-prefix interval) and is
written as the earliest place in it, so no global sort is needed and a suffix
knows whether it comes first. Doubling joins the name at a place with the name
behind it. Descending through the intervals by smaller and smaller powers of two
then finds, for every place, the longest run of lines that also starts at an
earlier place: the maximal repeated runs. A run of at least ``min_words`` words
is deleted at every place but its first.

In the descent an interval is followed by all its suffixes, and its first suffix
also stays behind to stand for them in the wider interval; any run shared with a
later suffix of the narrow interval is shared with its first, which is earlier.

Only lines that occur twice enter, and only stretches of such lines that hold
``min_words`` words together, since nothing shorter can be deleted.

A line that very many texts share is dealt to several tasks in every join on lines
or names.

Everything is DataFrame expressions. Defined results: null text stays null and
has no lines; a text whose lines all go becomes empty; rows equal in id and text
are one document and are edited alike; documents are ordered by id, nulls first,
then by a hash of the text; a text may be as long as a row can be and have 2^28
lines; an empty table gives an empty table; further columns are kept, save one
called ``deleted``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.arrays import let
from docframe.llm.common import Scratch, free_name, join_salted, numbered

#: Words that a repeated run needs to be deleted.
MIN_WORDS = 50
#: Bits of a place that hold the line number; the document's number (up to 2^35) is above them. A text with more lines than that fails the job.
LINE_BITS = 28


def _words(line: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    blank = r"[\x20\t-\r]+"
    bare = F.regexp_replace(line, rf"^{blank}|{blank}$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, blank)))


def _lines(docs: DataFrame) -> DataFrame:
    """i and h (the document), p (line number from 0), two hashes (128 bits) and the words of each line."""
    keys = docs.where(F.col("text").isNotNull()).select("i", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return keys.select("i", "h", "p", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), _words(F.col("line")).alias("w"))


def _shared(rows: DataFrame, key: list[str], name: str, total: int, scratch: Scratch) -> DataFrame:
    """place and key of the rows whose key stands at two places or more, with the earliest of them as ``name``; ``total`` is about the number of rows."""
    first = rows.groupBy(*key).agg(F.min("place").alias(name), F.max("place").alias("__last"), F.count("*").alias("count")).where(F.col(name) < F.col("__last"))
    first = scratch.keep(first.drop("__last"), f"first-{uuid.uuid4().hex}")
    return join_salted(rows, first.drop("count"), first, key, total, ["place"])


def _places(docs: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """place, line id, words and words before it, of every line that may be deleted or have an earlier copy; also i, h, p."""
    lines = _lines(docs)
    twice = scratch.keep(lines.groupBy("a", "b").count().where(F.col("count") > 1), "twice")
    total = twice.agg(F.sum("count")).first()[0] or 0
    rows = join_salted(lines, twice.select("a", "b"), twice, ["a", "b"], total, ["i", "p"], "left_semi")
    rows = scratch.keep(rows.dropDuplicates(["i", "h", "p"]), "lines")
    rows = rows.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy("i", "h").orderBy("p")))
    in_run = Window.partitionBy("i", "h", "run")
    rows = rows.withColumn("all", F.sum("w").over(in_run)).where(F.col("all") >= min_words)
    rows = rows.withColumn("before", F.sum("w").over(in_run.orderBy("p")) - F.col("w"))
    # documents are numbered in their order: partitions of a sorted table hold consecutive ranges
    in_order = numbered(rows.select(F.col("i").alias("__i"), F.col("h").alias("__h")).distinct().orderBy("__i", "__h"), "d", scratch, "order")
    placed = rows.join(in_order, F.col("i").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h")))
    place = F.when(F.col("p") < 1 << LINE_BITS, F.shiftleft("d", LINE_BITS) + F.col("p")).otherwise(F.raise_error(F.lit("a text has too many lines")).cast("long"))
    places = scratch.keep(placed.select(place.alias("place"), "i", "h", "p", "a", "b", "w", "before"), "places")
    for table in ("twice", "lines", "order"):
        scratch.drop(table)
    return places


def _levels(places: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """place and name tables of the first 1, 2, 4, ... lines, as far as any are shared."""
    total = places.count()
    level = scratch.keep(_shared(places.select("place", "a", "b"), ["a", "b"], "name", total, scratch).select("place", "name"), "level0")
    found = []
    while not level.isEmpty():
        found.append(level)
        size = 1 << (len(found) - 1)
        behind = level.select((F.col("place") - size).alias("place"), F.col("name").alias("y"))
        pair = level.withColumnRenamed("name", "x").join(behind, "place")
        level = scratch.keep(_shared(pair, ["x", "y"], "name", total, scratch).select("place", "name"), f"level{len(found)}")
    return found


def repeated_runs(places: DataFrame, scratch: Scratch) -> DataFrame:
    """place and n: the longest run of n lines from a place that also starts at an earlier place."""
    levels = _levels(places, scratch)
    rows, total = None, places.count()
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            higher = levels[k + 1].withColumnRenamed("name", "up")
            level = level.join(higher, "place", "left").where(F.col("up").isNull() | (F.col("up") == F.col("place"))).drop("up")
        level = level.select(F.lit(k).alias("k"), F.lit(1 << k).alias("n"), "name", "place")
        rows = level if rows is None else rows.unionAll(level)
    if rows is None:
        return places.select("place", F.lit(1).alias("n")).limit(0)
    for j in range(len(levels) - 2, -1, -1):
        active = rows.where(F.col("k") > j)
        y = levels[j].select(F.col("place").alias("__at"), F.col("name").alias("y"))
        active = active.join(y, F.col("place") + F.col("n") == F.col("__at"), "left").drop("__at")
        sub = active.where(F.col("y").isNotNull()).groupBy("n", "name", "y").agg(F.min("place").alias("f"), F.max("place").alias("__last"), F.count("*").alias("count"))
        sub = scratch.keep(sub.where(F.col("f") < F.col("__last")).drop("__last"), f"sub{j}")
        active = join_salted(active, sub.drop("count"), sub, ["n", "name", "y"], total, ["place"], "left")
        narrow = F.struct("k", (F.col("n") + (1 << j)).alias("n"), F.col("f").alias("name"), "place")
        wide = F.struct("k", "n", "name", "place")
        both = F.when(F.col("f").isNull(), F.array(wide)).when(F.col("f") == F.col("place"), F.array(wide, narrow)).otherwise(F.array(narrow))
        moved = active.select(F.explode(both).alias("r")).select("r.*")
        rows = scratch.keep(moved.unionAll(rows.where(F.col("k") <= j)), f"descent{j}")
        scratch.drop(f"descent{j + 1}")
    return rows.where(F.col("name") < F.col("place")).groupBy("place").agg(F.max("n").alias("n"))


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """i, h and deleted (sorted line numbers) of documents that lose lines; ``docs`` has i and text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    places = _places(docs, scratch, min_words)
    runs = repeated_runs(places, scratch)
    end = places.select(F.col("place").alias("__end"), (F.col("before") + F.col("w")).alias("upto"))
    start = places.select("place", "before")
    long_runs = runs.join(start, "place").join(end, F.col("place") + F.col("n") - 1 == F.col("__end")).where(F.col("upto") - F.col("before") >= min_words)
    long_runs = long_runs.select("place", (F.col("place") + F.col("n")).alias("stop"))
    reach = F.max("stop").over(Window.partitionBy("i", "h").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    covered = places.join(long_runs, "place", "left").withColumn("reach", reach).where(F.col("reach") > F.col("place"))
    found = scratch.keep(covered.groupBy("i", "h").agg(F.sort_array(F.collect_list("p")).alias("deleted")), "deleted")
    scratch.drop_all_but("deleted")
    return found


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated runs cut from its text, and ``deleted``, the numbers of the lines that went."""
    gone = deleted_lines(docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("text")), min_words)
    i, h, deleted = (free_name(docs, n) for n in ("__i", "__h", "__deleted"))
    gone = gone.select(F.col("i").alias(i), F.col("h").alias(h), F.col("deleted").alias(deleted))
    # the same join at every size: whether the edits happen to be few must not change the plan
    gone = gone.hint("shuffle_hash")
    text = F.col(text_column)
    joined = docs.drop("deleted").join(gone, F.col(id_column).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(deleted))
    cut = let(lines, lambda x: F.array_join(F.transform(kept, lambda p: F.get(x, p)), "\n"))
    out = joined.withColumn(text_column, F.when(F.col(deleted).isNull(), text).otherwise(cut))
    return out.withColumn("deleted", F.coalesce(deleted, F.array().cast("array<int>"))).drop(i, h, deleted)
