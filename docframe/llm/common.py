"""Shared helpers: scratch tables in the shared folder and null-safe text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where it is unset a local session, all on one machine, gets a folder of its own;
    on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/docframe-scratch"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder or file of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a batch of rows on its way to a Python worker, about.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` from here on, unless the session was given a size of its own.

    A batch is held by the JVM, off its heap, and by the Python worker beside it; by
    Spark's default it may hold all texts of a partition.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size not in spark.conf.getAll:
        spark.conf.set(size, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, after which its Python worker, which waits for the next task, holds no freed memory."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


class Scratch:
    """Written tables that cut lineage: rereading one never recomputes its past.

    Tables lie under the shared folder, so any executor can read them after
    another is lost. ``drop`` removes one that later steps no longer need;
    ``made`` holds every folder of this session that was not removed whole, so that
    a caller who has written a result can remove what it was read from.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        Scratch.made.append(self)

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}")
        self.tables.add(table)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}")

    def drop(self, table: str) -> None:
        self.tables.discard(table)
        remove(self.spark, f"{self.root}/{table}")

    def drop_all_but(self, *tables: str) -> None:
        """Removes what only earlier steps needed."""
        for table in self.tables - set(tables):
            self.drop(table)

    @classmethod
    def remove_since(cls, mark: int, but: Scratch) -> None:
        """Removes the folders made after the first ``mark`` ones, but one."""
        for old in cls.made[mark:]:
            if old is not but:
                remove(old.spark, old.root)
        cls.made[mark:] = [but] if but in cls.made[mark:] else []


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it a name that ``df`` has no column of."""
    while name in df.columns:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def numbered(df: DataFrame, column: str, scratch: Scratch, table: str) -> DataFrame:
    """``df``, written, with consecutive numbers from 0 in its order of partitions and rows.

    Only the number of rows of each partition passes through the driver.
    """
    kept = scratch.keep(df.withColumn("__m", F.monotonically_increasing_id()), table)
    part = F.shiftright("__m", 33)
    counts = sorted((r["part"], r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())
    starts, base = [], 0
    for p, n in counts:
        starts.append((p, base))
        base += n
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    joined = kept.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn(column, F.col("__start") + F.col("__m") - F.shiftleft("__part", 33)).drop("__m", "__part", "__start")


#: A key is hot when it holds more than one in so many rows; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_salted(rows: DataFrame, table: DataFrame, sizes: DataFrame, keys: list[str], total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``; ``sizes`` (keys, count) tells how many of the ``total`` rows have a key.

    A key of more than one in ``HOT_SHARE`` rows is dealt to several tasks by a hash
    of the columns ``by``, and what ``table`` has for it goes to each of them; the hot
    keys, fewer than ``HOT_SHARE`` whatever the input, are broadcast. Where no key is
    hot this is the plain join. ``sizes`` should be a written table: it is asked first.
    """
    n, salt = "__salts", "__salt"
    if sizes.where(F.col("count") * HOT_SHARE > total).isEmpty():
        return rows.join(table, keys, how)
    hot = sizes.where(F.col("count") * HOT_SHARE > total).select(*keys, F.ceil(F.col("count") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias(n))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(n)), F.lit(0)).cast("int")).drop(n)
    right = table.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(n)
    return left.join(right, [*keys, salt], how).drop(salt)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper end a of the links a-b has one lower end b, and that is no upper end itself."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    counts = edges.select(ends.alias("x")).select("x.*").groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where(F.col("up") + F.col("down") > 1).where(F.col("up") > 0).isEmpty()


def components(edges: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """node and root (the least node) of every node on an edge a-b, by alternating large and small stars.

    Both halves of a round are written, so their lineage ends there and their plans stay
    small; the links stay distributed. Rounds end as soon as all links are stars.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    e = scratch.keep(e, f"{table}0")
    turn = 0
    while not _are_stars(e):
        turn += 1
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))).distinct()
        large = scratch.keep(large, f"{table}{turn}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.keep(small, f"{table}{turn}")
        scratch.drop(f"{table}{turn}-large")
        scratch.drop(f"{table}{turn - 1}")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionAll(roots.select("root", "root").distinct())
