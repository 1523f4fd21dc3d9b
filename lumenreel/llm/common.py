"""Helpers shared by the text-corpus operators: scratch tables, word hashing, numbering and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (Java and Python regular expressions).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Words that a Python worker remembers the hash of, before it starts anew.
CACHE_WORDS = 30_000
#: Rows that a Python worker unpacks at a time.
SLICE_ROWS = 250
#: Bytes of an Arrow batch of a table that Scratch writes.
BATCH_BYTES = 4 << 20
#: Spread 64-bit values (fixed odd multipliers).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenreel-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive lost executors.

    What an operator returns may read its tables, so they stay until sweeping() ends, where the caller has written it.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.made.append(self)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; the result has the attribute scratch_path. Shuffle files go with the write.

        Arrow batches are small meanwhile: each is held by Spark and by a Python worker, and unpacked there.
        """
        path = self.path(name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(self.spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that keep() made and nothing reads any more."""
        for df in dfs:
            self.delete(df.scratch_path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def sweeping():
    """Delete the tables of all operators that a block calls when it ends; by then their results must be written."""
    before = len(Scratch.made)
    try:
        yield
    finally:
        for scratch in Scratch.made[before:]:
            scratch.delete(scratch.root)
        del Scratch.made[before:]


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The session's setting, for as long as a block runs."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle by hand: the session's number, or one for each `each` bytes of the tables that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    # tables of unknown size are estimated at the largest number there is
    return max(shuffle_partitions(df.sparkSession), sum(s for s in sizes if s < 1 << 60) // each)


def sliced(batches, rows: int = SLICE_ROWS) -> Iterator:
    """Arrow batches, which Spark bounds in bytes, in slices of few rows, to bound what Python objects they become."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def own(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(df: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """`row`, a struct of df's columns, and the given columns: no name of df can clash with those of a method.

    without: columns of df that row leaves out, as they will be replaced; null stands in for a row without columns.
    """
    kept = [own(c) for c in df.columns if c not in without] or [F.lit(None).cast("string").alias("none")]
    return df.select(F.struct(*kept).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unwrapped(df: DataFrame, names: list[str], outputs: dict[str, Column], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns `names` of a wrapped row and outputs. A column of the row that has an output's name keeps its values as name_input.

    replaced: columns of the row that get new values, in their place.
    """
    taken, out = {n.lower() for n in [*names, *outputs]}, []
    for n in names:
        new = n
        while n.lower() in {o.lower() for o in outputs} and new.lower() in taken:
            new += "_input"
        taken.add(new.lower())
        out.append((replaced or {}).get(n, F.col("row").getField(n)).alias(new))
    return df.select(*out, *[c.alias(n) for n, c in outputs.items()])


def words_of(text: Column) -> Column:
    """The words of a text, as an array; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def mixed(x: np.ndarray) -> np.ndarray:
    """Each uint64 mapped to a spread one, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Words (bytes) to 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: An odd multiplier for each doubling, for the hash of a sequence of words.
DOUBLINGS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` consecutive words: runs of powers of two, doubled, and then joined."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done, power, k = None, 0, hashes, 0
    while True:
        if size >> k & 1:
            part = power[done : done + n]
            total = part if total is None else mixed(total * DOUBLINGS[32 + k] + part)
            done += 1 << k
        if done == size:
            return mixed(total + DOUBLINGS[63])
        step = 1 << k
        power = mixed(power[:-step] * DOUBLINGS[k] + power[step:])
        k += 1


def binary_column(batch, name: str) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each key from 0, without a gap, without bringing a key into one task.

    Rows of a key fall into buckets by the hash of what orders them; a bucket's rows come after those of lower
    buckets. Only the counts of (key, bucket) are summed up in one place for a key: at most `buckets` rows.
    """
    buckets = max(buckets, shuffle_partitions(df.sparkSession))
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_start")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1)
    same = (F.col("_bucket") == F.col("_b")) if not keys else None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = part if same is None else same & part
    if keys:
        same = same & (F.col("_bucket") == F.col("_b"))
    out = ranked.join(starts, same, "left")
    return out.withColumn(name, (F.col("_start") + F.col("_rank")).cast("long")).select(*df.columns, name)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node with an edge; label: the component's smallest node.

    Labels travel along edges and then jump to the label's label until none changes; every step is a join of
    tables that are written in between.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(edges.select(F.col(b), F.col(a))).filter("node <> other").distinct()
    both = scratch.keep(both, "links")
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other")
        near = near.groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # a table of its own: Spark splits a label of very many nodes in a join of two exchanges, not below an aggregate
        lower = scratch.keep(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was")
        moved = scratch.keep(moved, "moved")
        changed = moved.filter("label <> was").limit(1).count()
        scratch.drop(labels, lower)
        labels = moved
        if not changed:
            scratch.drop(both)
            labels = moved.select("node", "label")
            labels.scratch_path = moved.scratch_path
            return labels
