"""What the operators of this subpackage share: tables in the shared folder,
salted ranks, and connected components over link tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_own_dir: str | None = None


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary
    folder stands in only where it is unset and Spark runs on one machine."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quillon-")
    return f"file://{_own_dir}"


#: Bytes of an Arrow batch on its way to Python; the default of 64 MB is held
#: several times over on either side of each task.
ARROW_BATCH = 16 << 20


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds within; then what was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Workspace:
    """Tables written under the shared folder; each cuts the lineage.  Sets the
    session's Arrow batches to at most ``ARROW_BATCH`` bytes.  With ``free`` the
    shuffle files of a table go once it is written, not when the driver happens
    to collect its garbage."""

    def __init__(self, spark: SparkSession, name: str, free: bool = False):
        self.spark, self.free = spark, free
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
        self.at = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
        for made in _SCRATCH:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
        """``df``, written once and read back."""
        out = df.write.option("compression", codec)
        with setting(self.spark, FREE_SHUFFLES, "true") if self.free else contextlib.nullcontext():
            (out.partitionBy(*by) if by else out).parquet(self.path(name))
        read = self.spark.read
        return (read.schema(df.schema) if not by else read).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._delete(self.path(name))

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SCRATCH: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes the workspaces made within; what was read from them must be
    written elsewhere by then."""
    made: list[Workspace] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for work in made:
            work._delete(work.at)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names beside the columns of ``df``, in whatever case those are written."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        found.append(name)
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_slots(df: DataFrame, group: str, salt_of: list[str], order: list[str], name: str, n_salts: int) -> DataFrame:
    """Adds ``name``: a gapless number from 0 within each ``group``.

    A group of any size is numbered in ``n_salts`` parts: rows are numbered
    within (group, salt), and parts are shifted by the counts before them, a
    table of one row per part.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(n_salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy(group, "_salt").orderBy(*order)
    ranked = salted.withColumn("_r", F.row_number().over(within) - 1)
    joined = ranked.join(shifts, ranked[group].eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(name, (F.col("_shift") + F.col("_r")).cast("long")).drop("_salt", "_g", "_s", "_shift", "_r")


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(links: DataFrame, work: Workspace, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest
    reachable node, itself included.

    Alternates large-star and small-star rounds until no link changes: each
    keeps connectivity, touches only neighbourhoods, and stores at most one
    row per link; the number of rounds grows with the logarithm of the
    longest chain.  Each round is a written table, so a lost executor costs
    one round at most.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:  # every node points at the smaller ones only
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        out = both.join(low, both.a == low.n)
        if large:
            return pairs(out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        moved = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return pairs(moved.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))))

    def print_of(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.max(h)).first())

    now = work.table(pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), f"{tag}0")
    seen, k = print_of(now), 0
    while seen[0]:
        k += 1
        nxt = work.table(star(star(now, True), False), f"{tag}{k}")
        mark = print_of(nxt)
        work.drop(f"{tag}{k - 1}")  # the round before
        now = nxt
        if mark == seen:
            break
        seen = mark
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
