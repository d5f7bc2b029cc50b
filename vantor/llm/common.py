"""Shared pieces of the corpus operators: durable cuts of the lineage, packed keys and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here takes it: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A table may be broadcast only when counted to be at most this long (rows are narrow: a few numbers or one short key).
BROADCAST_ROWS = 20_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes.split() without arguments splits at exactly space and \x09-\x0D.
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one only on a local master where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="vantor-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "cut", by: tuple[str, ...] = (), tidy: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and survives lost executors.

    by: columns that name folders, so that a reader of a few of their values opens no others. tidy: the shuffle files of the write
    are removed with it; the written table is what later steps read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_path = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that stored() wrote, or one folder of theirs; nothing that is still to be computed may read them."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path + part)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it is counted to be short; else leave the join to Spark, which splits skewed shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(names, name: str) -> str:
    """name, or name with underscores before it if a column is called so, in any case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = "_" + name
    return name


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def doc_key(column: str = "doc_id"):
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(column: str, folds: int):
    """crc32 of the id's text modulo folds."""
    return F.crc32(doc_key(column).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    """Buckets of an exchange follow spark.sql.shuffle.partitions, which a cluster sets by its input."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finisher)."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def ranges(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Union of half-open intervals, as maximal runs in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.concatenate((first[1:], [True]))
    return np.stack([s[first], e[last]], axis=1).tolist()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (node, component), component being the smallest node reachable.

    Large-star and small-star rounds by aggregation and join: no neighbour list is gathered, each
    round is written to the shared folder, and Spark splits the joins of hub nodes.
    """
    pairs = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges", tidy=True)
    state = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), "m"), F.struct(F.col("u").alias("a"), "m"))).alias("p"))
            .select(F.col("p.a").alias("u"), F.col("p.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # The write itself counts and sums what it writes, so a round is one pass; a round that changes nothing is the last.
        watch = Observation()
        before, pairs = pairs, stored(small.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges", tidy=True)
        discard(before)
        seen = (watch.get["n"], watch.get["h"])
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
