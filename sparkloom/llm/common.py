"""Shared storage, size-checked filters and connected components for the corpus operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, so that any executor can
reread them after another one is lost, and so that lineage ends there.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids (8 bytes each) that semi_filter sends to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of whole texts that go to a Python worker at a time, where the session has Spark's own setting (64 MB).
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for texts of any length; a value set by the session's owner stays."""
    if spark.conf.get(_BATCH) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    With neither, a local session gets a temporary folder; any other one raises, since its executors
    would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparkloom-')}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """Tables written to the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        small_batches(spark)

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.options(**options).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                delete_path(self.spark, path)


def semi_filter(df: DataFrame, ids: DataFrame, on: str, anti: bool = False, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose ``on`` is (not, if anti) in ids. ids: one column ``on``, distinct, cheap to count.

    Up to ``limit`` ids are broadcast; beyond it both sides are shuffled on ``on``.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), on, "left_anti" if anti else "left_semi")


def components(spark: SparkSession, edges: DataFrame, kept: Stored, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a long, b long), any order, repeats and self-loops allowed. Returns (id, comp), one row
    for each id in an edge between different ids; comp is the smallest id it reaches. Each step is a
    minimum by node (combined before the shuffle) joined back to the edges; a node with very many
    edges is split by adaptive execution since both sides of that join are stored tables.
    """
    e = kept.put("cc_edges", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # Done if every edge goes straight to a root: no id has two edges up, and none has edges both up and down.
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept.put("cc_min", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept.put("cc_large", large)
        small_min = kept.put("cc_min", large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(small_min, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        new = kept.put("cc_new", small.where("u <> v").distinct())
        kept.drop("cc_edges", "cc_min", "cc_large")
        kept.paths["cc_edges"] = kept.paths.pop("cc_new")
        e = new
    else:
        raise RuntimeError("components did not converge")
    comp = kept.put("components", e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp"))
    roots = comp.select(F.col("comp").alias("id"), "comp").distinct()
    out = comp.unionByName(roots)
    kept.drop("cc_edges")
    return out
