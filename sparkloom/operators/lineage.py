"""Cutting lineage in loops over DataFrames."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's checkpoint folder, which survives lost executors.

    Where a local session names no folder (``spark.checkpoint.dir``), a temporary one is set; on a
    cluster that raises, since executors would write to disks of their own.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with ``name``, each row's place (long, from 0) in the given order, which must tell rows apart.

    Rows are dealt to range partitions and numbered there; one count a partition makes the numbers
    global, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = cut(ranged.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order))))
    counts = own.groupBy("_part").agg(F.max("_k").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.join(counts.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")
