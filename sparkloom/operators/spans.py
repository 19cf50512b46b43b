"""Line spans: merging, containment, gaps, range joins of diff hunks with nodes, and packing under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a bin, the unit in which spans of one file meet.
BIN_LINES = 256


def merge_intervals(spans: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Spans (keys, start, end) widened by pad, clamped to 1, joined where they overlap or touch: keys, start, end, n."""
    wide = spans.select(*keys, F.greatest(F.col("start") - pad, F.lit(1)).alias("start"), (F.col("end") + pad).alias("end"))
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = wide.withColumn("fresh", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def drop_contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, id, start, end) that lie in no other of their key; of equal ones, the least id stays.

    Sorted by start, then by longest, then by id, a span lies in an earlier one if and only if the
    farthest end so far reaches its own end.
    """
    order = W.partitionBy(*keys).orderBy("start", F.desc("end"), "id").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(order)).where("reach is null or reach < end").drop("reach")


def gap_markers(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with ``omitted``: the lines between the previous span's end and this one's start, if any."""
    before = F.lag("end").over(W.partitionBy(*keys).orderBy("start", "end"))
    return spans.withColumn("omitted", F.when(F.col("start") > before + 1, F.col("start") - before - 1))


def _contains(a: str = "line_start", b: str = "line_end") -> Column:
    inside = (F.col(a) <= F.col("h_start")) & (F.col("h_end") <= F.col(b))
    return F.when(F.col("count") == 0, (F.col(a) <= F.col("h_start")) & (F.col("h_start") < F.col(b))).otherwise(inside)


def _overlaps(a: str = "line_start", b: str = "line_end") -> Column:
    both = (F.col("h_start") <= F.col(b)) & (F.col(a) <= F.col("h_end"))
    return F.when(F.col("count") == 0, (F.col(a) <= F.col("h_start")) & (F.col("h_start") <= F.col(b))).otherwise(both)


def _met(hunks: DataFrame, nodes: DataFrame, bin_lines: int) -> DataFrame:
    """Hunks joined with the nodes of their file that share a bin of lines, each pair once; hunks without any come back with nulls.

    A file's spans meet bin by bin, so that a file with very many of them is dealt over many tasks.
    """
    last = F.greatest("h_start", "h_end")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_lines), F.floor(F.greatest(a, b) / bin_lines)))
    left = hunks.withColumn("_bin", bins(F.col("h_start"), last)).withColumn("_first", F.floor(F.col("h_start") / bin_lines))
    right = nodes.withColumn("_bin", bins(F.col("line_start"), F.col("line_end"))).withColumn("_begin", F.floor(F.col("line_start") / bin_lines))
    both = left.join(right, ["file", "_bin"], "left").where(F.col("_begin").isNull() | (F.col("_bin") == F.greatest("_first", "_begin")))
    return both.drop("_bin", "_first", "_begin")


def hunk_nodes(hunks: DataFrame, nodes: DataFrame, how: str = "contains", bin_lines: int = BIN_LINES) -> DataFrame:
    """Pairs of hunks (hunk_id, file, h_start, h_end, count) and nodes (node_id, file, line_start, line_end).

    A hunk without lines is an insertion behind h_start: it lies in a node that goes on after it. Hunks
    of new files (is_new_file, if there is such a column) lie in nothing.
    """
    if "is_new_file" in hunks.columns:
        hunks = hunks.where(~F.col("is_new_file"))
    on = _contains() if how == "contains" else _overlaps()
    return _met(hunks, nodes, bin_lines).where(on).select("hunk_id", "node_id", "file")


def classify_hunks(hunks: DataFrame, nodes: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """hunk_id and class: new (a new file), contained, partial (overlaps only) or outside. hunks also have is_new_file."""
    flags = _met(hunks, nodes.select("file", "line_start", "line_end"), bin_lines).groupBy("hunk_id").agg(F.max(_contains().cast("int")).alias("c"), F.max(_overlaps().cast("int")).alias("o"))
    rows = hunks.groupBy("hunk_id").agg(F.max(F.col("is_new_file").cast("int")).alias("new")).join(flags, "hunk_id", "left")
    return rows.select("hunk_id", F.when(F.col("new") == 1, "new").when(F.col("c") == 1, "contained").when(F.col("o") == 1, "partial").otherwise("outside").alias("class"))


def budget_pack(items: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Items kept under a budget in order: the first always, then until the first that doesn't fit; adds total."""
    by = W.partitionBy(*keys).orderBy(*order)
    total = F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = items.withColumn("total", total).withColumn("_place", F.row_number().over(by))
    # Sizes aren't negative, so the running total tells whether anything before has overflowed.
    return rows.where((F.col("_place") == 1) | (F.col("total") <= budget)).drop("_place")


def fold_batches(entries: Column, max_items: int | Column, max_size: int | Column) -> Column:
    """Batch numbers of entries array<struct<size, ...>>: a batch closes when one more would exceed either limit."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        close = (acc["items"] > 0) & ((acc["items"] >= max_items) | (acc["size"] + e["size"] > max_size))
        batch = acc["batch"] + F.when(close, 1).otherwise(0)
        items = F.when(close, F.lit(1)).otherwise(acc["items"] + 1)
        size = F.when(close, e["size"]).otherwise(acc["size"] + e["size"])
        return F.struct(batch.alias("batch"), items.alias("items"), size.alias("size"), F.array_append(acc["out"], batch).alias("out"))

    return F.aggregate(entries, start, step, lambda acc: acc["out"])


def greedy_batches(items: DataFrame, keys: list[str], order: str, ident: str, size: Column, max_items: int, max_size: int) -> DataFrame:
    """keys, ident, batch: consecutive items in batches of at most max_items and max_size; an oversize item stands alone.

    Sequential by nature within a key, so a key's (order, size) pairs are one array; texts stay out.
    """
    own = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(ident).alias("id"), size.cast("long").alias("size")))).alias("e"))
    numbered = own.select(*keys, F.explode(F.arrays_zip("e", fold_batches(F.col("e"), max_items, max_size).alias("batch"))).alias("x"))
    return numbered.select(*keys, F.col("x.e.id").alias(ident), F.col("x.batch").alias("batch"))
