"""All-or-nothing graph updates, as new snapshots of the graph's tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph

#: Property keys that name files of the store, and those that only look like it (fixed values).
STORE_KEYS, NOT_STORE_KEYS = ("store", "code_path", "description_tex"), ("relative_path", "module_path")
STORE_SUFFIXES = ("_path", "_file", "_tex")
#: Errors of a refused update that come to the driver; the rest stay in a table.
SHOWN_ERRORS = 1000


@dataclass
class Batch:
    """A change: nodes (id, label), edges (id, label, source, target), values (id, key, value), and ids to delete.

    Frames may be None. deleted_values has id and key, key null for all of an element's.
    """

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    values: DataFrame | None = None
    deleted_nodes: DataFrame | None = None
    deleted_edges: DataFrame | None = None
    deleted_values: DataFrame | None = None


@dataclass
class Result:
    status: str
    committed: bool
    errors: list = field(default_factory=list)
    graph: PropertyGraph | None = None
    applied: dict = field(default_factory=dict)
    n_errors: int = 0  #: of which ``errors`` holds the first SHOWN_ERRORS, and ``all_errors`` every one
    all_errors: DataFrame | None = None


def payload_errors(spark: SparkSession, nodes: list[dict], edges: list[dict], values: dict) -> list[tuple[str, str]]:
    """(code, element) of a JSON payload's faults: missing ids and ends, foreign keys, nested values. Runs on the driver, over one call's payload."""
    out = []
    for kind, rows, known in (("node", nodes, {"id", "label"}), ("edge", edges, {"id", "label", "source", "target"})):
        for r in rows:
            ident = r.get("id")
            if not ident:
                out.append(("MISSING_ID", kind))
                continue
            if set(r) - known:
                out.append(("FORBIDDEN_PROPERTY", ident))
            if kind == "edge" and not (r.get("source") and r.get("target")):
                out.append(("MISSING_ID", ident))
    for ident, own in values.items():
        if any(isinstance(v, (list, dict)) for v in own.values()):
            out.append(("NESTED_PROPERTIES_NOT_ALLOWED", ident))
    return out


def store_path_bad(key: Column, value: Column) -> Column:
    """Store keys must name a place under ./store, without climbing out of it."""
    named = (key.isin(*STORE_KEYS) | reduce(lambda a, b: a | b, [key.endswith(s) for s in STORE_SUFFIXES])) & ~key.isin(*NOT_STORE_KEYS)
    return named & (value.contains("..") | ~value.rlike(r"^\./store(/|$)"))


def _error(df: DataFrame, code: str, element: str = "id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(element).cast("string").alias("element_id"))


def _latest(base: DataFrame, new: DataFrame | None, columns: list[str]) -> DataFrame:
    """base with new rows merged by id, in order: later rows win, null columns keep what was there, a new label defaults to the id."""
    if new is None:
        return base
    top = base.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    seq = new.withColumn("seq", F.monotonically_increasing_id()).join(F.broadcast(top)).withColumn("ord", F.col("top") + 1 + F.col("seq"))
    both = base.select("id", *columns, "ord").unionByName(seq.select("id", *columns, "ord"))
    merged = both.groupBy("id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns], F.min("ord").alias("ord_"))
    rest = base.drop(*columns, "ord")
    out = merged.join(rest, "id", "left").withColumnRenamed("ord_", "ord")
    return out.withColumn("label", F.coalesce("label", "id"))


def update_graph(spark: SparkSession, graph: PropertyGraph, batch: Batch, verify=None) -> Result:
    """Deletes edges, nodes and values, then merges nodes, edges and values; commits if nothing is wrong.

    Deleting a node needs its edges to go in the same batch. An edge whose ends are missing, a value
    of no element and a path outside the store are errors. A refused update tells the first errors, how
    many there are, and where to read them all. verify: graph -> DataFrame of violations,
    any of which undoes the update. Repeated ids in a batch are updates of the first.
    """
    nodes, edges = graph.nodes, graph.edges
    errors = []
    if batch.deleted_edges is not None:
        errors.append(_error(batch.deleted_edges.join(edges.select("id"), "id", "left_anti"), "ELEMENT_NOT_FOUND"))
        edges = edges.join(batch.deleted_edges.select("id"), "id", "left_anti")
    if batch.deleted_nodes is not None:
        gone = batch.deleted_nodes.select("id")
        errors.append(_error(gone.join(nodes.select("id"), "id", "left_anti"), "ELEMENT_NOT_FOUND"))
        ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
        errors.append(_error(gone.join(ends, "id", "left_semi"), "REFERENTIAL_INTEGRITY"))
        nodes = nodes.join(gone, "id", "left_anti")
    if batch.nodes is not None and batch.edges is not None:
        errors.append(_error(batch.nodes.select("id").join(batch.edges.select("id"), "id", "left_semi"), "DUPLICATE_ID"))
    nodes = _latest(nodes, batch.nodes, ["label"])
    edges = _latest(edges, batch.edges, ["label", "source", "target"])
    if batch.edges is not None:
        ends = edges.join(batch.edges.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.array("source", "target")).alias("end"))
        errors.append(_error(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct(), "REFERENTIAL_INTEGRITY"))
    empty = F.create_map().cast("map<string,string>")
    if batch.deleted_values is not None:
        drop = batch.deleted_values.groupBy("id").agg(F.max(F.col("key").isNull()).alias("all_"), F.collect_set("key").alias("keys"))

        def without(df: DataFrame) -> DataFrame:
            own = df.join(drop, "id", "left")
            left = F.when(F.col("all_"), empty).when(F.col("keys").isNotNull(), F.map_filter("props", lambda k, v: ~F.array_contains("keys", k))).otherwise(F.col("props"))
            return own.withColumn("props", left).drop("all_", "keys")

        nodes, edges = without(nodes), without(edges)
    if batch.values is not None:
        seq = batch.values.withColumn("seq", F.monotonically_increasing_id())
        there = nodes.select("id").unionByName(edges.select("id"))
        errors.append(_error(seq.join(there, "id", "left_anti").select("id").distinct(), "ELEMENT_NOT_FOUND"))
        errors.append(_error(seq.where(store_path_bad(F.col("key"), F.col("value"))).select("id").distinct(), "STORE_PATH_INVALID"))
        latest = seq.where("value is not null").groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
        new = latest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("new"))

        def merged(df: DataFrame) -> DataFrame:
            own = df.join(new, "id", "left")
            old = F.coalesce(F.col("props"), empty)
            kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(F.coalesce("new", empty), k))
            return own.withColumn("props", F.map_concat(kept, F.coalesce("new", empty))).drop("new")

        nodes, edges = merged(nodes), merged(edges)
    nodes = nodes.withColumn("meta_type", F.coalesce(F.nullif(F.col("props")["origin_type"], F.lit("")), F.nullif(F.col("props")["meta_type"], F.lit("")), "meta_type"))
    after = PropertyGraph(nodes.select(*graph.nodes.columns), edges.select(*graph.edges.columns))
    faults = reduce(DataFrame.unionByName, errors).distinct() if errors else None
    n = faults.count() if faults is not None else 0
    if not n and verify is not None:
        faults = verify(after).select(F.col("error_type").alias("code"), "element_id")
        n = faults.count()
    if n:
        shown = faults.orderBy("code", "element_id").limit(SHOWN_ERRORS).collect()
        return Result("unsat", False, [tuple(r) for r in shown], graph, n_errors=n, all_errors=faults)
    count = lambda df: df.count() if df is not None else 0
    applied = {"nodes": count(batch.nodes), "edges": count(batch.edges), "values": count(batch.values)}
    return Result("sat", True, [], after, applied)


def commit(spark: SparkSession, graph: PropertyGraph, batch: Batch, verify=None) -> tuple[PropertyGraph, dict]:
    """(graph, answer): the updated graph, or the old one with what was wrong: status, committed, message, and counts."""
    done = update_graph(spark, graph, batch, verify)
    message = "" if done.committed else f"{done.n_errors} errors: " + ", ".join(f"{code} {element}" for code, element in done.errors[:10])
    return done.graph, {"status": done.status, "committed": done.committed, "message": message} | done.applied


def save_snapshot(spark: SparkSession, graph: PropertyGraph, path: str, version: int) -> str:
    """Writes a snapshot and then the pointer file that makes it the current one; older snapshots stay for going back."""
    at = f"{path}/v{version:08d}"
    graph.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{path}/current")
    return at


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """The snapshot that was saved last, or a given one."""
    if version is None:
        version = spark.read.schema("version long").json(f"{path}/current").agg(F.max("version")).first()[0]
    at = f"{path}/v{version:08d}"
    return PropertyGraph(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges"))
