"""The driver's tables as a property graph: a tree of regions, nations, customers and orders, and parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph

#: Node types in source order: (type, table, key column, label column or None, property columns).
NODES = [
    ("Region", "region", "r_regionkey", "r_name", ["r_name"]),
    ("Nation", "nation", "n_nationkey", "n_name", ["n_name"]),
    ("Customer", "customer", "c_custkey", "c_name", ["c_name", "c_mktsegment"]),
    ("Supplier", "supplier", "s_suppkey", "s_name", ["s_name"]),
    ("Order", "orders", "o_orderkey", None, ["o_orderstatus", "o_orderpriority"]),
    ("Part", "part", "p_partkey", "p_name", ["p_brand", "p_type", "p_size"]),
]
#: Edges along foreign keys: (label, source type, source key, target type, target key, table).
EDGES = [
    ("CONTAINS", "Region", "n_regionkey", "Nation", "n_nationkey", "nation"),
    ("CONTAINS", "Nation", "c_nationkey", "Customer", "c_custkey", "customer"),
    ("CONTAINS", "Customer", "o_custkey", "Order", "o_orderkey", "orders"),
    ("BASED_IN", "Supplier", "s_suppkey", "Nation", "s_nationkey", "supplier"),
    ("USES", "Order", "l_orderkey", "Part", "l_partkey", "lineitem"),
    ("SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey", "lineitem"),
]
_STEP = 10**13


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tpch_graph(spark: SparkSession, sf_dir: str, types: tuple | None = None, labels: tuple | None = None) -> PropertyGraph:
    """The graph, or only some node types and edge labels of it (then their tables alone are read)."""
    nodes = edges = None
    for k, (kind, name, key, label, props) in enumerate(NODES):
        if types and kind not in types:
            continue
        ident = F.concat_ws("-", F.lit(kind), F.col(key).cast("string"))
        held = F.create_map(F.lit("meta_type"), F.lit(kind), *[x for p in props for x in (F.lit(p), F.col(p).cast("string"))])
        own = _read(spark, sf_dir, name).select(ident.alias("id"), (F.col(label) if label else ident).alias("label"), F.lit(kind).alias("meta_type"), held.alias("props"), (F.lit(k * _STEP) + F.col(key)).cast("long").alias("ord"))
        nodes = own if nodes is None else nodes.unionByName(own)
    for k, (rel, src, src_key, dst, dst_key, name) in enumerate(EDGES):
        if labels and rel not in labels:
            continue
        keys = _read(spark, sf_dir, name).select(F.col(src_key).alias("s"), F.col(dst_key).alias("t"))
        keys = keys.distinct() if name == "lineitem" else keys
        source, target = (F.concat_ws("-", F.lit(x), F.col(c).cast("string")) for x, c in ((src, "s"), (dst, "t")))
        ident = F.concat_ws("-", source, F.lit(rel), target)
        order = (F.lit(k * _STEP) + F.col("s") * 1_000_000 + F.col("t")).cast("long")
        own = keys.select(ident.alias("id"), F.lit(rel).alias("label"), source.alias("source"), target.alias("target"), F.create_map().cast("map<string,string>").alias("props"), order.alias("ord"))
        edges = own if edges is None else edges.unionByName(own)
    return PropertyGraph(nodes, edges)


#: The same graph for SQL: common table expressions nodes(id, label, meta_type) and edges(id, label, source, target).
SQL = (
    "nodes AS ("
    + " UNION ALL ".join(f"SELECT '{k}-' || {key} AS id, {label or f"'{k}-' || {key}"} AS label, '{k}' AS meta_type FROM {name}" for k, name, key, label, _ in NODES)
    + "), edges AS ("
    + " UNION ALL ".join(
        f"SELECT {'DISTINCT ' if name == 'lineitem' else ''}'{s}-' || {sk} || '-{rel}-{t}-' || {tk} AS id, '{rel}' AS label, '{s}-' || {sk} AS source, '{t}-' || {tk} AS target FROM {name}" for rel, s, sk, t, tk, name in EDGES
    )
    + ")"
)
