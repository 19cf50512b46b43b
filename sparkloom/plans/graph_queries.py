"""Graph queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tpch_graph import SQL as GRAPH
from ..sources.tpch_graph import tpch_graph

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def ids(spark: SparkSession, column: str, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@query("graph_nodes", f"WITH {GRAPH} SELECT id, label, meta_type FROM nodes")
def graph_nodes(spark, d):
    return tpch_graph(spark, d).nodes.select("id", "label", "meta_type")


@query("graph_edges", f"WITH {GRAPH} SELECT id, label, source, target FROM edges")
def graph_edges(spark, d):
    return tpch_graph(spark, d).edges.select("id", "label", "source", "target")


@query("graph_search_label", "SELECT 'Part-' || p_partkey AS id, p_name AS label, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), lower('LA')) ")
def graph_search_label(spark, d):
    return G.search_elements(_nodes_only(spark, d, "Part"), "node", "Part", "LA").select("id", "label", "total")


def _nodes_only(spark, d, *types):
    g = tpch_graph(spark, d, types, ("BASED_IN",))
    return G.PropertyGraph(g.nodes, g.edges.limit(0))


@query("graph_search_glob", "SELECT 'Customer-' || c_custkey AS id, c_mktsegment AS segment, count(*) OVER () AS total FROM customer WHERE c_mktsegment LIKE '%U%E%' AND c_name LIKE '%1%'")
def graph_search_glob(spark, d):
    found = G.search_elements(_nodes_only(spark, d, "Customer"), "node", "Customer", None, {"c_mktsegment": "*U*E*", "c_name": "*1*"}, include=("properties",))
    return found.select("id", F.col("props")["c_mktsegment"].alias("segment"), "total")


@query("graph_search_equal", "SELECT 'Order-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'")
def graph_search_equal(spark, d):
    return G.search_elements(_nodes_only(spark, d, "Order"), "node", "Order", None, {"o_orderstatus": "O", "o_orderpriority": "1*"}).select("id")


@query("graph_search_paged", "SELECT id, total FROM (SELECT 'Part-' || p_partkey AS id, p_brand, p_partkey, count(*) OVER () AS total FROM part WHERE p_size = 10) ORDER BY p_brand DESC, p_partkey LIMIT 20 OFFSET 5")
def graph_search_paged(spark, d):
    return G.search_elements(_nodes_only(spark, d, "Part"), "node", "Part", None, {"p_size": 10}, limit=20, offset=5, sort_by="p_brand", sort_order="desc", include=("properties",)).select("id", "total")


@query("graph_search_edges", f"WITH {GRAPH} SELECT id, source, target, count(*) OVER () AS total FROM edges WHERE contains(lower(label), 'based')")
def graph_search_edges(spark, d):
    return G.search_elements(tpch_graph(spark, d, ("Region",)), "edge", None, "BASED").select("id", "source", "target", "total")


@query("graph_element_full", f"""WITH {GRAPH}, e AS (SELECT * FROM edges WHERE source = 'Nation-3' OR target = 'Nation-3'),
n AS (SELECT DISTINCT CASE WHEN source = 'Nation-3' THEN target ELSE source END AS id FROM e)
SELECT 'Nation-3' AS id, (SELECT label FROM nodes WHERE id = 'Nation-3') AS label, (SELECT count(*) FROM e) AS n_edges, (SELECT string_agg(id, ',' ORDER BY id) FROM n) AS neighbors""")
def graph_element_full(spark, d):
    one = G.get_element(tpch_graph(spark, d, None, ("CONTAINS", "BASED_IN")), "Nation-3", ("edges", "neighbors"))
    return one.select("id", "label", F.size("edges").cast("long").alias("n_edges"), F.array_join(F.transform("neighbors", lambda x: x["id"]), ",").alias("neighbors"))


for _way in ("in", "out", "both"):
    _sides = {"out": "SELECT source AS center, target AS id, id AS e FROM edges WHERE source IN ('Nation-1', 'Nation-7')", "in": "SELECT target AS center, source AS id, id AS e FROM edges WHERE target IN ('Nation-1', 'Nation-7')"}
    _body = " UNION ALL ".join(v for k, v in _sides.items() if _way in (k, "both"))

    @query(f"graph_neighbors_{_way}", f"WITH {GRAPH}, n AS ({_body}) SELECT center, n.id, coalesce(nodes.label, n.id) AS label, count(DISTINCT e) AS n_edges FROM n LEFT JOIN nodes ON nodes.id = n.id GROUP BY ALL")
    def graph_neighbors(spark, d, way=_way):
        return G.get_neighbors(tpch_graph(spark, d, None, ("CONTAINS", "BASED_IN")), ids(spark, "center", "Nation-1", "Nation-7"), way).select("center", "id", "label", "n_edges")


@query("graph_neighbor_counts", f"WITH {GRAPH} SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges WHERE label = 'CONTAINS' UNION ALL SELECT target FROM edges WHERE label = 'CONTAINS') GROUP BY id")
def graph_neighbor_counts(spark, d):
    g = tpch_graph(spark, d, None, ("CONTAINS",))
    return G.incident(g, g.nodes.select(F.col("id").alias("center"))).groupBy(F.col("center").alias("id")).agg(F.count("*").alias("n"))


_BOTH = "ways AS (SELECT source AS a, target AS b, id AS e, label, 'out' AS dir FROM edges UNION ALL SELECT target, source, id, label, 'in' FROM edges)"


@query("graph_traverse_k", f"""WITH RECURSIVE {GRAPH}, {_BOTH}, r AS (SELECT id AS cur, [id] AS path, CAST([] AS VARCHAR[]) AS es, 0 AS k FROM nodes WHERE meta_type = 'Region'
UNION ALL SELECT b, list_append(path, b), list_append(es, e), k + 1 FROM r JOIN ways ON cur = a AND label = 'CONTAINS' WHERE k < 2 AND NOT list_contains(path, b))
SELECT path[1] AS start, array_to_string(path, '>') AS nodes, array_to_string(es, '>') AS edges FROM r WHERE k = 2""")
def graph_traverse_k(spark, d):
    g = tpch_graph(spark, d, None, ("CONTAINS",))
    starts = g.nodes.where("meta_type = 'Region'").select(F.col("id").alias("start"))
    return _joined(G.traverse(g, starts, 2, ["CONTAINS", "CONTAINS"]))


def _joined(paths):
    return paths.select("start", F.array_join("node_ids", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edges"))


_PATTERN = [{"edge_label": "BASED_IN", "direction": "in"}, {"edge_label": "SUPPLIES", "direction": "out"}]
_PATTERN_SQL = """SELECT 'Nation-2' AS start, 'Nation-2>Supplier-' || k || '>Part-' || p AS nodes, 'Supplier-' || k || '-BASED_IN-Nation-2>Supplier-' || k || '-SUPPLIES-Part-' || p AS edges
FROM (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 2) JOIN (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem) USING (k)"""


@query("graph_traverse_pattern", _PATTERN_SQL)
def graph_traverse_pattern(spark, d):
    return _joined(G.traverse(tpch_graph(spark, d, None, ("BASED_IN", "SUPPLIES")), ids(spark, "start", "Nation-2"), 2, _PATTERN))


@query("graph_traverse_limit", f"WITH p AS ({_PATTERN_SQL}) SELECT start, nodes, edges FROM p ORDER BY string_split(edges, '>') LIMIT 25")
def graph_traverse_limit(spark, d):
    return _joined(G.traverse(tpch_graph(spark, d, None, ("BASED_IN", "SUPPLIES")), ids(spark, "start", "Nation-2"), 2, _PATTERN, 25))


_UP = f"""RECURSIVE {GRAPH}, up AS (SELECT id AS start, id AS cur, 0 AS depth, id AS path FROM nodes WHERE meta_type = '%s'
UNION ALL SELECT start, source, depth + 1, path || '>' || source FROM up JOIN edges ON target = cur AND label = 'CONTAINS')"""


@query("graph_find_connected", f"WITH {_UP % 'Order'} SELECT start, cur AS id, depth, path FROM up JOIN nodes n ON n.id = cur AND n.meta_type = 'Nation'")
def graph_find_connected(spark, d):
    g = tpch_graph(spark, d, ("Region", "Nation", "Customer", "Order"), ("CONTAINS",))
    starts = g.nodes.where("meta_type = 'Order'").select(F.col("id").alias("start"))
    return G.find_connected(g, starts, "Nation", "CONTAINS").select("start", "id", "depth", F.array_join("path", ">").alias("path"))


@query("graph_nearest_batch", f"WITH {_UP % 'Order'} SELECT n.label AS region, count(*) AS orders, rank() OVER (ORDER BY count(*) DESC) AS rank FROM up JOIN nodes n ON n.id = cur AND n.meta_type = 'Region' GROUP BY n.label")
def graph_nearest_batch(spark, d):
    """Orders by the region that contains them, most frequent first."""
    from pyspark.sql import Window as W

    g = tpch_graph(spark, d, ("Region", "Nation", "Customer", "Order"), ("CONTAINS",))
    starts = g.nodes.where("meta_type = 'Order'").select(F.col("id").alias("start"))
    found = G.find_connected(g, starts, "Region", "CONTAINS").join(g.nodes.select("id", "label"), "id")
    counts = found.groupBy(F.col("label").alias("region")).agg(F.count("*").alias("orders"))
    return counts.withColumn("rank", F.rank().over(W.orderBy(F.desc("orders"))).cast("long"))


@query("graph_nearest_both_ways", f"""WITH {GRAPH}, s AS (SELECT source AS start, target AS nation FROM edges WHERE label = 'BASED_IN')
SELECT s.start, e.source AS id, CAST(2 AS INTEGER) AS depth FROM s JOIN edges e ON e.target = s.nation AND e.label = 'CONTAINS'""")
def graph_nearest_both_ways(spark, d):
    g = tpch_graph(spark, d, ("Region", "Nation", "Supplier"), ("CONTAINS", "BASED_IN"))
    starts = g.nodes.where("meta_type = 'Supplier'").select(F.col("id").alias("start"))
    return G.find_connected(g, starts, "Region", None, "both", 3).select("start", "id", "depth")


_HOPS = f"""RECURSIVE {GRAPH}, {_BOTH}, d0 AS (SELECT 'Region-1' AS id),
d1 AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM d0) AND b NOT IN (SELECT id FROM d0)),
d2 AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM d1) AND b NOT IN (SELECT id FROM d0 UNION ALL SELECT id FROM d1)),
l AS (SELECT 1 AS depth, label AS edge_label, dir AS direction, count(*) AS n FROM ways WHERE a IN (SELECT id FROM d0) GROUP BY ALL
UNION ALL SELECT 2, label, dir, count(*) FROM ways WHERE a IN (SELECT id FROM d1) GROUP BY ALL
UNION ALL SELECT 3, label, dir, count(*) FROM ways WHERE a IN (SELECT id FROM d2) GROUP BY ALL)"""


@query("graph_links_per_hop", f"WITH {_HOPS} SELECT depth, edge_label, direction, n FROM l")
def graph_links_per_hop(spark, d):
    return G.links_per_hop(tpch_graph(spark, d), ids(spark, "start", "Region-1"), 3)


@query("graph_best_link", f"WITH {_HOPS}, r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY n DESC, CASE direction WHEN 'out' THEN 0 ELSE 1 END, edge_label) AS k FROM l) SELECT depth, edge_label, direction, n FROM r WHERE k = 1")
def graph_best_link(spark, d):
    return G.best_link(G.links_per_hop(tpch_graph(spark, d), ids(spark, "start", "Region-1"), 3))


@query("traverse_hints", f"""WITH {_HOPS}, w AS (SELECT * FROM (VALUES (1, 'CONTAINS', 'in'), (2, 'BASED_IN', 'in'), (3, 'NOPE', NULL)) AS v(depth, want, way)),
k AS (SELECT l.*, row_number() OVER (PARTITION BY l.depth ORDER BY CASE WHEN edge_label = want THEN 0 ELSE 1 END, n DESC, CASE direction WHEN 'out' THEN 0 ELSE 1 END, edge_label) AS k, count(*) FILTER (edge_label = want) OVER (PARTITION BY l.depth) AS same, count(*) FILTER (edge_label = want AND direction = way) OVER (PARTITION BY l.depth) AS fits FROM l JOIN w USING (depth)),
b AS (SELECT depth, edge_label, direction, same = 0 OR (way IS NOT NULL AND fits = 0) AS bad FROM k JOIN w USING (depth) WHERE k = 1)
SELECT depth, edge_label, direction, bad AND depth = (SELECT min(depth) FROM b WHERE bad) AS failing FROM b""")
def traverse_hints(spark, d):
    """Why no path from Region-1 fits a pattern whose first step goes the wrong way, and which steps would do."""
    hint = G.traverse_hint(tpch_graph(spark, d), ids(spark, "start", "Region-1"), [{"edge_label": "CONTAINS", "direction": "in"}, {"edge_label": "BASED_IN", "direction": "in"}, "NOPE"])
    return hint.select("depth", "edge_label", "direction", "failing")


@query("graph_traverse_hint", "SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0) THEN 2 ELSE 1 END AS INTEGER) AS failing_step")
def graph_traverse_hint(spark, d):
    g = tpch_graph(spark, d, None, ("CONTAINS", "BASED_IN"))
    step = G.first_failing_step(g, ids(spark, "start", "Region-0"), [{"edge_label": "CONTAINS", "direction": "out"}, {"edge_label": "USES"}, {}])
    return spark.createDataFrame([(step,)], "failing_step int")


@query("file_rank_touch", """WITH c AS (SELECT user_id AS instance, event_type AS path, count(*) AS freq, min(event_id) AS first_seq FROM events GROUP BY ALL)
SELECT instance, path, freq, row_number() OVER (PARTITION BY instance ORDER BY freq DESC, first_seq, path) AS rank FROM c""")
def file_rank_touch(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("instance"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"))
    return G.rank_files(e).select("instance", "path", "freq", F.col("rank").cast("long").alias("rank"))


@query("touched_accumulate", """SELECT user_id AS instance, event_type AS id, min(event_id) AS first_seq,
arg_max(nullif(props, ''), event_id) AS label, arg_max(CAST(json_extract(props, '$.k') AS VARCHAR), event_id) AS k FROM events GROUP BY user_id, event_type""")
def touched_accumulate(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").alias("instance"), F.col("event_type").alias("id"), F.col("event_id").alias("seq"), F.col("props").alias("label"), F.from_json("props", "map<string,string>").alias("props"))
    return G.touched(rows).select("instance", "id", "first_seq", "label", F.col("props")["k"].alias("k"))


@query("find_node_first", f"WITH {GRAPH} SELECT label, min(id) AS id FROM nodes WHERE meta_type = 'Region' GROUP BY label")
def find_node_first(spark, d):
    nodes = _nodes_only(spark, d, "Region").nodes.where("meta_type = 'Region'")
    return nodes.groupBy("label").agg(F.min_by("id", "ord").alias("id"))


@query("schema_summary", f"WITH {GRAPH} SELECT e.label AS rel, s.meta_type AS source_type, t.meta_type AS target_type, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target GROUP BY ALL")
def schema_summary(spark, d):
    g = tpch_graph(spark, d)
    kinds = g.nodes.select("id", "meta_type")
    s, t = kinds.select(F.col("id").alias("source"), F.col("meta_type").alias("source_type")), kinds.select(F.col("id").alias("target"), F.col("meta_type").alias("target_type"))
    return g.edges.join(s, "source").join(t, "target").groupBy(F.col("label").alias("rel"), "source_type", "target_type").agg(F.count("*").alias("n"))
