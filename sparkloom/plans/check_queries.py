"""Validation and update queries over the driver's graph, with SQL, and queries over small literal sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import builder, explore, extract, repair
from ..operators import graph as G
from ..operators import spans as S
from ..operators import validate as VA
from ..operators import write as WR
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


def _tree(spark, d):
    return tpch_graph(spark, d, ("Region", "Nation", "Customer", "Order"), ("CONTAINS",))


_FAULTS = "SELECT 'data' AS level, '{}' AS error_type, {} AS element_id, {} AS detail FROM {}"


@query("dangling_edges", _FAULTS.format("REFERENTIAL_INTEGRITY", "'Nation-' || c_nationkey || '-CONTAINS-Customer-' || c_custkey", "'target Customer-' || c_custkey", "customer WHERE c_custkey % 97 = 0") + " UNION ALL " + _FAULTS.format("REFERENTIAL_INTEGRITY", "'Customer-' || o_custkey || '-CONTAINS-Order-' || o_orderkey", "'source Customer-' || o_custkey", "orders WHERE o_custkey % 97 = 0"))
def dangling_edges(spark, d):
    g = _tree(spark, d)
    gone = (F.col("meta_type") == "Customer") & (F.substring_index("id", "-", -1).cast("long") % 97 == 0)
    return VA.dangling(G.PropertyGraph(g.nodes.where(~gone), g.edges))


_ALLOWED = [("CONTAINS", "Region", "Nation"), ("CONTAINS", "Nation", "Customer")]


@query("signature_violations", _FAULTS.format("INVALID_EDGE_SIGNATURE", "'Customer-' || o_custkey || '-CONTAINS-Order-' || o_orderkey", "'Customer-CONTAINS-Order'", "orders"))
def signature_violations(spark, d):
    return VA.signatures(_tree(spark, d), spark.createDataFrame(_ALLOWED, "label string, source_type string, target_type string"))


@query("kept_edges", "SELECT 'CONTAINS' AS label, count(*) AS n FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer)")
def kept_edges(spark, d):
    kept, _ = VA.keep_valid_edges(_tree(spark, d), spark.createDataFrame(_ALLOWED, "label string, source_type string, target_type string"))
    return kept.groupBy("label").agg(F.count("*").alias("n"))


@query("unknown_types", _FAULTS.format("INVALID_NODE_TYPE", "'Region-' || r_regionkey", "'Region'", "region"))
def unknown_types(spark, d):
    return VA.node_types(_tree(spark, d), spark.createDataFrame([("Nation",), ("Customer",), ("Order",)], "meta_type string"))


@query("unknown_labels", _FAULTS.format("INVALID_EDGE_TYPE", "'Supplier-' || s_suppkey || '-BASED_IN-Nation-' || s_nationkey", "'BASED_IN'", "supplier"))
def unknown_labels(spark, d):
    return VA.edge_types(tpch_graph(spark, d, ("Supplier",), ("BASED_IN", "CONTAINS")), spark.createDataFrame([("CONTAINS",)], "label string"))


@query("missing_props", _FAULTS.format("MISSING_REQUIRED_PROPERTY", "'Customer-' || c_custkey", "'c_mktsegment'", "customer WHERE c_custkey % 97 = 0"))
def missing_props(spark, d):
    g = tpch_graph(spark, d, ("Customer",), ("BASED_IN",))
    bare = F.when(F.substring_index("id", "-", -1).cast("long") % 97 == 0, F.map_filter("props", lambda k, v: k != "c_mktsegment")).otherwise(F.col("props"))
    rules = spark.createDataFrame([("Customer", "c_mktsegment", "true"), ("Customer", "nation", "false")], "meta_type string, key string, mandatory string")
    return VA.mandatory(G.PropertyGraph(g.nodes.withColumn("props", bare), g.edges), rules)


@query("type_checks", "SELECT 'data' AS level, 'INVALID_PROPERTY_TYPE' AS error_type, CAST(event_id AS VARCHAR) AS element_id, 'k BIGINT' AS detail FROM events WHERE event_type = 'click'")
def type_checks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    values = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("meta_type"), F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("json"))
    return VA.property_types(values, spark.createDataFrame([("click", "k", "string"), ("view", "k", "integer"), ("error", "k", "float")], "meta_type string, key string, data_type string"))


@query("pattern_checks", _FAULTS.format("PATTERN_VALIDATION_FAILED", "'Part-' || p_partkey", "'p_brand=' || p_brand", "part WHERE NOT regexp_matches(p_brand, '^(?:Brand#[1-3])')"))
def pattern_checks(spark, d):
    g = tpch_graph(spark, d, ("Part",), ("BASED_IN",))
    return VA.patterns(g, spark.createDataFrame([("Part", "p_brand", "Brand#[1-3]")], "meta_type string, key string, pattern string"))


@query("cardinality_checks", f"""WITH {GRAPH}, c AS (SELECT n.id, count(e.id) AS k FROM nodes n LEFT JOIN edges e ON e.source = n.id AND e.label = 'CONTAINS' WHERE n.meta_type = 'Nation' GROUP BY 1)
SELECT 'data' AS level, CASE WHEN k < 6 THEN 'CARDINALITY_VIOLATION_MIN' ELSE 'CARDINALITY_VIOLATION_MAX' END AS error_type, id AS element_id, 'CONTAINS ' || k AS detail FROM c WHERE k < 6 OR k > 60""")
def cardinality_checks(spark, d):
    return VA.cardinality(_tree(spark, d), spark.createDataFrame([("Nation", "CONTAINS", 6, 60)], "meta_type string, label string, min_count int, max_count int"))


@query("update_graph_merge", """WITH o AS (SELECT 'Order-' || o_orderkey AS id, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT id, CASE WHEN k % 7 = 0 THEN 'late' ELSE id END AS label, CASE WHEN k % 11 = 0 THEN 'set' END AS flag FROM o UNION ALL SELECT 'Extra-' || n_nationkey, 'Extra-' || n_nationkey, NULL FROM nation""")
def update_graph_merge(spark, d):
    """Deletes every fifth order, renames every seventh, sets a property on every eleventh, adds a node for each nation."""
    g = tpch_graph(spark, d, ("Order",), ("BASED_IN",))
    base = G.PropertyGraph(g.nodes, g.edges.limit(0))
    k = F.substring_index("id", "-", -1).cast("long")
    kept = g.nodes.where(k % 5 != 0)
    new = kept.where(k % 7 == 0).select("id", F.lit("late").alias("label")).unionByName(spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("Extra-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("label")))
    values = kept.where(k % 11 == 0).select("id", F.lit("flag").alias("key"), F.lit("set").alias("value"))
    done = WR.update_graph(spark, base, WR.Batch(nodes=new, values=values, deleted_nodes=g.nodes.where(k % 5 == 0).select("id")))
    if not done.committed:
        raise ValueError(done.errors)
    return done.graph.nodes.select("id", "label", F.col("props")["flag"].alias("flag"))


_SOURCES = [
    ("app/main.py", "import os\nfrom app.util import helper, Tool\n\nLIMIT: int = 3\n\nclass App(Tool):\n    def run(self):\n        self.stop()\n        try:\n            helper()\n        except KeyError:\n            raise ValueError('x')\n\n    def stop(self):\n        return LIMIT\n"),
    ("app/util.py", "class Tool:\n    pass\n\ndef helper(x=1):\n    return [i for i in range(x) if i]\n"),
    ("app/bad.py", "def (:\n"),
]


def _built(spark):
    files = spark.createDataFrame(_SOURCES, "path string, content string")
    return extract.build_graph(files, spark.createDataFrame([("click>=8.0",), ("# none",)], "line string"))


_BUILT_NODES = """VALUES ('Class-app/main.py-App', 'App', 'Class'), ('Class-app/util.py-Tool', 'Tool', 'Class'), ('Dependency-click', 'click', 'Dependency'), ('Directory-.', '.', 'Directory'), ('Directory-app', 'app', 'Directory'),
('Exception-KeyError', 'KeyError', 'Exception'), ('Exception-ValueError', 'ValueError', 'Exception'), ('File-app/bad.py', 'bad.py', 'File'), ('File-app/main.py', 'main.py', 'File'), ('File-app/util.py', 'util.py', 'File'),
('Function-app/util.py-helper', 'helper', 'Function'), ('Import-File-app/main.py-0', 'os', 'Import'), ('Import-File-app/main.py-1', 'helper', 'Import'), ('Import-File-app/main.py-2', 'Tool', 'Import'),
('Method-app/main.py-App-run', 'run', 'Method'), ('Method-app/main.py-App-stop', 'stop', 'Method'), ('TypeAnnotation-int', 'int', 'TypeAnnotation'), ('Variable-File-app/main.py-LIMIT', 'LIMIT', 'Variable')"""
_BUILT_EDGES = """VALUES ('Class-app/main.py-App', 'CONTAINS', 'Method-app/main.py-App-run'), ('Class-app/main.py-App', 'CONTAINS', 'Method-app/main.py-App-stop'), ('Class-app/main.py-App', 'INHERITS', 'Class-app/util.py-Tool'),
('Directory-.', 'CONTAINS', 'Directory-app'), ('Directory-app', 'CONTAINS', 'File-app/bad.py'), ('Directory-app', 'CONTAINS', 'File-app/main.py'), ('Directory-app', 'CONTAINS', 'File-app/util.py'),
('File-app/bad.py', 'DEPENDS_ON', 'Dependency-click'), ('File-app/main.py', 'DEPENDS_ON', 'Dependency-click'), ('File-app/util.py', 'DEPENDS_ON', 'Dependency-click'),
('File-app/main.py', 'CONTAINS', 'Class-app/main.py-App'), ('File-app/main.py', 'CONTAINS', 'Import-File-app/main.py-0'), ('File-app/main.py', 'CONTAINS', 'Import-File-app/main.py-1'), ('File-app/main.py', 'CONTAINS', 'Import-File-app/main.py-2'), ('File-app/main.py', 'CONTAINS', 'Variable-File-app/main.py-LIMIT'),
('File-app/main.py', 'IMPORTS', 'Class-app/util.py-Tool'), ('File-app/main.py', 'IMPORTS', 'Function-app/util.py-helper'), ('File-app/util.py', 'CONTAINS', 'Class-app/util.py-Tool'), ('File-app/util.py', 'CONTAINS', 'Function-app/util.py-helper'),
('Method-app/main.py-App-run', 'CALLS', 'Function-app/util.py-helper'), ('Method-app/main.py-App-run', 'CALLS', 'Method-app/main.py-App-stop'), ('Method-app/main.py-App-run', 'CATCHES', 'Exception-KeyError'), ('Method-app/main.py-App-run', 'RAISES', 'Exception-ValueError'),
('Variable-File-app/main.py-LIMIT', 'HAS_TYPE', 'TypeAnnotation-int')"""


@query("graph_build_nodes", f"SELECT * FROM ({_BUILT_NODES}) AS v(id, label, meta_type)")
def graph_build_nodes(spark, d):
    return _built(spark)[0].nodes.select("id", "label", "meta_type")


@query("graph_build_edges", f"SELECT source || '-' || label || '-' || target AS id, label, source, target FROM ({_BUILT_EDGES}) AS v(source, label, target)")
def graph_build_edges(spark, d):
    return _built(spark)[0].edges.select("id", "label", "source", "target")


@query("graph_build_errors", "SELECT 'app/bad.py' AS path, 'SyntaxError' AS error")
def graph_build_errors(spark, d):
    return _built(spark)[1].select("path", "error")


_EDITED = r"""s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p, text FROM documents), l AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM s),
e AS (SELECT doc_id, ls, least(len(ls), 4) AS m, text <> '' AND ls[1] <> '' AND len(list_filter(ls, lambda x: x = ls[1])) = 1 AS good FROM l)"""


@query("document_edits", f"""WITH {_EDITED} SELECT CAST(doc_id AS VARCHAR) AS instance, CASE WHEN good THEN 'diff --git a/doc b/doc' || chr(10) || '--- a/doc' || chr(10) || '+++ b/doc' || chr(10) || CASE WHEN m = 1 THEN '@@ -1 +1 @@' ELSE '@@ -1,' || m || ' +1,' || m || ' @@' END || chr(10) || '-' || ls[1] || chr(10) || '+new first line' || chr(10)
|| array_to_string(list_transform(ls[2:4], lambda x: ' ' || x || chr(10)), '') ELSE '' END AS patch, CASE WHEN good THEN 0 ELSE 1 END AS failed FROM e""")
def document_edits(spark, d):
    """A patch for every document: its first line replaced, where that line stands alone once."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = F.split("text", "\n")[0]
    answer = F.concat(F.lit("### doc\n<<<<<<< SEARCH\n"), first, F.lit("\n=======\nnew first line\n>>>>>>> REPLACE\n"))
    rows = docs.select(F.col("doc_id").cast("string").alias("instance"), answer.alias("answer"), F.create_map(F.lit("doc"), F.col("text")).alias("files"))
    return repair.patches(rows)


@query("patch_hunks", f"WITH {_EDITED} SELECT CAST(doc_id AS VARCHAR) AS instance, CAST(0 AS INTEGER) AS hunk_id, 'doc' AS file, CAST(1 AS BIGINT) AS h_start, CAST(m AS BIGINT) AS h_end, CAST(m AS BIGINT) AS count, false AS is_new_file FROM e WHERE good")
def patch_hunks(spark, d):
    return repair.hunk_rows(document_edits(spark, d).select("instance", "patch"))


@query("build_phases", f"SELECT (SELECT count(*) FROM ({_BUILT_NODES}) AS v(a, b, c)) AS nodes, (SELECT count(*) FROM ({_BUILT_EDGES}) AS v(a, b, c)) - 1 AS edges, 1 AS skipped, 'python:folders,python:sources,python:dependencies,python:links' AS ran, 0 AS errors")
def build_phases(spark, d):
    """The same sources by a schema's executors, phase by phase; one edge has a signature that the schema doesn't allow."""
    files = spark.createDataFrame(_SOURCES, "path string, content string")
    kinds = {"Directory": "python:folders", "File": "python:folders", "Function": "python:sources", "Dependency": "python:dependencies"}
    meta = G.from_rows(spark, [(k, k) for k in (*kinds, "CALLS")], [], {k: {"meta_type": "NodeType", "executor": v} for k, v in kinds.items()} | {"CALLS": {"meta_type": "EdgeType", "executor": "python:links"}})
    ran = builder.resolve(builder.schema_executors(meta))
    allowed = spark.createDataFrame([("CALLS", "Method", "Method"), ("INHERITS", "Class", "Class")], "label string, source_type string, target_type string")
    graph, told = builder.build(spark, files, sorted(ran, key=lambda e: (e.phase, e.name != "python:sources")), allowed, spark.createDataFrame([("click>=8.0",), ("# none",)], "line string"))
    return spark.createDataFrame([(graph.nodes.count(), graph.edges.count(), told.skipped_edges, ",".join(e.name for e in sorted(ran, key=lambda e: (e.phase, e.name != "python:sources"))), len(told.errors))], "nodes long, edges long, skipped int, ran string, errors int")


@query("set_cover", """WITH RECURSIVE offers AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), need AS (SELECT DISTINCT l_orderkey AS instance, l_partkey AS p FROM lineitem),
sets AS (SELECT instance, CAST(l_suppkey AS VARCHAR) AS id, any_value(s_acctbal) + 2000 AS cost, list(p) AS els FROM need JOIN offers ON l_partkey = p JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
r AS (SELECT instance, list(DISTINCT p) AS rest, CAST([] AS VARCHAR[]) AS picked FROM (SELECT instance, unnest(els) AS p FROM sets) GROUP BY 1
UNION ALL SELECT instance, list_filter(rest, lambda x: NOT list_contains(best.els, x)), list_append(picked, best.id) FROM (
  SELECT r.instance, rest, picked, arg_min(struct_pack(id := id, els := els), struct_pack(a := -(len(list_intersect(els, rest)) / cost), b := cost, c := id)) AS best FROM r JOIN sets ON sets.instance = r.instance WHERE len(list_intersect(els, rest)) > 0 GROUP BY r.instance, rest, picked))
SELECT CAST(instance AS VARCHAR) AS instance, picked FROM r WHERE len(rest) = 0""")
def set_cover(spark, d):
    """For each order, suppliers picked greedily to cover its parts, cheapest by balance."""
    li, s = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    need = li.select(F.col("l_orderkey").alias("instance"), F.col("l_partkey").alias("element"))
    offers = li.select(F.col("l_partkey").alias("element"), F.col("l_suppkey").alias("set_id"))
    picked = repair.offered_covers(need, offers, s.select(F.col("s_suppkey").alias("set_id"), (F.col("s_acctbal") + 2000).alias("cost")))
    return picked.select(F.col("instance").cast("string").alias("instance"), "picked")


@query("short_span_totals", """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS id, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber AS b FROM lineitem)
SELECT k, count(*) AS nodes, CAST(sum(b - a + 1) AS BIGINT) AS lines FROM p WHERE a <= 10 GROUP BY k""")
def short_span_totals(spark, d):
    """Spans and their lines by order, of those that start at line 10 or before."""
    q = F.col("l_quantity").cast("long")
    p = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), q.alias("a"), (q + F.col("l_linenumber")).alias("b"))
    return p.where("a <= 10").groupBy("k").agg(F.count("*").alias("nodes"), F.sum(F.col("b") - F.col("a") + 1).alias("lines"))


@query("call_counts", "SELECT event_type AS fn, count(*) AS n, count(*) FILTER (value < 1) AS failures FROM events GROUP BY 1")
def call_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return explore.call_counts(e.select(F.col("event_type").alias("fn"), (F.col("value") < 1).alias("failed")))


@query("merged_line_ranges", """WITH s AS (SELECT l_orderkey AS instance, l_suppkey AS path, greatest(CAST(l_quantity AS BIGINT) - 5, 1) AS a, CAST(l_quantity AS BIGINT) + 8 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY instance, path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
i AS (SELECT *, sum(CASE WHEN a <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY instance, path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT instance, path, min(a) AS "start", max(b) AS "end", count(*) AS n FROM i GROUP BY instance, path, g""")
def merged_line_ranges(spark, d):
    """Line ranges of each order's lines, widened by 5, merged and counted. Nothing is packed here."""
    q = F.col("l_quantity").cast("long")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("instance"), F.col("l_suppkey").alias("path"), q.alias("start"), (q + 3).alias("end"))
    return S.merge_intervals(rows, ["instance", "path"], 5)
