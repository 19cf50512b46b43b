"""Localisation, context, cover and cost queries over the driver's tables, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import localise as L
from ..operators import reports as RE
from .table_queries import _HUNKS, _IN, _NODES, _OVER, hunks, read, span_nodes

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Touches: a customer's order lines in order, each touching its part in a file of its supplier.
_LI = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"
_TOUCHES = _LI + """, touches AS (SELECT o_custkey AS instance, l_orderkey * 10 + l_linenumber AS seq, 'Method-m-' || l_partkey AS id, 'p' || (l_suppkey % 7) || CASE WHEN l_suppkey % 5 = 0 THEN '.txt' ELSE '.py' END AS path, l_partkey AS part FROM li JOIN orders ON l_orderkey = o_orderkey)"""
_SIMS = "sims AS (SELECT DISTINCT instance, id, part % 96 / 128.0 AS sim FROM touches WHERE path <> 'p3.py')"


def order_lines(spark, d):
    """One row for each order and line number, which the table repeats."""
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])


def touches(spark, d):
    rows = order_lines(spark, d).join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey")
    text = part.cast("string")
    props = F.when(part % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.map_filter(F.create_map(F.lit("meta_type"), F.lit("Method"), F.lit("name"), F.when(part % 2 == 0, F.concat(F.lit("n"), text)), F.lit("docstring"), F.concat(F.lit(" Doc "), text, F.lit("\nmore")), F.lit("source_code"), F.concat(F.lit("\n def f():\n  return "), text, F.lit(" "))), lambda k, v: v.isNotNull())
    )
    path = F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 5 == 0, ".txt").otherwise(".py"))
    return rows.select(F.col("o_custkey").alias("instance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("Method-m-"), text).alias("id"), path.alias("path"), part.alias("part"), props.alias("props"))


def sims(t):
    return t.where("path <> 'p3.py'").select("instance", "id", (F.col("part") % 96 / 128).alias("sim")).distinct()


@query("touch_frequency", f"WITH {_TOUCHES} SELECT instance, id, count(*) AS freq FROM touches GROUP BY 1, 2")
def touch_frequency(spark, d):
    return L.touch_frequency(touches(spark, d))


_HEAD = "left('def f():' || chr(10) || '  return ' || part, 14)"


@query("node_signals", f"""WITH {_TOUCHES}, {_SIMS}, n AS (SELECT DISTINCT instance, id, path, part FROM touches WHERE path LIKE '%.py' AND path < 'p5'),
f AS (SELECT instance, id, count(*) AS freq FROM touches WHERE path <> 'p2.py' GROUP BY 1, 2), s AS (SELECT n.*, coalesce(freq, 0) AS touch_freq, sim FROM n LEFT JOIN f USING (instance, id) LEFT JOIN sims USING (instance, id))
SELECT instance, CAST(row_number() OVER (PARTITION BY instance ORDER BY touch_freq DESC, id, path) AS BIGINT) AS pos, id, path, CAST(part AS VARCHAR) AS name, touch_freq, {_HEAD} AS head, sim FROM s""")
def node_signals(spark, d):
    t = touches(spark, d)
    source = F.concat(F.lit("\n def f():\n  return "), F.col("part").cast("string"), F.lit(" "))
    nodes = t.groupBy("instance", "id", "path", "part").agg(F.lit("Method").alias("kind"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end")).withColumn("source_code", source)
    out = L.node_signals(nodes, t.where("path <> 'p2.py'"), t.where("path < 'p5'").select("instance", "path"), sims(t), 14)
    from pyspark.sql import Window as W

    # A part that lies in several files is several nodes of one id here, so the path breaks ties.
    return out.select("instance", F.row_number().over(W.partitionBy("instance").orderBy(F.desc("touch_freq"), "id", "path")).cast("long").alias("pos"), "id", "path", "name", "touch_freq", "head", "sim")


@query("file_signals_parts", f"""WITH {_TOUCHES}, {_SIMS}, t AS (SELECT touches.*, sim FROM touches LEFT JOIN sims USING (instance, id) WHERE path LIKE '%.py'),
k AS (SELECT *, row_number() OVER (PARTITION BY instance, path ORDER BY sim DESC NULLS LAST, seq) AS ks, sum(CASE WHEN part % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance, path ORDER BY seq) AS kp FROM t),
a AS (SELECT instance, path, count(*) AS touch_freq, min(seq) AS first_seq, max(sim) AS sim_max, round(avg(CASE WHEN ks <= 3 THEN sim END), 4) AS sim_mean,
  count(*) FILTER (part % 3 <> 0 AND kp <= 3) AS n_parts, string_agg(CASE WHEN part % 2 = 0 THEN 'n' ELSE '' END || part || ' Doc ' || part || ' def f(): |   return ' || part, ';' ORDER BY seq) FILTER (part % 3 <> 0 AND kp <= 3) AS parts FROM k GROUP BY 1, 2)
SELECT instance, CAST(row_number() OVER (PARTITION BY instance ORDER BY touch_freq DESC, first_seq, path) AS BIGINT) AS pos, path, touch_freq, sim_max, sim_mean, n_parts, coalesce(parts, '') AS parts FROM a""")
def file_signals_parts(spark, d):
    t = touches(spark, d)
    told = F.transform("parts", lambda x: F.concat_ws(" ", x["name"], x["docstring"], x["source"]))
    return L.file_signals(t, sims(t)).select("instance", F.col("pos").cast("long").alias("pos"), "path", "touch_freq", "sim_max", "sim_mean", F.size("parts").cast("long").alias("n_parts"), F.array_join(told, ";").alias("parts"))


def _blocks(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col("c_nationkey").alias("instance"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("item"), F.concat(F.lit("### "), "c_name", F.lit("\n"), "c_mktsegment").alias("block"))


def _issues(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("instance"), F.col("n_name").alias("issue"))


_FIXED = sum(len(x.format(k=5)) for x in L.FRAME)
_BLOCKS = "b AS (SELECT c_nationkey AS instance, c_custkey AS pos, c_name AS item, length('### ' || c_name || '|' || c_mktsegment) AS size, length(n_name) AS issue, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query("list_prompts", f"""WITH RECURSIVE {_BLOCKS}, f AS (SELECT instance, r, 0 AS chunk, size + 2 AS used, size, issue FROM b WHERE r = 1
UNION ALL SELECT b.instance, b.r, CASE WHEN used + b.size + 2 > 400 - {_FIXED} - 1 - b.issue THEN chunk + 1 ELSE chunk END, CASE WHEN used + b.size + 2 > 400 - {_FIXED} - 1 - b.issue THEN b.size + 2 ELSE used + b.size + 2 END, b.size, b.issue FROM f JOIN b ON b.instance = f.instance AND b.r = f.r + 1)
SELECT instance, chunk, count(*) AS n, CAST({_FIXED} + any_value(issue) + length(CAST(count(*) AS VARCHAR)) + sum(size) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM f GROUP BY 1, 2""")
def list_prompts(spark, d):
    out = L.list_prompts(_blocks(spark, d), _issues(spark, d), 5, 400)
    return out.select(F.col("instance"), "chunk", F.size("items").cast("long").alias("n"), F.length("prompt").cast("long").alias("chars"))


def likes_last(prompt: str, temperature: float, thinking: bool) -> str:
    """A stand-in for a model, which names the last candidates by name; without the heat of a third attempt it fails on some."""
    names = sorted(re.findall(r"(?m)^### (.+)$", prompt), reverse=True)[:5]
    issue = re.search(r"Issue:\n(.*)\n", prompt)[1]
    if issue.endswith("A") and temperature < 0.5:
        return "no answer"
    return "Sure: " + json.dumps(names)


@query("rank_listwise", f"""WITH {_BLOCKS}, t AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY item DESC) AS k FROM b), o AS (SELECT instance, item, row_number() OVER (PARTITION BY instance ORDER BY CASE WHEN k <= 5 THEN k ELSE 100 END, pos) AS rank FROM t)
SELECT o.instance, string_agg(item, ',' ORDER BY rank) AS ranked, false AS failed, count(*) AS n_files, CAST(CASE WHEN count(*) = 1 THEN 0 WHEN any_value(n_name) LIKE '%A' THEN 3 ELSE 1 END AS BIGINT) AS n_comparisons FROM o JOIN nation ON n_nationkey = o.instance GROUP BY 1""")
def rank_listwise(spark, d):
    out = L.rank_listwise(_blocks(spark, d), _issues(spark, d), likes_last, 5, 10**7)
    return out.select("instance", F.array_join("ranked", ",").alias("ranked"), "failed", "n_files", "n_comparisons")


# Hunks and nodes as in hunk_classify, an order each; pools by supplier, part and line.
_COVER = f"""h AS ({_HUNKS}), n0 AS ({_NODES}), n AS (SELECT file AS instance, file, node_id, min(line_start) AS line_start, min(line_end) AS line_end FROM n0 GROUP BY ALL), p AS (SELECT 'all' AS pool, instance, node_id FROM n UNION ALL SELECT 'file1', instance, node_id FROM n WHERE node_id <= 4 UNION ALL SELECT 'touched', instance, node_id FROM n WHERE node_id >= 3),
names AS (SELECT DISTINCT pool FROM p), hp AS (SELECT names.pool, h.* FROM h, names), np AS (SELECT pool, n.* FROM p JOIN n USING (instance, node_id)),
c AS (SELECT hp.pool, hp.hunk_id, any_value(hp.is_new_file) AS new, any_value(hp.count) AS count, max(CASE WHEN {_IN} THEN 1 ELSE 0 END) AS c, max(CASE WHEN {_OVER} THEN 1 ELSE 0 END) AS o FROM hp LEFT JOIN np ON np.pool = hp.pool AND np.file = hp.file GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN new THEN 'new' WHEN c = 1 THEN 'contained' WHEN o = 1 THEN 'partial' ELSE 'outside' END AS class FROM c),
g AS (SELECT DISTINCT h.file AS instance, n.node_id FROM h JOIN n ON n.file = h.file WHERE NOT is_new_file AND {_OVER}),
s AS (SELECT pool, p.instance, count(*) AS pool_size, count(g.node_id) AS gt_in_pool FROM p LEFT JOIN g ON g.instance = p.instance AND g.node_id = p.node_id GROUP BY 1, 2), gs AS (SELECT instance, count(*) AS gt_nodes FROM g GROUP BY 1),
r AS (SELECT k.pool, k.hunk_id AS instance, coalesce(pool_size, 0) AS pool_size, coalesce(gt_nodes, 0) AS gt_nodes, coalesce(gt_in_pool, 0) AS gt_in_pool, coalesce(gt_in_pool, 0) / nullif(gt_nodes, 0) AS pool_recall, class, CASE WHEN class = 'contained' THEN 0 ELSE 1 END AS fallback_hunks, CASE WHEN class <> 'new' AND k.count > 0 THEN CASE WHEN class = 'contained' THEN CAST(1 AS DOUBLE) ELSE 0 END END AS line_share FROM k LEFT JOIN s ON s.pool = k.pool AND s.instance = k.hunk_id LEFT JOIN gs ON gs.instance = k.hunk_id)"""


def _cover(spark, d):
    h = hunks(spark, d).withColumn("instance", F.col("file"))
    one = span_nodes(spark, d).groupBy("file", "node_id").agg(F.min("line_start").alias("line_start"), F.min("line_end").alias("line_end"))
    n = one.select(F.col("file").alias("instance"), F.col("node_id").alias("id"), "file", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("cost"))
    pools = n.where("id <= 4").select(F.lit("file1").alias("pool"), "instance", "id").unionByName(n.where("id >= 3").select(F.lit("touched").alias("pool"), "instance", "id"))
    return RE.node_cover(h, n, pools)


@query("node_cover", f"WITH {_COVER}, cost AS (SELECT np.pool, np.file AS instance, min(line_end - line_start + 1) AS c FROM hp JOIN np ON np.pool = hp.pool AND np.file = hp.file WHERE NOT is_new_file AND {_IN} GROUP BY 1, 2) SELECT pool, instance, pool_size, gt_nodes, gt_in_pool, pool_recall, CAST(fallback_hunks AS BIGINT) AS fallback_hunks, line_share, CAST(CASE WHEN class = 'contained' THEN c ELSE 0 END AS BIGINT) AS floor_tokens FROM r LEFT JOIN cost USING (pool, instance)")
def node_cover(spark, d):
    """One hunk an order, so the cheapest node that contains it is its cover."""
    return _cover(spark, d).select("pool", "instance", "pool_size", "gt_nodes", "gt_in_pool", "pool_recall", "fallback_hunks", F.col("line_share").cast("double").alias("line_share"), "floor_tokens")


@query("cover_report", f"WITH {_COVER} SELECT pool, count(*) AS n, count(*) FILTER (class = 'contained') / count(*) FILTER (class <> 'new') AS hunk_share, avg(line_share) AS line_share, avg(pool_recall) AS pool_recall, avg(1 - fallback_hunks) AS fully_covered, CAST(list_sort(list(pool_size))[count(*) // 2 + 1] AS DOUBLE) AS pool_size FROM r GROUP BY 1")
def cover_report(spark, d):
    out = RE.cover_report(_cover(spark, d))
    return out.select("pool", "n", *[F.col(c).cast("double").alias(c) for c in ("hunk_share", "line_share", "pool_recall", "fully_covered", "pool_size")])


@query("node_pools", f"""WITH {_TOUCHES}, n AS (SELECT DISTINCT instance, id, path FROM touches), k AS (SELECT instance, path, row_number() OVER (PARTITION BY instance ORDER BY count(*) DESC, path) AS pos FROM touches GROUP BY 1, 2), t AS (SELECT DISTINCT instance, id FROM touches WHERE path < 'p4')
SELECT 'file1' AS pool, count(*) AS n FROM n JOIN k USING (instance, path) WHERE pos <= 1 UNION ALL SELECT 'file3', count(*) FROM n JOIN k USING (instance, path) WHERE pos <= 3 UNION ALL SELECT 'file5', count(*) FROM n JOIN k USING (instance, path) WHERE pos <= 5
UNION ALL SELECT 'touched', count(*) FROM n JOIN t USING (instance, id) UNION ALL SELECT 'touched_file5', count(*) FROM n JOIN t USING (instance, id) JOIN k USING (instance, path) WHERE pos <= 5""")
def node_pools(spark, d):
    from pyspark.sql import Window as W

    t = touches(spark, d)
    ranked = t.groupBy("instance", "path").agg(F.count("*").alias("n")).withColumn("pos", F.row_number().over(W.partitionBy("instance").orderBy(F.desc("n"), "path")))
    return L.pools(t.select("instance", "id", "path").distinct(), t.where("path < 'p4'"), ranked).groupBy("pool").agg(F.count("*").alias("n"))


# Methods: an order's contexts show its parts as files; its patch writes that of the first line.
_NAME = "'src/' || l_partkey || '.py'"
_METHODS = f"""{_LI}, i AS (SELECT l_orderkey AS instance, string_agg('[start of ' || {_NAME} || ']' || chr(10) || 'x' || chr(10) || '[end of ' || {_NAME} || ']', chr(10) ORDER BY l_linenumber) AS pool, count(DISTINCT l_partkey) AS files, arg_min(l_partkey, l_linenumber) AS gt, list(l_partkey) AS parts FROM li GROUP BY 1),
o AS (SELECT i.*, o_orderpriority AS issue FROM i JOIN orders ON o_orderkey = instance),
s AS (SELECT l_orderkey AS instance, '[start of ' || {_NAME} || ']' || chr(10) AS prompt, l_returnflag || l_linestatus AS output, l_partkey AS part FROM li WHERE l_linenumber = 2),
fd AS (SELECT l_orderkey AS instance, list({_NAME}) AS found, count(*) AS n, sum(CASE WHEN l_partkey % 3 <> 0 THEN (length(p_name) + 8) // 4 ELSE 0 END) AS t, list(l_partkey) AS parts FROM li JOIN part ON p_partkey = l_partkey WHERE l_linenumber >= 2 GROUP BY 1),
rec AS (SELECT 'kg_pool' AS method, instance, length(pool) // 4 AS tokens, files, true AS hit, NULL AS from_pool, NULL AS output_tokens FROM o
UNION ALL SELECT 'kg_sr', o.instance, length(coalesce(prompt, pool)) // 4, CASE WHEN prompt IS NULL THEN files ELSE 1 END, CASE WHEN prompt IS NULL THEN true ELSE gt = part END, prompt IS NULL, length(output) // 4 FROM o LEFT JOIN s USING (instance)
UNION ALL SELECT 'bm25_k5', o.instance, length(prompt) // 4, CASE WHEN prompt IS NULL THEN 0 ELSE 1 END, CASE WHEN prompt IS NOT NULL THEN gt = part END, NULL, NULL FROM o LEFT JOIN s USING (instance)
UNION ALL SELECT 'agentless', o.instance, length(issue) // 4 + coalesce(t, 0), coalesce(n, 0), coalesce(list_contains(fd.parts, gt), false), NULL, NULL FROM o LEFT JOIN fd USING (instance))"""


def _records(spark, d):
    li = order_lines(spark, d)
    name = F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py"))
    start = F.concat(F.lit("[start of "), name, F.lit("]\n"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(start, F.lit("x\n[end of "), name, F.lit("]")).alias("t"), name.alias("name"))))
    own = li.groupBy(F.col("l_orderkey").alias("instance")).agg(lines.alias("s"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("instance"), F.col("o_orderpriority").alias("issue"))
    instances = own.join(o, "instance").select("instance", "issue", F.concat(F.lit("--- a/x\n+++ b/"), F.col("s")[0]["name"], F.lit("\n@@ -1 +1 @@\n")).alias("patch"), F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text_inputs"))
    second = li.where("l_linenumber = 2").select(F.col("l_orderkey").alias("instance"), start.alias("prompt"), F.concat("l_returnflag", "l_linestatus", F.lit("")).alias("output"))
    found = li.where("l_linenumber >= 2").groupBy(F.col("l_orderkey").alias("instance")).agg(F.collect_list(name).alias("found_files"))
    parts = li.where("l_partkey % 3 <> 0").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    corpus = parts.select(F.col("l_orderkey").alias("instance"), name.alias("path"), F.concat("p_name", F.lit(" content")).alias("contents")).distinct()
    return RE.method_records(instances, second.select("instance", F.col("prompt").alias("text")), found, corpus, second)


@query("method_records", f"WITH {_METHODS} SELECT method, instance, CAST(tokens AS BIGINT) AS tokens, CAST(files AS BIGINT) AS files, hit, from_pool, CAST(output_tokens AS BIGINT) AS output_tokens FROM rec")
def method_records(spark, d):
    return _records(spark, d)


@query("method_report", f"""WITH {_METHODS}, v AS (SELECT * FROM rec WHERE tokens IS NOT NULL) SELECT method, count(*) AS n, avg(files) AS avg_files, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS acc, sum(tokens) / nullif(count(*) FILTER (hit), 0) AS tokens_per_hit, avg(tokens) AS mean, median(tokens) AS median, CAST(quantile_disc(tokens, 0.9) AS DOUBLE) AS p90,
count(*) FILTER (from_pool) AS n_fallback, count(output_tokens) AS output_n, avg(output_tokens) AS output_mean FROM v GROUP BY 1""")
def method_report(spark, d):
    return RE.method_report(_records(spark, d)).drop("output_median", "output_p90")


@query("usage_summary", """WITH u AS (SELECT event_type AS stage, floor(value) AS p, event_id % 50 AS c, 1 + event_id % 3 AS k FROM events) SELECT stage, count(*) AS n, avg(k) AS avg_calls, avg(p) AS prompt_mean, median(p) AS prompt_median, quantile_disc(p, 0.9) AS prompt_p90,
avg(c) AS completion_mean, median(c) AS completion_median, CAST(quantile_disc(c, 0.9) AS DOUBLE) AS completion_p90, avg(p + c) AS total_mean, median(p + c) AS total_median, quantile_disc(p + c, 0.9) AS total_p90 FROM u GROUP BY 1""")
def usage_summary(spark, d):
    e = read(spark, d, "events")
    return RE.usage_summary(e.select(F.col("event_type").alias("stage"), F.col("event_id").alias("instance"), F.floor("value").alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), (1 + F.col("event_id") % 3).alias("calls")))


@query("solve_summary", """WITH s AS (SELECT lang, length(text) // 4 AS i, length(text || lang) // 4 AS o, text <> '' AS ti, lang <> 'de' AS t FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (t) AS output_n, avg(CASE WHEN ti THEN i END) AS input_mean, median(CASE WHEN ti THEN i END) AS input_median, CAST(quantile_disc(CASE WHEN ti THEN i END, 0.9) AS DOUBLE) AS input_p90,
avg(CASE WHEN t THEN o END) AS output_mean, median(CASE WHEN t THEN o END) AS output_median, CAST(quantile_disc(CASE WHEN t THEN o END, 0.9) AS DOUBLE) AS output_p90, avg(CASE WHEN ti THEN i + CASE WHEN t THEN o ELSE 0 END END) AS total_mean, median(CASE WHEN ti THEN i + CASE WHEN t THEN o ELSE 0 END END) AS total_median, CAST(quantile_disc(CASE WHEN ti THEN i + CASE WHEN t THEN o ELSE 0 END END, 0.9) AS DOUBLE) AS total_p90 FROM s GROUP BY 1""")
def solve_summary(spark, d):
    rows = read(spark, d, "documents").select("lang", F.col("text").alias("prompt"), F.when(F.col("lang") != "de", F.concat("text", "lang")).alias("output"))
    return RE.solve_summary(rows, ["lang"])


_RERANK = """p AS (SELECT l_orderkey AS instance, count(*) AS n_chunks, sum(CAST(l_quantity AS BIGINT) * 10) AS t FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), c AS (SELECT o_orderkey AS instance, o_custkey % 5 AS n, o_custkey % 90 AS a FROM orders),
r AS (SELECT instance, coalesce(n_chunks, 0) AS n_chunks, CAST(coalesce(round_even(CASE WHEN n > 0 THEN t * (n / n_chunks) ELSE t END, 0), 0) AS BIGINT) AS input_tokens, CAST(CASE WHEN n_chunks IS NULL THEN 0 ELSE a + 16 END AS BIGINT) AS output_tokens_estimate, CASE WHEN n_chunks IS NULL THEN NULL WHEN n > 0 THEN round_even(n / n_chunks, 3) ELSE 1.0 END AS retry_multiplier FROM c LEFT JOIN p USING (instance))"""


def _costs(spark, d):
    o = read(spark, d, "orders")
    prompts = read(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("instance"), (F.col("l_quantity").cast("long") * 10).alias("tokens"))
    calls = o.select(F.col("o_orderkey").alias("instance"), (F.col("o_custkey") % 5).alias("n_calls"))
    return RE.rerank_cost(prompts, calls, o.select(F.col("o_orderkey").alias("instance"), (F.col("o_custkey") % 90).alias("tokens")))


@query("rerank_cost", f"WITH {_RERANK} SELECT * FROM r")
def rerank_cost(spark, d):
    return _costs(spark, d)


@query("rerank_summary", f"WITH {_RERANK}, k AS (SELECT instance % 3 AS third, r.* FROM r) SELECT third, count(*) AS n, avg(input_tokens) AS mean_input, avg(output_tokens_estimate) AS mean_output, avg(n_chunks) AS avg_chunks, avg(coalesce(retry_multiplier, 1.0)) AS avg_retry, CAST(list_sort(list(input_tokens))[count(*) // 2 + 1] AS DOUBLE) AS median_input FROM k GROUP BY 1")
def rerank_summary(spark, d):
    return RE.rerank_summary(_costs(spark, d).withColumn("third", F.col("instance") % 3), ["third"])


@query("embed_totals", "SELECT count(DISTINCT source) AS graphs, count(*) AS nodes, CAST(sum(least(length(text) + 8, 2000)) AS BIGINT) AS total_chars FROM documents")
def embed_totals(spark, d):
    return RE.embed_totals(read(spark, d, "documents").select(F.col("source").alias("graph"), "text"), "passage ", 2000)


# Contexts: a source's documents are its files, the French ones missing; ranked by id.
_FILES = "f AS (SELECT source AS instance, 'd' || doc_id || '.txt' AS path, doc_id AS rank, text AS content FROM documents WHERE lang <> 'fr')"
_BODY = "'[start of ' || path || ']' || chr(10) || content || chr(10) || '[end of ' || path || ']'"


def _files(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("instance"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("rank"), F.col("text").alias("content"), "lang")


def _there(f):
    """The files that are there."""
    return f.where("lang <> 'fr'").drop("rank", "lang")


def _asked(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("instance")).distinct().withColumn("issue", F.concat(F.lit("broken "), "instance"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPT = f"{_quoted(C.HEADER)} || 'broken ' || i.instance || {_quoted(chr(10) + '</issue>' + chr(10) + '<code>' + chr(10))} || coalesce(body, '') || {_quoted(chr(10) + '</code>')} || {_quoted(C.FOOTER)}"
_PACKED = f"t AS (SELECT *, sum(length(content) // 3) OVER (PARTITION BY instance ORDER BY rank) AS total, row_number() OVER (PARTITION BY instance ORDER BY rank) AS r FROM f), k AS (SELECT * FROM t WHERE r = 1 OR total <= 5000), b AS (SELECT instance, string_agg({_BODY}, chr(10) ORDER BY rank) AS body FROM k GROUP BY 1), i AS (SELECT DISTINCT source AS instance FROM documents)"


@query("context_file_level", f"WITH {_FILES}, b AS (SELECT instance, string_agg({_BODY}, chr(10) ORDER BY rank) AS body FROM f GROUP BY 1), i AS (SELECT DISTINCT source AS instance FROM documents) SELECT i.instance, md5({_PROMPT}) AS context FROM i LEFT JOIN b ON b.instance = i.instance")
def context_file_level(spark, d):
    f = _files(spark, d)
    return C.file_level(f.drop("content", "lang"), _there(f), _asked(spark, d)).select("instance", F.md5("context").alias("context"))


@query("context_budget", f"WITH {_FILES}, {_PACKED} SELECT i.instance, md5({_PROMPT}) AS context FROM i LEFT JOIN b ON b.instance = i.instance")
def context_budget(spark, d):
    f = _files(spark, d)
    return C.file_level(f.drop("content", "lang"), _there(f), _asked(spark, d), 5000).select("instance", F.md5("context").alias("context"))


@query("context_oracle", f"WITH {_FILES}, {_PACKED}, x AS (SELECT d.source AS instance, string_agg('d' || doc_id || '.txt', ',' ORDER BY 'd' || doc_id || '.txt') FILTER (k.path IS NULL) AS dropped FROM documents d LEFT JOIN k ON k.instance = d.source AND k.rank = d.doc_id GROUP BY 1) SELECT i.instance, md5({_PROMPT}) AS context, coalesce(dropped, '') AS dropped FROM i LEFT JOIN b ON b.instance = i.instance LEFT JOIN x ON x.instance = i.instance")
def context_oracle(spark, d):
    f = _files(spark, d)
    out = C.gold_files(f.drop("content", "lang"), _there(f), _asked(spark, d), 5000)
    return out.select("instance", F.md5("context").alias("context"), F.array_join("dropped", ",").alias("dropped"))
