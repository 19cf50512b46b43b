"""Ranking, metric, span, packing, vector, text and set queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import rank as R
from ..operators import spans as S
from ..operators import vectors as V

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# Ranked lists: a customer's parts by quantity (method qty) and by price (method price); gold: the parts of the last order.
_LISTS = """last AS (SELECT o_custkey AS instance, max(struct_pack(a := o_orderdate, b := o_orderkey)).b AS o FROM orders GROUP BY 1),
gold AS (SELECT DISTINCT instance, 'Part-' || l_partkey AS item FROM last JOIN lineitem ON l_orderkey = o),
sums AS (SELECT o_custkey AS instance, l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, max(l_extendedprice) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ranked AS (SELECT 'qty' AS method, instance, 'Part-' || l_partkey AS item, row_number() OVER (PARTITION BY instance ORDER BY q DESC, l_partkey) AS pos FROM sums
UNION ALL SELECT 'price', instance, 'Part-' || l_partkey, row_number() OVER (PARTITION BY instance ORDER BY p DESC, l_partkey) FROM sums)"""


def lists(spark, d):
    from pyspark.sql import Window as W

    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    last = o.groupBy(F.col("o_custkey").alias("instance")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    part = F.concat(F.lit("Part-"), F.col("l_partkey").cast("string")).alias("item")
    gold = li.join(last, "l_orderkey").select("instance", part).distinct()
    sums = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("instance"), "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.max("l_extendedprice").alias("p"))
    out = None
    for method, c in (("qty", "q"), ("price", "p")):
        pos = F.row_number().over(W.partitionBy("instance").orderBy(F.desc(c), "l_partkey"))
        own = sums.select(F.lit(method).alias("method"), "instance", part, pos.alias("pos"))
        out = own if out is None else out.unionByName(own)
    return out, gold


_METRIC_COLUMNS = ", ".join(f"round(avg(h{k} / g), 6) AS recall_frac_{k}, round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0 END), 6) AS hit_any_{k}, round(avg(CASE WHEN h{k} = g THEN 1.0 ELSE 0 END), 6) AS cover_{k}" for k in E.KS)


@query("recall_cov_at_k", f"""WITH {_LISTS}, g AS (SELECT instance, count(*) AS g FROM gold GROUP BY 1),
h AS (SELECT method, instance, {', '.join(f'count(CASE WHEN pos <= {k} THEN 1 END) AS h{k}' for k in E.KS)} FROM ranked JOIN gold USING (instance, item) GROUP BY 1, 2),
m AS (SELECT unnest(['qty', 'price']) AS method)
SELECT m.method, count(*) AS instances, {_METRIC_COLUMNS} FROM (SELECT m.method, g.instance, g, {', '.join(f'coalesce(h{k}, 0) AS h{k}' for k in E.KS)} FROM g CROSS JOIN m LEFT JOIN h ON h.method = m.method AND h.instance = g.instance) m GROUP BY 1""")
def recall_cov_at_k(spark, d):
    ranked, gold = lists(spark, d)
    means = E.macro(E.per_instance(ranked, gold, ["qty", "price"]))
    return means.select("method", "instances", *[F.round(c, 6).alias(c) for c in means.columns[2:]])


@query("first_hit", f"WITH {_LISTS}, g AS (SELECT instance, count(*) AS n_gold FROM gold GROUP BY 1), l AS (SELECT instance, count(DISTINCT item) AS n_listed FROM ranked WHERE method = 'qty' GROUP BY 1), f AS (SELECT instance, min(pos) AS first_hit FROM ranked JOIN gold USING (instance, item) WHERE method = 'qty' GROUP BY 1) SELECT instance, n_gold, coalesce(n_listed, 0) AS n_listed, first_hit FROM g LEFT JOIN l USING (instance) LEFT JOIN f USING (instance)")
def first_hit(spark, d):
    ranked, gold = lists(spark, d)
    return E.per_instance(ranked.where("method = 'qty'"), gold, ["qty"]).select("instance", "n_gold", "n_listed", "first_hit")


@query("missed_gt", f"WITH {_LISTS}, m AS (SELECT g.instance, g.item FROM gold g WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.method = 'qty' AND r.pos <= 5 AND r.instance = g.instance AND r.item = g.item)) SELECT i.instance, coalesce(string_agg(m.item, '; ' ORDER BY m.item), '') AS missed FROM (SELECT DISTINCT instance FROM gold) i LEFT JOIN m USING (instance) GROUP BY 1")
def missed_gt(spark, d):
    ranked, gold = lists(spark, d)
    return E.missed(ranked.where("method = 'qty'"), gold, 5)


def _frac(m):
    return f"SELECT g.instance, avg(CASE WHEN r.item IS NOT NULL THEN 1.0 ELSE 0 END) AS v FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE method = '{m}' AND pos <= 3) r ON r.instance = g.instance AND r.item = g.item GROUP BY 1"


@query("oracle_fusion", f"WITH {_LISTS}, a AS ({_frac('qty')}), b AS ({_frac('price')}) SELECT a.instance, a.v AS recall_a, b.v AS recall_b, greatest(a.v, b.v) AS oracle FROM a JOIN b USING (instance)")
def oracle_fusion(spark, d):
    ranked, gold = lists(spark, d)
    return E.fused(ranked.where("method = 'qty'"), ranked.where("method = 'price'"), gold, 3)


@query("union_pool", f"WITH {_LISTS} SELECT instance, count(DISTINCT item) AS n_pool FROM ranked WHERE pos <= 5 GROUP BY 1")
def union_pool(spark, d):
    return lists(spark, d)[0].where("pos <= 5").groupBy("instance").agg(F.count_distinct("item").alias("n_pool"))


@query("shared_instances", "SELECT DISTINCT o_custkey AS instance FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def shared_instances(spark, d):
    o = read(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("instance")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("rank_merge", f"""WITH {_LISTS}, c AS (SELECT instance, CASE method WHEN 'qty' THEN 0 ELSE 1 END AS chunk, pos, item FROM ranked WHERE pos <= 3), p AS (SELECT instance, item, pos FROM ranked WHERE method = 'qty'),
o AS (SELECT instance, item, 0 AS part, pos AS a, chunk AS b FROM c UNION ALL SELECT instance, item, 1, pos, 0 FROM p), f AS (SELECT instance, item, min(struct_pack(part := part, a := a, b := b)) AS k FROM o GROUP BY 1, 2)
SELECT instance, item, CAST(row_number() OVER (PARTITION BY instance ORDER BY k, item) AS INTEGER) AS rank FROM f""")
def rank_merge(spark, d):
    ranked, _ = lists(spark, d)
    chunks = ranked.where("pos <= 3").select("instance", F.when(F.col("method") == "qty", 0).otherwise(1).alias("chunk"), "pos", "item")
    return R.merge_chunks(chunks, ranked.where("method = 'qty'").select("instance", "pos", "item")).select("instance", "item", "rank")


_Q = "floor(length(text) / 4)"


@query("token_stats", f"SELECT lang, count(*) AS n, avg({_Q}) AS mean, median({_Q}) AS median, quantile_disc({_Q}, 0.9) AS p90, list_sort(list({_Q}))[count(*) // 2 + 1] AS upper_median FROM documents WHERE text IS NOT NULL GROUP BY lang")
def token_stats(spark, d):
    return E.token_stats(read(spark, d, "documents"), ["lang"], T.tokens_quarter(F.col("text")))


@query("token_estimates", "SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS pack, CAST(greatest(1, (length(text) + 2) // 3) AS BIGINT) AS batch, CAST(length(text) // 4 AS BIGINT) AS cost FROM documents")
def token_estimates(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.tokens_third(t).alias("pack"), T.tokens_third_up(t).alias("batch"), T.tokens_quarter(t).alias("cost"))


@query("method_summary", """WITH r AS (SELECT o_orderpriority AS method, floor(o_totalprice / 100) AS tokens, o_orderkey % 5 AS files, o_orderstatus = 'O' AS hit FROM orders)
SELECT method, count(*) AS n, avg(files) AS avg_files, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS acc, sum(tokens) / nullif(count(*) FILTER (hit), 0) AS tokens_per_hit FROM r GROUP BY 1""")
def method_summary(spark, d):
    o = read(spark, d, "orders")
    return E.method_summary(o.select(F.col("o_orderpriority").alias("method"), F.floor(F.col("o_totalprice") / 100).alias("tokens"), (F.col("o_orderkey") % 5).alias("files"), (F.col("o_orderstatus") == "O").alias("hit")))


@query("usage_totals", """SELECT user_id AS instance, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(2 * CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS completion_tokens, count(*) AS calls FROM events GROUP BY 1""")
def usage_totals(spark, d):
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    traj = e.groupBy(F.col("user_id").alias("instance")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.concat(F.lit('{"usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":'), (2 * k.cast("long")).cast("string"), F.lit("}}"))), ","), F.lit("]")).alias("traj"))
    return E.usage_totals(traj)


@query("stage_totals", "SELECT user_id AS instance, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(DISTINCT event_type) AS stages FROM events GROUP BY 1")
def stage_totals(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("instance"), F.floor("value").alias("tokens"))
    return E.stage_totals(e)


@query("top_calls", "SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS failures FROM events GROUP BY 1")
def top_calls(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 10).alias("failures"))


# Spans of an order's lines: from the quantity, as long as the line number says.
_SPANS = 'SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS "start", CAST(l_quantity AS BIGINT) + l_linenumber AS "end", l_linenumber AS id FROM lineitem'


def spans(spark, d):
    q = F.col("l_quantity").cast("long")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("start"), (q + F.col("l_linenumber")).alias("end"), F.col("l_linenumber").alias("id"))


@query("interval_merge", f"""WITH s AS (SELECT k, greatest("start" - 2, 1) AS a, "end" + 2 AS b FROM ({_SPANS})), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
i AS (SELECT *, sum(CASE WHEN a <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(a) AS "start", max(b) AS "end", count(*) AS n FROM i GROUP BY k, g""")
def interval_merge(spark, d):
    return S.merge_intervals(spans(spark, d), ["k"], 2)


@query("span_dedupe", f"""WITH s AS (SELECT DISTINCT * FROM ({_SPANS})) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.id <> s.id AND t."start" <= s."start" AND s."end" <= t."end" AND (t."start" < s."start" OR s."end" < t."end" OR t.id < s.id))""")
def span_dedupe(spark, d):
    return S.drop_contained(spans(spark, d).distinct(), ["k"])


@query("gap_markers", f"""WITH s AS ({_SPANS}), l AS (SELECT *, lag("end") OVER (PARTITION BY k ORDER BY "start", "end", id) AS p FROM s) SELECT k, CAST(sum(CASE WHEN "start" > p + 1 THEN "start" - p - 1 END) AS BIGINT) AS omitted FROM l GROUP BY k""")
def gap_markers(spark, d):
    return S.gap_markers(spans(spark, d), ["k"]).groupBy("k").agg(F.sum("omitted").alias("omitted"))


_HUNKS = "SELECT o_orderkey AS hunk_id, o_orderkey AS file, CAST(o_custkey % 40 AS BIGINT) + 1 AS h_start, CAST(o_custkey % 40 AS BIGINT) + o_orderkey % 3 AS h_end, o_orderkey % 3 AS count, o_orderkey % 11 = 0 AS is_new_file FROM orders"
_NODES = f'SELECT k AS file, id AS node_id, "start" AS line_start, "end" AS line_end FROM ({_SPANS})'
_IN = "CASE WHEN count = 0 THEN line_start <= h_start AND h_start < line_end ELSE line_start <= h_start AND h_end <= line_end END"
_OVER = "CASE WHEN count = 0 THEN line_start <= h_start AND h_start <= line_end ELSE h_start <= line_end AND line_start <= h_end END"


def hunks(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    return read(spark, d, "orders").select(k.alias("hunk_id"), k.alias("file"), (c + 1).alias("h_start"), (c + k % 3).alias("h_end"), (k % 3).alias("count"), (k % 11 == 0).alias("is_new_file"))


def span_nodes(spark, d):
    return spans(spark, d).select(F.col("k").alias("file"), F.col("id").alias("node_id"), F.col("start").alias("line_start"), F.col("end").alias("line_end"))


for _how, _on in (("contains", _IN), ("overlaps", _OVER)):

    @query(f"span_{_how}", f"WITH h AS ({_HUNKS}), n AS ({_NODES}) SELECT hunk_id, node_id, file FROM h JOIN n USING (file) WHERE NOT is_new_file AND {_on}")
    def span_join(spark, d, how=_how):
        return S.hunk_nodes(hunks(spark, d), span_nodes(spark, d), how)


@query("hunk_classify", f"WITH h AS ({_HUNKS}), n AS ({_NODES}), f AS (SELECT hunk_id, max(CASE WHEN {_IN} THEN 1 ELSE 0 END) AS c, max(CASE WHEN {_OVER} THEN 1 ELSE 0 END) AS o, bool_or(is_new_file) AS new FROM h LEFT JOIN n USING (file) GROUP BY 1) SELECT hunk_id, CASE WHEN new THEN 'new' WHEN c = 1 THEN 'contained' WHEN o = 1 THEN 'partial' ELSE 'outside' END AS class FROM f")
def hunk_classify(spark, d):
    return S.classify_hunks(hunks(spark, d), span_nodes(spark, d))


@query("budget_pack", "WITH t AS (SELECT source, doc_id, CAST(sum(length(text) // 3) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT source, doc_id, total FROM t WHERE r = 1 OR total <= 4000")
def budget_pack(spark, d):
    return S.budget_pack(read(spark, d, "documents"), ["source"], ["doc_id"], T.tokens_third(F.col("text")), 4000).select("source", "doc_id", "total")


@query("batch_pack", """WITH RECURSIVE s AS (SELECT source, doc_id, greatest(1, (length(text) + 2) // 3) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, doc_id, r, 0 AS batch, 1 AS items, n AS size FROM s WHERE r = 1
UNION ALL SELECT s.source, s.doc_id, s.r, CASE WHEN f.items >= 4 OR f.size + s.n > 3000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.items >= 4 OR f.size + s.n > 3000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= 4 OR f.size + s.n > 3000 THEN s.n ELSE f.size + s.n END FROM f JOIN s ON s.source = f.source AND s.r = f.r + 1)
SELECT source, doc_id, batch FROM f""")
def batch_pack(spark, d):
    return S.greedy_batches(read(spark, d, "documents"), ["source"], "doc_id", "doc_id", T.tokens_third_up(F.col("text")), 4, 3000)


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def _knn(spark, d, meta_type=None):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("meta_type"))
    asked = read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.knn(e, asked, 10, meta_type).select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


for _name, _where in (("knn_cosine", "true"), ("knn_filtered", "a.label = 3")):

    @query(_name, f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND {_where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 4) AS similarity, rank FROM r WHERE rank <= 10")
    def knn(spark, d, meta_type="3" if _name == "knn_filtered" else None):
        return _knn(spark, d, meta_type)


@query("sim_signals", "WITH r AS (SELECT user_id AS instance, event_type AS path, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC) AS k FROM events) SELECT instance, path, round(max(value), 4) AS sim_max, round(avg(value), 4) AS sim_mean FROM r WHERE k <= 3 GROUP BY 1, 2")
def sim_signals(spark, d):
    return V.file_signals(read(spark, d, "events").select(F.col("user_id").alias("instance"), F.col("event_type").alias("path"), F.col("value").alias("sim")))


@query("cache_keys", "SELECT doc_id, sha256(lang || chr(0) || text) AS key FROM documents")
def cache_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", T.cache_key(F.col("lang"), F.col("text")).alias("key"))


@query("cache_hit_miss", "WITH k AS (SELECT doc_id, sha256(lang || chr(0) || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0) SELECT count(*) FILTER (key IN (SELECT key FROM c)) AS hits, count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM c) THEN key END) AS misses FROM k")
def cache_hit_miss(spark, d):
    items = read(spark, d, "documents").select("doc_id", "text", T.cache_key(F.col("lang"), F.col("text")).alias("key"))
    cache = items.where("doc_id % 3 = 0").select("key", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    hits, misses = V.cache_split(items, cache, 2)
    return hits.agg(F.count("*").alias("hits")).join(F.broadcast(misses.agg(F.count("*").alias("misses"))))


_BM25 = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 20 = 0),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * ({1 - R.B} + {R.B} * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10"""


@query("bm25_topk", _BM25)
def bm25_topk(spark, d):
    asked = read(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(read(spark, d, "documents"), asked).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("leak_audit_lines", r"WITH l AS (SELECT DISTINCT item_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 8)) AS line FROM benchmark) SELECT l.item_id, l.line, count(*) AS n_texts FROM l JOIN documents d ON contains(d.text, l.line) GROUP BY ALL")
def leak_audit_lines(spark, d):
    """All lines of the benchmark's items, whole, and how many documents hold each."""
    lines = read(spark, d, "benchmark").select(F.col("item_id").alias("instance"), F.explode(T.stripped_lines(F.col("text"), 8)).alias("line"))
    return E.leaks(lines, read(spark, d, "documents").select("text")).withColumnRenamed("instance", "item_id")


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages")
def page_titles(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"))


@query("dedupe_keep_last", "WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, min(event_id) OVER (PARTITION BY user_id) AS first_pos FROM events WHERE props <> ''), f AS (SELECT user_id, min(event_id) AS first_pos FROM events GROUP BY 1) SELECT r.user_id, event_type, event_id, f.first_pos FROM r JOIN f USING (user_id) WHERE k = 1")
def dedupe_keep_last(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "event_id", "props")
    return E.keep_last(rows, "user_id", "event_id", "props").select("user_id", "event_type", "event_id", "first_pos")


@query("dev_test_split", "WITH f AS (SELECT user_id AS instance, min(event_id) AS p FROM events GROUP BY 1) SELECT instance, CASE WHEN row_number() OVER (ORDER BY p) <= 23 THEN 'dev' ELSE 'test' END AS split FROM f")
def dev_test_split(spark, d):
    """The first 23 instances by first appearance are dev: a top-23 and a join, no global sort of all."""
    first = read(spark, d, "events").groupBy(F.col("user_id").alias("instance")).agg(F.min("event_id").alias("p"))
    dev = first.orderBy("p").limit(23).select("instance", F.lit("dev").alias("split"))
    return first.join(F.broadcast(dev), "instance", "left").select("instance", F.coalesce("split", F.lit("test")).alias("split"))


@query("shard_assign", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents")
def shard_assign(spark, d):
    return E.shards(read(spark, d, "documents").select("doc_id"), "doc_id", 7).select("doc_id", F.col("shard").cast("long").alias("shard"))


@query("loop_state", "SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS rounds, CAST(sum(length(text) // 3) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS tokens FROM conversations")
def loop_state(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.sum((F.col("role") == "assistant").cast("long")).over(w).alias("rounds"), F.sum(T.tokens_third(F.col("text"))).over(w).alias("tokens"))


@query("unique_commits", "SELECT o_custkey AS repo, min(struct_pack(a := o_orderdate, b := o_orderkey)).b AS instance FROM orders GROUP BY 1")
def unique_commits(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("instance"))


@query("cache_by_repo", "SELECT source AS repo_key, count(*) AS n FROM documents GROUP BY 1")
def cache_by_repo(spark, d):
    return read(spark, d, "documents").groupBy(F.col("source").alias("repo_key")).agg(F.count("*").alias("n"))


@query("text_cuts", "SELECT doc_id, left(text, 40) AS head, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS lines, 19 + least(length(text), 8192) AS query_chars FROM documents")
def text_cuts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.truncate(t, 40).alias("head"), T.truncate_lines(t, 2).alias("lines"), (19 + F.least(F.length(t), F.lit(8192))).alias("query_chars"))


@query("comparison_counts", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(1, floor(n * log2(n)) - n + 1) END AS BIGINT) AS calls FROM c")
def comparison_counts(spark, d):
    c = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.select("source", T.comparisons(F.col("n")).alias("calls"))


@query("shortest_first", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS rank FROM documents")
def shortest_first(spark, d):
    from pyspark.sql import Window as W

    return read(spark, d, "documents").select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy(F.length("text"), "doc_id")).cast("long").alias("rank"))
