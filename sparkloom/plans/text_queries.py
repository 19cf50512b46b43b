"""Text functions, loaders, prompts, edits and graph bookkeeping over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import localise as L
from ..operators import rank as R
from ..operators import repair as RP
from ..operators import validate as VA
from ..operators.caches import fingerprint, page
from ..sources import files as FS
from ..sources.tpch_graph import SQL as GRAPH
from ..sources.tpch_graph import tpch_graph
from ..streaming import progress as P
from .report_queries import _LI, _asked, _files, _quoted, order_lines, read

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_SPLIT = f"CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) WHEN regexp_split_to_array(text, {_ENDS})[-1] = '' THEN regexp_split_to_array(text, {_ENDS})[:-2] ELSE regexp_split_to_array(text, {_ENDS}) END"


@query("text_lines", f"""WITH s AS (SELECT doc_id, text, {_SPLIT} AS ls FROM documents)
SELECT doc_id, len(ls) AS n_lines, md5(array_to_string(ls[2:4], chr(10))) AS two_to_four, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS first_three, md5(array_to_string(list_transform(ls, lambda x, i: (i + 6) || ' ' || x), chr(10))) AS numbered FROM s""")
def text_lines(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.size(T.split_lines(t)).cast("long").alias("n_lines"), F.md5(T.line_range(t, F.lit(2), F.lit(4))).alias("two_to_four"), F.md5(T.truncate_lines(t, 3)).alias("first_three"), F.md5(F.array_join(T.numbered(T.split_lines(t), F.lit(7)), "\n")).alias("numbered"))


@query("text_unnumbered", "SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '## ')), lambda x: x), chr(10))) AS plain FROM documents")
def text_unnumbered(spark, d):
    """Numbering a text's lines and taking the numbers off again gives the text; lines that begin with ## go."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.startswith("## "), x).otherwise(F.concat(i.cast("string"), F.lit(" "), x)))
    return read(spark, d, "documents").select("doc_id", F.md5(T.unnumbered(F.array_join(lines, "\n"))).alias("plain"))


_MARKED = "'[start of ' || source || '/' || doc_id || '.py]  ' || chr(10) || replace(translate(text, '[]', '()'), chr(10), ' ') || chr(10) || '[end of ' || source || '/' || doc_id || '.py] and [start of b.py] too' || chr(10) || '[start of c.py]'"


def _marked(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    text = F.concat(F.lit("[start of "), path, F.lit("]  \n"), F.replace(F.translate("text", "[]", "()"), F.lit("\n"), F.lit(" ")), F.lit("\n[end of "), path, F.lit("] and [start of b.py] too\n[start of c.py]"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", "source", text.alias("text"))


@query("marked_files", f"SELECT doc_id, source || '/' || doc_id || '.py,b.py,c.py' AS anywhere, source || '/' || doc_id || '.py,c.py' AS alone, 'c.py' AS strict FROM documents WHERE {_MARKED} <> ''")
def marked_files(spark, d):
    t = F.col("text")
    return _marked(spark, d).select("doc_id", F.array_join(T.marked_files(t), ",").alias("anywhere"), F.array_join(T.marked_files(t, "line"), ",").alias("alone"), F.array_join(T.marked_files(t, "strict"), ",").alias("strict"))


@query("files_with_content", "SELECT doc_id, source || '/' || doc_id || '.py' AS path, translate(text, '[]', '()') AS content FROM documents UNION ALL SELECT doc_id, 'z.py', '' FROM documents")
def files_with_content(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    docs = read(spark, d, "documents").where("text is not null").withColumn("text", F.translate("text", "[]", "()"))
    text = F.concat(F.lit("[start of "), path, F.lit("]\n"), F.col("text"), F.lit("\n[end of "), path, F.lit("]\n[start of z.py]"))
    return docs.select("doc_id", F.explode(T.files_with_content(text)).alias("f")).select("doc_id", "f.path", "f.content")


@query("prompt_parts", "SELECT doc_id, 'issue ' || lang || chr(10) AS header, chr(10) || 'tail' AS footer, chr(10) || chr(10) AS separator, 'a' || doc_id || '.py,b.py' AS files, md5('[start of a' || doc_id || '.py]' || chr(10) || translate(text, '[]', '()') || chr(10) || '[end of a' || doc_id || '.py]') AS first FROM documents")
def prompt_parts(spark, d):
    path = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".py"))
    block = F.concat(F.lit("[start of "), path, F.lit("]\n"), F.translate("text", "[]", "()"), F.lit("\n[end of "), path, F.lit("]"))
    text = F.concat(F.lit("issue "), "lang", F.lit("\n"), block, F.lit("\n\n[start of b.py]\ny\n[end of b.py]\n[start of b.py]\nagain\n[end of b.py]\ntail"))
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", path.alias("path"), T.prompt_parts(text).alias("p"))
    return rows.select("doc_id", "p.header", "p.footer", "p.separator", F.array_join("p.order", ",").alias("files"), F.md5(F.col("p.blocks")[F.col("path")]).alias("first"))


@query("patch_lines", r"""WITH l AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents)
SELECT doc_id, source || '.py' AS files, len(list_distinct(list_filter(ls, lambda x: length(x) >= 20))) AS n_added FROM l""")
def patch_lines(spark, d):
    """Each document as a patch that adds its lines: the file written and the added lines of 20 characters or more."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    patch = F.concat(F.lit("--- /dev/null\n+++ b/"), "source", F.lit(".py\n@@ -0,0 +1 @@\n"), body)
    clean = read(spark, d, "documents").where("text is not null").select("doc_id", patch.alias("p"))
    return clean.select("doc_id", F.array_join(T.patched_files(F.col("p")), ",").alias("files"), F.size(T.added_lines(F.col("p"), 20)).cast("long").alias("n_added"))


@query("answers", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x' || doc_id || ',y' WHEN 1 THEN '' END AS listed, CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'b' END AS judged FROM documents""")
def answers(spark, d):
    k = F.col("doc_id")
    lists = F.when(k % 4 == 0, F.concat(F.lit('Sure:\n```json\n["x'), k.cast("string"), F.lit('",\n"y"]\n``` and ["z"]'))).when(k % 4 == 1, "[]").when(k % 4 == 2, "[1, 2]").otherwise("none [broken")
    judge = F.when(k % 5 == 0, " A ").when(k % 5 == 1, "File B is it").when(k % 5 == 2, "FILE_B").when(k % 5 == 3, "file_a or file_b").otherwise("neither")
    return read(spark, d, "documents").select("doc_id", F.array_join(T.list_answer(lists), ",").alias("listed"), T.comparator_answer(judge).alias("judged"))


@query("json_calls", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_objects, CASE event_id % 4 WHEN 1 THEN 1 ELSE 0 END AS n_calls FROM events")
def json_calls(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit('Go:\n```json\n[{"function": {"name": "f"}}, 3]\n```\n```\n'), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\nbroken {\n```\n```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("no "), p))
    return read(spark, d, "events").select("event_id", F.size(T.json_objects(text)).alias("n_objects"), F.size(T.function_calls(text)).alias("n_calls"))


@query("sections_of", "SELECT doc_id, CASE WHEN lang <> 'es' THEN text END AS issue FROM documents")
def sections_of(spark, d):
    text = F.when(F.col("lang") != "es", F.concat(F.lit("head\n<issue>\n"), "text", F.lit("\n</issue>\n<issue>\nmore\n</issue>"))).otherwise(F.concat(F.lit("<issue>"), "text", F.lit("</issue>")))
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.section(text, "issue").alias("issue"))


@query("requirements", """SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'pkg.' || p_partkey END AS name, CASE p_partkey % 5 WHEN 0 THEN '>=1.' || p_size WHEN 1 THEN '==2.' || p_size || ', <3' END AS version FROM part""")
def requirements(spark, d):
    k, name = F.col("p_partkey") % 5, F.concat(F.lit("pkg."), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat(F.lit("  "), name, F.lit(">=1."), size, F.lit("  # why"))).when(k == 1, F.concat(name, F.lit("[extra]==2."), size, F.lit(", <3"))).when(k == 2, name).when(k == 3, F.concat(F.lit("# "), name)).otherwise(F.concat(F.lit("-r "), name))
    return read(spark, d, "part").select("p_partkey", T.requirement(line).alias("r")).select("p_partkey", "r.name", "r.version")


@query("graph_keys", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'org__' || lower(c_mktsegment) END AS repo, CASE WHEN c_custkey % 3 <> 0 THEN sha1(c_name) END AS commit FROM customer")
def graph_keys(spark, d):
    key = F.concat(F.lit("org__"), F.lower("c_mktsegment"), F.lit("__"), F.when(F.col("c_custkey") % 3 != 0, F.sha1("c_name")).otherwise("main"))
    return read(spark, d, "customer").select("c_custkey", T.graph_identity(key).alias("g")).select("c_custkey", "g.repo", "g.commit")


@query("names_of", r"SELECT doc_id, regexp_replace(source || '/m ' || lang || ':1', '[^A-Za-z0-9._-]+', '_', 'g') AS slug, lang AS tail, 'm|' || doc_id || '|' AS mark, doc_id % 2 = 0 AS readme FROM documents")
def names_of(spark, d):
    path = F.when(F.col("doc_id") % 2 == 0, "docs/ReadMe.rst").otherwise("readme/x.md")
    return read(spark, d, "documents").select("doc_id", T.model_slug(F.concat("source", F.lit("/m "), "lang", F.lit(":1"))).alias("slug"), T.last_segment(F.concat(F.lit("Method-a-"), "lang")).alias("tail"), fingerprint(F.lit("m"), F.col("doc_id"), F.lit(None)).alias("mark"), T.is_readme(path).alias("readme"))


@query("comparison_counts", "SELECT o_custkey AS k, CAST(CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(1, floor(count(*) * log2(count(*))) - count(*) + 1) END AS BIGINT) AS n FROM orders GROUP BY 1")
def comparison_counts(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("c")).select("k", T.comparisons(F.col("c")).alias("n"))


@query("numbers_shown", "SELECT o_orderkey, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS whole, CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE format('{:.1f}%', o_orderkey % 7 / 8 * 100) END AS share FROM orders")
def numbers_shown(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", T.shown(F.col("o_totalprice")).alias("whole"), T.shown(F.when(k % 7 != 0, k % 7 / 8), "pct").alias("share"))


_AUDIT = r"""l AS (SELECT doc_id, text, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20)) AS ls, lang, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1), chr(10)) AS shown, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 4 = 1), chr(10)) AS known FROM documents),
m AS (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN [] ELSE list_filter(ls, lambda x: contains(shown, x)) END AS matched, lang, known FROM l),
a AS (SELECT doc_id AS instance, matched, CASE WHEN lang = 'es' THEN [] ELSE list_filter(matched, lambda x: NOT contains(known, x)) END AS leaked, lang = 'fr' AS patch_missing, lang = 'es' AS corpus_missing FROM m)"""


def _audit(spark, d):
    """A patch adds a document's lines; the prompt shows every second of them, and the corpus holds every fourth."""
    docs = read(spark, d, "documents").where("text is not null").withColumnRenamed("doc_id", "instance")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    patches = docs.select("instance", F.when(F.col("lang") != "fr", F.concat(F.lit("--- a/x\n+++ b/x\n"), body)).otherwise("").alias("patch"))
    each = lambda n: F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % n == 0), "\n")
    files = docs.where("lang <> 'es'").select("instance", F.explode(F.array(each(4), F.lit("other"))).alias("contents"))
    return E.leak_audit(docs.select("instance", each(2).alias("text")), patches, files, 20)


@query("leak_audit", f"WITH {_AUDIT} SELECT instance, len(matched) AS matched, len(leaked) AS leaked, patch_missing, corpus_missing FROM a")
def leak_audit(spark, d):
    return _audit(spark, d).select("instance", F.size("matched").cast("long").alias("matched"), F.size("leaked").cast("long").alias("leaked"), "patch_missing", "corpus_missing")


@query("leak_totals", f"WITH {_AUDIT} SELECT count(*) AS instances, CAST(sum(len(matched)) AS BIGINT) AS matched_lines, CAST(sum(len(leaked)) AS BIGINT) AS leaked_lines, count(*) FILTER (patch_missing) AS patch_missing, count(*) FILTER (corpus_missing) AS corpus_missing FROM a")
def leak_totals(spark, d):
    return E.leak_totals(_audit(spark, d))


# Loaders


@query("rows_behind_first", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS event_type FROM events ORDER BY event_id OFFSET 23")
def rows_behind_first(spark, d):
    rows = read(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"))
    return FS.skip_first(rows, 23, "event_id", {"event_type": "none"})


@query("found_files", f"WITH {_LI}, l AS (SELECT l_orderkey AS instance, list(CASE WHEN l_partkey % 9 = 0 THEN 'docs/README.md' ELSE 'f' || l_partkey END ORDER BY l_linenumber) AS fs FROM li GROUP BY 1) SELECT instance, unnest(list_filter(fs, lambda x: x <> 'docs/README.md')) AS item, CAST(generate_subscripts(list_filter(fs, lambda x: x <> 'docs/README.md'), 1) - 1 AS INTEGER) AS pos FROM l")
def found_files(spark, d):
    name = F.when(F.col("l_partkey") % 9 == 0, "docs/README.md").otherwise(F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    rows = order_lines(spark, d).groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("f")))), lambda x: x["f"]).alias("found_files"))
    return FS.found_files(rows).select("instance", "item", "pos")


@query("retrieved_hits", f"WITH {_LI}, h AS (SELECT l_orderkey AS instance, 'f' || l_partkey AS item, CAST(l_suppkey % 13 AS DOUBLE) AS score, l_linenumber AS k FROM li WHERE l_partkey % 9 <> 0) SELECT instance, CAST(row_number() OVER (PARTITION BY instance ORDER BY score DESC, k) AS INTEGER) AS pos, item, score FROM h")
def retrieved_hits(spark, d):
    name = F.when(F.col("l_partkey") % 9 == 0, "docs/README.md").otherwise(F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    hit = F.struct("l_linenumber", F.struct(name.alias("docid"), (F.col("l_suppkey") % 13).cast("double").alias("score")).alias("h"))
    rows = order_lines(spark, d).groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["h"]).alias("hits"))
    return FS.retrieved(rows).select("instance", "pos", "item", "score")


@query("rankable_rows", "SELECT user_id AS instance, max(event_id) FILTER (event_type <> 'error') AS line_no, min(event_id) AS first_pos FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AND user_id IN (SELECT o_custkey FROM orders) GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 0")
def rankable_rows(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("instance"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("text_inputs"))
    split = read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("instance"))
    return L.rankable(rows, split, read(spark, d, "orders").select(F.col("o_custkey").alias("instance"))).select("instance", "line_no", "first_pos")


@query("progress_models", "SELECT DISTINCT event_type AS model FROM events WHERE event_type <> 'view'")
def progress_models(spark, d):
    return L.models(read(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("model")))


@query("code_nodes", "SELECT p_partkey, p_size % 4 <> 0 AND p_partkey % 5 <> 0 AS truthy FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 2")
def code_nodes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    props = F.map_filter(F.create_map(F.lit("line_start"), (size % 4).cast("string"), F.lit("line_end"), F.when(k % 7 != 0, "9"), F.lit("source_code"), F.when(k % 5 != 0, F.col("p_name")).otherwise("")), lambda a, b: b.isNotNull())
    nodes = read(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "Method").when(k % 3 == 1, "Class").otherwise("Import").alias("meta_type"), props.alias("props"))
    strict = L.code_nodes(nodes).select("p_partkey", F.lit(True).alias("t"))
    return L.code_nodes(nodes, truthy=False).join(strict, "p_partkey", "left").select("p_partkey", F.coalesce("t", F.lit(False)).alias("truthy"))


@query("index_page", "SELECT p_brand || '-' || p_partkey AS id FROM part WHERE p_brand || '-' || p_partkey > 'Brand#3' ORDER BY 1 LIMIT 25")
def index_page(spark, d):
    return page(read(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("id")), "Brand#3", 25)


# Prompts and contexts


_STUB = len(RP.STUB) + 64


@query("truncated_sections", f"""WITH RECURSIVE s AS (SELECT source, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, doc_id, text, r, CAST(0 AS BIGINT) AS used FROM s WHERE r = 1 UNION ALL SELECT s.source, s.doc_id, s.text, s.r, used + CASE WHEN least(900, 6000 - used) <= {_STUB} THEN 0 ELSE least(length(f.text), least(900, 6000 - used)) END FROM f JOIN s ON s.source = f.source AND s.r = f.r + 1 WHERE s.r <= 12),
m AS (SELECT *, CAST(least(900, 6000 - used) AS BIGINT) AS may FROM f)
SELECT source, doc_id, md5(CASE WHEN may <= {_STUB} THEN '{RP.STUB}' WHEN length(text) > may THEN left(text, may // 2) || chr(10) || '[' || (length(text) - may) || ' characters left out]' || chr(10) || right(text, may // 2) ELSE text END) AS text FROM m""")
def truncated_sections(spark, d):
    rows = read(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    parts = F.transform("s", lambda x: F.struct(x["doc_id"].cast("string").alias("path"), x["text"].alias("text")))
    out = rows.select("source", F.explode(RP.truncated(parts, 12, 900, 6000)).alias("x"))
    return out.select("source", F.col("x.path").cast("long").alias("doc_id"), F.md5("x.text").alias("text"))


@query("rank_pairwise", "SELECT c_nationkey AS instance, CASE WHEN any_value(n_name) LIKE '%A' THEN string_agg(c_name, ',' ORDER BY c_custkey) ELSE string_agg(c_name, ',' ORDER BY c_name DESC) END AS ranked, any_value(n_name) LIKE '%A' AND count(*) > 1 AS failed, count(*) AS n_files FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def rank_pairwise(spark, d):
    """Customers of a nation by a judge who prefers later names, and who fails on some nations."""
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("items"))
    rows = c.join(read(spark, d, "nation"), "n_nationkey").select(F.col("n_nationkey").alias("instance"), F.col("n_name").alias("issue"), "items")
    out = L.rank_pairwise(rows, lambda issue, a, b: None if issue.endswith("A") else "a" if a > b else "b")
    return out.select("instance", F.array_join("ranked", ",").alias("ranked"), "failed", "n_files")


@query("rebuilt_contexts", f"""WITH {_LI}, p AS (SELECT DISTINCT l_orderkey AS instance, l_partkey AS p FROM li), r AS (SELECT instance, list('b' || p ORDER BY CASE WHEN instance % 4 = 0 THEN p ELSE -p END) AS b FROM p GROUP BY 1)
SELECT instance, 'H' || array_to_string(b, '|') || 'F' AS context, CASE WHEN instance % 4 = 0 THEN '' ELSE 'q' END AS missing, instance % 4 <> 0 AS rerank_used FROM r""")
def rebuilt_contexts(spark, d):
    """Blocks in a ranking's order, except for every fourth order, which has none."""
    p = F.col("l_partkey").cast("string")
    own = order_lines(spark, d).select(F.col("l_orderkey").alias("instance"), "l_partkey", p.alias("path")).distinct().groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "path"))).alias("s"))
    order = F.transform("s", lambda x: x["path"])
    blocks = F.map_from_entries(F.transform("s", lambda x: F.struct(x["path"], F.concat(F.lit("b"), x["path"]).alias("b"))))
    contexts = own.select("instance", F.lit("H").alias("header"), F.lit("F").alias("footer"), F.lit("|").alias("separator"), blocks.alias("blocks"), order.alias("order"))
    rankings = own.where("instance % 4 <> 0").select("instance", F.concat(F.array(F.lit("q")), F.reverse(order), F.slice(order, 1, 1)).alias("ranked"))
    out = R.rebuild(contexts, rankings)
    return out.select("instance", "context", F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",").alias("missing"), "rerank_used")


_HEADER = f"{_quoted(C.HEADER)} || 'broken ' || i.instance || {_quoted(chr(10) + '</issue>' + chr(10) + '<code>' + chr(10))} || coalesce(body, '') || {_quoted(chr(10) + '</code>')} || {_quoted(C.FOOTER)}"


@query("context_snippets", f"""WITH s AS (SELECT source AS instance, doc_id, {_SPLIT} AS ls, greatest(1 + doc_id % 5 - 2, 1) AS a, 1 + doc_id % 5 + doc_id % 4 + 2 AS b FROM documents),
t AS (SELECT instance, doc_id, array_to_string(list_transform(ls[a:b], lambda x, i: (i + a - 1) || ' ' || x), chr(10)) AS part FROM s), f AS (SELECT instance, string_agg('[start of d' || doc_id || '.txt]' || chr(10) || part || chr(10) || '[end of d' || doc_id || '.txt]', chr(10) ORDER BY doc_id) AS body FROM t GROUP BY 1),
i AS (SELECT DISTINCT source AS instance FROM documents) SELECT i.instance, md5({_HEADER}) AS context FROM i LEFT JOIN f ON f.instance = i.instance""")
def context_snippets(spark, d):
    f = _files(spark, d).drop("lang")
    start = 1 + F.col("rank") % 5
    spans = f.select("instance", "path", F.col("rank").alias("seq"), start.alias("start"), (start + F.col("rank") % 4).alias("end"))
    return C.file_snippets(spans, f.drop("rank"), _asked(spark, d), 10**9, 2).select("instance", F.md5("context").alias("context"))


@query("context_nodes", f"""WITH s AS (SELECT source AS instance, doc_id, {_SPLIT} AS ls FROM documents WHERE text <> ''), e AS (SELECT *, 10 + len(ls) - 1 AS b FROM s),
t AS (SELECT instance, doc_id, '## Method ' || doc_id || ' lines 10-' || b || chr(10) || '## CALLS x' || doc_id || chr(10) || array_to_string(list_transform(ls, lambda x, i: (i + 9) || ' ' || x), chr(10)) AS part FROM e),
f AS (SELECT instance, string_agg('[start of d' || doc_id || '.txt]' || chr(10) || part || chr(10) || '[end of d' || doc_id || '.txt]', chr(10) ORDER BY doc_id) AS body FROM t GROUP BY 1),
i AS (SELECT DISTINCT source AS instance FROM documents) SELECT i.instance, md5({_HEADER}) AS context FROM i LEFT JOIN f ON f.instance = i.instance""")
def context_nodes(spark, d):
    """A method a file, and one inside it that is left out."""
    f = _files(spark, d).where("content <> ''").drop("lang")
    k = F.col("rank").cast("string")
    last = 9 + F.size(T.split_lines(F.col("content")))
    outer = f.select("instance", "path", F.col("rank").alias("seq"), F.concat(F.lit("Method-m-"), k).alias("id"), F.lit("Method").alias("kind"), F.lit(10).alias("start"), last.alias("end"), F.col("content").alias("source_code"))
    inner = outer.withColumns({"id": F.concat("id", F.lit("-inner")), "start": F.col("end"), "source_code": F.lit("y")}).where("end > 10")
    edges = f.select(F.concat(F.lit("Method-m-"), k).alias("id"), F.concat(F.lit("CALLS x"), k).alias("text"))
    return C.node_sources(outer.unionByName(inner), edges, _asked(spark, d), 10**9).select("instance", F.md5("context").alias("context"))


# Graphs


@query("edge_ids", f"WITH {GRAPH}, p AS (SELECT id, string_split(id, '-') AS p FROM edges WHERE label = 'CONTAINS'), q AS (SELECT id, p FROM p UNION ALL SELECT 'A-HAS_PROPERTY-' || p[3] || '-1', ['A', 'HAS_PROPERTY', p[3], '1'] FROM p UNION ALL SELECT p[1] || '-' || p[3], [] FROM p UNION ALL SELECT p[1] || '-' || p[3] || '-' || p[4], [p[1], p[3], p[4]] FROM p) SELECT id, p[1] AS source, p[2] AS relation, p[3] AS target FROM (SELECT id, CASE WHEN len(p) = 3 OR len(p) = 4 AND p[2] = 'HAS_PROPERTY' THEN p END AS p FROM q)")
def edge_ids(spark, d):
    g = tpch_graph(spark, d, ("Region", "Nation", "Customer", "Order"), ("CONTAINS",))
    p = F.split("id", "-")
    base = g.edges.select("id", p.alias("p"))
    every = [base.select("id"), base.select(F.concat(F.lit("A-HAS_PROPERTY-"), F.col("p")[2], F.lit("-1")).alias("id")), base.select(F.concat_ws("-", F.col("p")[0], F.col("p")[2]).alias("id")), base.select(F.concat_ws("-", F.col("p")[0], F.col("p")[2], F.col("p")[3]).alias("id"))]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    return rows.select("id", VA.id_signature(F.col("id")).alias("s")).select("id", "s.source", "s.relation", "s.target")


@query("property_warnings", """WITH e AS (SELECT 'Customer' || c_custkey || '-HAS_PROPERTY-' || c_mktsegment AS id, 'Customer' || c_custkey AS n, c_mktsegment AS p, c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0)
SELECT 'meta' AS level, 'UNKNOWN_REFERENCE' AS error_type, id AS element_id, 'node ' || n AS detail FROM e WHERE k % 3 = 0 UNION ALL SELECT 'meta', 'UNKNOWN_REFERENCE', id, 'property ' || p FROM e WHERE p = 'BUILDING'""")
def property_warnings(spark, d):
    c = read(spark, d, "customer")
    own = F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"))
    props = F.when(F.col("c_custkey") % 4 != 0, F.create_map(F.lit("isMandatory"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    edges = c.select(F.concat(own, F.lit("-HAS_PROPERTY-"), "c_mktsegment").alias("id"), F.lit("HAS_PROPERTY").alias("label"), own.alias("source"), F.col("c_mktsegment").alias("target"), props.alias("props"), F.col("c_custkey").alias("ord"))
    ids = c.where("c_custkey % 3 <> 0").select(own.alias("id")).unionByName(c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("id")).distinct())
    nodes = ids.select("id", F.col("id").alias("label"), F.lit("NodeType").alias("meta_type"), F.create_map().cast("map<string,string>").alias("props"), F.lit(0).cast("long").alias("ord"))
    return VA.property_warnings(G.PropertyGraph(nodes, edges))


@query("schema_text", "SELECT 'node type ' || n_name || ': ' || r_name || ', name' AS line FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'edge type IN_' || r_name FROM region")
def schema_text(spark, d):
    """Nations as node types with two properties each, regions as edge types."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    empty = F.create_map().cast("map<string,string>").alias("props")
    node = lambda df, ident, kind, key: df.select(ident.alias("id"), ident.alias("label"), F.lit(kind).alias("meta_type"), empty, F.col(key).cast("long").alias("ord"))
    nodes = node(n, F.col("n_name"), "NodeType", "n_nationkey").unionByName(node(r, F.concat(F.lit("IN_"), "r_name"), "EdgeType", "r_regionkey")).unionByName(node(r, F.col("r_name"), "PropertyType", "r_regionkey"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.explode(F.array("r_name", F.lit("name"))).alias("target"))
    edges = both.select(F.concat_ws("-", "n_name", F.lit("HAS_PROPERTY"), "target").alias("id"), F.lit("HAS_PROPERTY").alias("label"), F.col("n_name").alias("source"), "target", empty, F.lit(0).cast("long").alias("ord"))
    return VA.schema_text(G.PropertyGraph(nodes, edges))


def _as_files(spark, d):
    """Nations as files; every second one has no path of its own."""
    g = tpch_graph(spark, d, ("Region", "Nation", "Customer", "Order"), ("CONTAINS",))
    named = F.when(F.substring_index("id", "-", -1).cast("long") % 2 == 0, F.concat(F.lit("src/"), "label")).otherwise("")
    nation = F.col("meta_type") == "Nation"
    nodes = g.nodes.withColumn("props", F.when(nation, F.create_map(F.lit("relative_path"), named)).otherwise(F.col("props"))).withColumn("meta_type", F.when(nation, "File").otherwise(F.col("meta_type")))
    return G.PropertyGraph(nodes, g.edges)


_FILE_OF = f"""WITH {GRAPH}, f AS (SELECT 'Nation-' || n_nationkey AS id, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'src/' || n_name ELSE {{}} END AS path FROM nation),
k AS (SELECT 'Nation-' || n_nationkey AS id, n_nationkey FROM nation UNION ALL SELECT 'Customer-' || c_custkey, c_nationkey FROM customer UNION ALL SELECT 'Order-' || o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT k.id, path FROM k JOIN f USING (n_nationkey) WHERE path IS NOT NULL"""


@query("file_of_nearest", _FILE_OF.format("n_name"))
def file_of_nearest(spark, d):
    return G.file_of(_as_files(spark, d))


@query("file_of_last", _FILE_OF.format("NULL"))
def file_of_last(spark, d):
    return G.file_of(_as_files(spark, d), "last")


@query("windowed_events", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.windowed_counts(rows, "10 minutes", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
