"""Queries over the driver's tables, one for each corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import written_and_read

    return written_and_read(spark, table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quantised_pairs import near_vectors

    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(spark, table(spark, sf_dir, "pages")).drop("url")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    rows = judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .domain_score import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    return encode_decode(spark, table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op4_lm_scoring": op4_lm_scoring,
        "op10_toxicity": op10_toxicity,
        "op9_url_filters": op9_url_filters,
        "op5_quality_rules": op5_quality_rules,
        "op2_warc": op2_warc,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op8_token_shards": op8_token_shards,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
    }


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (d)
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
  WHERE list_count(e) = len(e) AND isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _op5_sql() -> str:
    from .quality_rules import ALPHA, COST, DELTA, FEATURES

    ladder = ", ".join(str((r + 1, *cuts)) for r, cuts in enumerate(zip(*FEATURES.values())))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
one AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM one WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM win WHERE win IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS v(j) GROUP BY rid),
lin AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lin WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_shouts,
    coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS f1, n_shouts / greatest(n_words, 1) AS f2, n_dup_lines / greatest(n_lines, 1) AS f3,
    n_repeat_words / greatest(n_words, 1) AS f4, word_chars / greatest(n_words, 1) AS f5 FROM m),
ladder(rung, c1, c2, c3, c4, c5) AS (VALUES {ladder}),
known AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT f.*, good FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT stratum, count(DISTINCT doc_id) FILTER (good) AS goods, count(*) OVER () AS strata FROM labelled GROUP BY stratum),
pools AS (SELECT stratum, strata, CASE WHEN goods >= ln({DELTA} / strata) / ln(1 - {ALPHA}) THEN 'own ' || stratum ELSE 'pool' END AS pool FROM strata),
rungs AS (SELECT pool, strata, rung, count(DISTINCT doc_id) FILTER (good) AS n,
    count(DISTINCT doc_id) FILTER (good AND (f1 > c1 OR f2 > c2 OR f3 > c3 OR f4 > c4 OR f5 > c5)) AS k,
    count(DISTINCT doc_id) FILTER (NOT good AND (f1 > c1 OR f2 > c2 OR f3 > c3 OR f4 > c4 OR f5 > c5)) AS caught
  FROM labelled JOIN pools USING (stratum), ladder GROUP BY pool, strata, rung),
tails AS (SELECT pool, strata, rung, k, caught,
    sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) AS tail
  FROM rungs, generate_series(0, k) AS g(j) GROUP BY ALL),
tested AS (SELECT *, bool_and(tail <= {DELTA} / strata) OVER (PARTITION BY pool ORDER BY rung) AS passes, caught - {COST} * k AS gain FROM tails),
chosen AS (SELECT pool, rung FROM tested WHERE passes AND gain > 0 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY gain DESC, rung) = 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(f1 > c1 OR f2 > c2 OR f3 > c3 OR f4 > c4 OR f5 > c5, false) AS kept
FROM f LEFT JOIN pools USING (stratum) LEFT JOIN chosen USING (pool) LEFT JOIN ladder USING (rung)
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
two AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS s, word FROM one),
s AS (SELECT DISTINCT doc_id, s FROM two WHERE s IS NOT NULL UNION SELECT doc_id, word FROM two WHERE n = 1),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN both_ways l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""


def _op9_sql() -> str:
    from .url_filter import DAMPING, MARGIN, RULES

    rules = ", ".join(f"('{v}', '{h}', '{path}')" for v, h, path in RULES)
    return rf"""
WITH RECURSIVE rules(told, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS rid, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT rid, h || p AS rule, told, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, told DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
t AS (SELECT u.rid, page_id, host, path, rule, told FROM u LEFT JOIN fit ON fit.rid = u.rid AND k = 1),
found AS (SELECT DISTINCT rid, host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (
  SELECT rid, host, unnest(regexp_extract_all(html, '(?i)<a(?:rea)?\s[^>]*?href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]*)', 1)) AS dst FROM u)),
links AS (SELECT src, dst, count(*) AS w FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
counts AS (SELECT host, count(*) FILTER (told = 'allow') AS a, count(*) FILTER (told = 'block') AS b, count(*) AS n FROM t WHERE host <> '' GROUP BY host),
hosts AS (SELECT count(*) AS n FROM (SELECT host FROM counts UNION SELECT src FROM links UNION SELECT dst FROM links)),
seed AS (SELECT kind, host, s / sum(s) OVER (PARTITION BY kind) AS s FROM (SELECT 'trust' AS kind, host, a AS s FROM counts WHERE 2 * a > n UNION ALL SELECT 'distrust', host, b FROM counts WHERE 2 * b > n)),
e AS (SELECT kind, a, b, w / sum(w) OVER (PARTITION BY kind, a) AS share FROM (SELECT 'trust' AS kind, src AS a, dst AS b, w FROM links UNION ALL SELECT 'distrust', dst, src, w FROM links)),
r AS (SELECT 0 AS step, kind, host, s AS rank FROM seed
  UNION ALL SELECT step + 1, kind, host, sum(rank) FROM (
    SELECT r.step, r.kind, e.b AS host, r.rank * e.share * {DAMPING} AS rank FROM r JOIN e ON e.kind = r.kind AND e.a = r.host
    UNION ALL SELECT g.step, seed.kind, seed.host, seed.s * (1 - g.given) FROM seed JOIN (
      SELECT r.step, r.kind, sum(coalesce(r.rank * o.out * {DAMPING}, 0)) AS given FROM r LEFT JOIN (SELECT kind, a, sum(share) AS out FROM e GROUP BY kind, a) o ON o.kind = r.kind AND o.a = r.host GROUP BY r.step, r.kind) g ON g.kind = seed.kind)
  WHERE step < (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE 200 END FROM e) GROUP BY step, kind, host),
last AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS distrust FROM r WHERE step = (SELECT max(step) FROM r) GROUP BY host)
SELECT page_id, t.host, path, rule, coalesce(told, CASE WHEN distrust * n > trust * n + {MARGIN} THEN 'block' END, 'allow') AS verdict
FROM t LEFT JOIN last ON last.host = t.host, hosts
"""


def oracle_sql():
    return {"op2_warc": OP2_SQL, "op9_url_filters": _op9_sql(), "op3_minhash_near_dedup": OP3_SQL, "op5_quality_rules": _op5_sql(), "op6_embedding_near_dedup": OP6_SQL}
