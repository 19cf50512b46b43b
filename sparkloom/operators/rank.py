"""Ranking: BM25, list merging, rank chunks and fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: str = "text"):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score (6 places), rank: the k best documents of each query; ties by doc_id.

    docs: doc_id, text; queries: query_id, text. Lengths and frequencies are counted over all
    documents. Each word of a text becomes a row, and those of no query go in the same stage where the
    queries' terms are few enough for a broadcast join; only the queries' terms are shuffled then.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms())).alias("term"))
    held = docs.select("doc_id", terms().alias("words"))
    stats = held.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    words = held.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    tf = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").join(F.broadcast(stats)).select("doc_id", "term", weight.alias("w"))
    total = asked.join(scored, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_chunks(chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """instance, rank, item: winners of chunks in turn (all firsts, then all seconds, ...), then the pool's rest.

    chunks: instance, chunk, pos, item; pool: instance, pos, item, whose order the rest keeps. Items
    that aren't in the pool are dropped, and of repeats the first stays.
    """
    known = chunks.join(pool.select("instance", "item").distinct(), ["instance", "item"], "left_semi")
    ordered = known.select("instance", "item", F.lit(0).alias("part"), F.col("pos").cast("long").alias("a"), F.col("chunk").cast("long").alias("b"))
    rest = pool.select("instance", "item", F.lit(1).alias("part"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    first = ordered.unionByName(rest).groupBy("instance", "item").agg(F.min(F.struct("part", "a", "b")).alias("at"))
    return first.select("instance", "item", F.row_number().over(W.partitionBy("instance").orderBy("at", "item")).alias("rank"))


def listwise(candidates: list[str], blocks: dict[str, str], max_chars: int, ask: Callable[[list[str]], list[str] | None]) -> tuple[list[str], bool]:
    """Ranks candidates by asking about one chunk of their blocks after another: (ranking, failed).

    One candidate or none is a ranking already. Unknown and repeated answers are dropped. It failed
    only if every chunk did; then the given order stays.
    """
    if len(candidates) <= 1:
        return list(candidates), False
    chunks: list[list[str]] = [[]]
    size = 0
    for c in candidates:
        n = len(blocks.get(c, c))
        if chunks[-1] and size + n > max_chars:
            chunks.append([])
            size = 0
        chunks[-1].append(c)
        size += n
    answers = []
    for chunk in chunks:
        got = ask(chunk)
        answers.append([x for x in dict.fromkeys(got) if x in chunk] if got is not None else None)
    if all(a is None for a in answers):
        return list(candidates), True
    lists = [a or [] for a in answers]
    merged = [x[k] for k in range(max(map(len, lists), default=0)) for x in lists if k < len(x)]
    return list(dict.fromkeys(merged + list(candidates))), False


def comparator_sort(items: list[str], judge: Callable[[str, str], str | None]) -> tuple[list[str], int, bool]:
    """Sorts with a judge that names 'a' or 'b': (order, calls, failed). A pair is asked once; if a call fails, the given order stays."""
    from functools import cmp_to_key

    known: dict[tuple[str, str], int] = {}
    calls = 0

    class Failed(Exception):
        pass

    def compare(x: str, y: str) -> int:
        nonlocal calls
        if (x, y) not in known:
            calls += 1
            said = judge(x, y)
            if said not in ("a", "b"):
                raise Failed
            known[x, y] = -1 if said == "a" else 1
            known[y, x] = -known[x, y]
        return known[x, y]

    try:
        return sorted(items, key=cmp_to_key(compare)), calls, False
    except Failed:
        return list(items), calls, True


def rebuild(contexts: DataFrame, rankings: DataFrame, k: int | None = None) -> DataFrame:
    """Contexts of rankings: instance, context, missing, rerank_used.

    contexts: instance, header, footer, separator, blocks map<path, block>, order array<path>;
    rankings: instance, ranked array<path>, of which the first k count. Paths without a block are told as missing; an instance
    without a ranking, or with none of its blocks in it, keeps its own order.
    """
    rows = contexts.join(rankings, "instance", "left")
    distinct = F.array_distinct(F.coalesce("ranked", F.array().cast("array<string>")))
    distinct = distinct if k is None else F.slice(distinct, 1, k)
    there = F.filter(distinct, lambda p: F.map_contains_key("blocks", p))
    rows = rows.select("instance", "header", "footer", "separator", "blocks", "order", there.alias("there"), F.filter(distinct, lambda p: ~F.map_contains_key("blocks", p)).alias("missing"))
    used = F.size("there") > 0
    paths = F.when(used, F.col("there")).otherwise(F.col("order"))
    body = F.aggregate(F.transform(paths, lambda p: F.col("blocks")[p]), F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, F.col("separator"), x)))
    return rows.select("instance", F.concat("header", F.coalesce(body, F.lit("")), "footer").alias("context"), "missing", used.alias("rerank_used"))
