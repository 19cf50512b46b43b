"""Scores of ranked lists against gold sets, and cost summaries.

Ranked lists are long tables (method, instance, pos from 1, item); gold sets are (instance, item).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import numbered

KS = (1, 3, 5)
#: Bytes of lines that are broadcast and searched for at once.
LINE_BYTES = 16 << 20


def per_instance(ranked: DataFrame, gold: DataFrame, methods: list[str], ks: tuple = KS) -> DataFrame:
    """method, instance, n_gold, n_listed, first_hit, and for each k recall_frac_k, hit_any_k, cover_k (all gold in the top k)."""
    size = gold.groupBy("instance").agg(F.count_distinct("item").alias("n_gold"))
    marked = ranked.join(gold.select("instance", "item", F.lit(1).alias("hit")).distinct(), ["instance", "item"], "left")
    hits = [F.count_distinct(F.when((F.col("pos") <= k) & F.col("hit").isNotNull(), F.col("item"))).alias(f"h{k}") for k in ks]
    found = marked.groupBy("method", "instance").agg(F.count_distinct("item").alias("n_listed"), F.min(F.when(F.col("hit").isNotNull(), F.col("pos"))).alias("first_hit"), *hits)
    rows = size.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).join(found, ["method", "instance"], "left")
    out = [F.coalesce(f"h{k}", F.lit(0)) for k in ks]
    return rows.select(
        "method",
        "instance",
        "n_gold",
        F.coalesce("n_listed", F.lit(0)).alias("n_listed"),
        "first_hit",
        *[(h / F.col("n_gold")).alias(f"recall_frac_{k}") for k, h in zip(ks, out)],
        *[(h > 0).alias(f"hit_any_{k}") for k, h in zip(ks, out)],
        *[(h == F.col("n_gold")).alias(f"cover_{k}") for k, h in zip(ks, out)],
    )


def macro(rows: DataFrame, ks: tuple = KS) -> DataFrame:
    """Means over instances with gold, for each method."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("method").agg(F.count("*").alias("instances"), *[share(f"{m}_{k}").alias(f"{m}_{k}") for m in ("recall_frac", "hit_any", "cover") for k in ks])


def missed(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """instance, missed: the gold items outside the top k, sorted, joined by '; '."""
    top = ranked.where(F.col("pos") <= k).select("instance", "item")
    left = gold.join(top, ["instance", "item"], "left_anti").groupBy("instance").agg(F.array_join(F.array_sort(F.collect_set("item")), "; ").alias("missed"))
    return gold.select("instance").distinct().join(left, "instance", "left").select("instance", F.coalesce("missed", F.lit("")).alias("missed"))


def fused(a: DataFrame, b: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """instance, recall_a, recall_b, oracle: hits of two methods' top k and of the better of both."""
    cols = []
    for name, df in (("recall_a", a), ("recall_b", b)):
        top = df.where(F.col("pos") <= k).select("instance", "item").distinct()
        cols.append(gold.distinct().join(top.withColumn("hit", F.lit(1.0)), ["instance", "item"], "left").groupBy("instance").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias(name)))
    return cols[0].join(cols[1], "instance").withColumn("oracle", F.greatest("recall_a", "recall_b"))


def token_stats(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, n, mean, median (true), p90 (nearest rank), upper_median (sorted[n // 2])."""
    v = rows.select(*keys, value.alias("v")).where("v is not null")
    stats = v.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.expr("percentile_disc(0.9) within group (order by v)").cast("double").alias("p90"), _upper("v").alias("upper_median"))
    return stats


def _upper(column: str) -> Column:
    """sorted[n // 2]: the discrete percentile just behind one half, by a count of each value that merges in parts."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -{column})").cast("double")


def method_summary(rows: DataFrame) -> DataFrame:
    """rows: method, instance, tokens, files, hit (boolean, may be null). tokens_per_hit is null without hits, or where a hit is unknown."""
    hits = F.sum(F.col("hit").cast("int"))
    return rows.groupBy("method").agg(
        F.count("*").alias("n"),
        F.avg("files").alias("avg_files"),
        F.avg(F.col("hit").cast("double")).alias("acc"),
        F.when((F.count("hit") == F.count("*")) & (hits > 0), F.sum("tokens") / hits).alias("tokens_per_hit"),
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    """instance, prompt_tokens, completion_tokens, calls of rows (instance, traj JSON): an object, an array of them, or null."""
    kind = F.schema_of_variant(F.try_parse_json("traj"))
    listed = F.when(kind.startswith("ARRAY"), F.from_json("traj", "array<string>")).when(kind.startswith("OBJECT"), F.array("traj")).otherwise(F.array().cast("array<string>"))
    one = lambda field: F.aggregate("calls_", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.get_json_object(x, f"$.usage.{field}").cast("long"), F.lit(0)))
    used = F.size(F.filter("calls_", lambda x: F.get_json_object(x, "$.usage.prompt_tokens").isNotNull() | F.get_json_object(x, "$.usage.completion_tokens").isNotNull()))
    return calls.select("instance", listed.alias("calls_")).select("instance", one("prompt_tokens").alias("prompt_tokens"), one("completion_tokens").alias("completion_tokens"), used.cast("long").alias("calls"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """instance, tokens, stages over rows (stage, instance, tokens)."""
    return stages.groupBy("instance").agg(F.sum("tokens").alias("tokens"), F.count_distinct("stage").alias("stages"))


def leaks(added: DataFrame, texts: DataFrame, line_bytes: int = LINE_BYTES) -> DataFrame:
    """instance, line, n_texts: gold lines (instance, line) that occur in the instance's texts (instance, text).

    Texts without the column instance are searched for the lines of all instances, by an automaton
    of about ``line_bytes`` of them at a time; each text is read once for each.
    """
    if "instance" in texts.columns:
        return added.join(texts, "instance").where(F.contains(F.col("text"), F.col("line"))).groupBy("instance", "line").agg(F.count("*").alias("n_texts"))
    lines = added.where("line <> ''").select("line").distinct()
    total = lines.agg(F.coalesce(F.sum(F.octet_length("line")), F.lit(0))).first()[0]
    parts = -(-total // line_bytes)
    counts = None
    for k in range(parts):
        known = [r.line for r in lines.where(F.pmod(F.xxhash64("line"), F.lit(parts)) == k).collect()]
        found = _occurrences(texts.select("text"), known)
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        return added.select("instance", "line", F.lit(0).cast("long").alias("n_texts")).limit(0)
    return added.distinct().join(counts, "line").select("instance", "line", "n_texts")


def leak_audit(predictions: DataFrame, patches: DataFrame, corpus: DataFrame, least: int = 8) -> DataFrame:
    """instance, matched, leaked (arrays of lines, sorted), patch_missing, corpus_missing: gold lines that a prompt shows, and those of them that no file of its corpus holds.

    predictions: instance, text; patches: instance, patch; corpus: instance, contents, a row a file. Lines
    are a patch's added ones, stripped, of ``least`` characters or more. Without a patch (or with an empty
    one) nothing is matched, without a corpus nothing counts as leaked, and both are told.
    """
    rows = predictions.join(patches.select("instance", F.nullif("patch", F.lit("")).alias("patch")), "instance", "left").select("instance", "text", "patch")
    held = corpus.select("instance").distinct().withColumn("there", F.lit(True))
    lines = rows.where("patch is not null").select("instance", "text", F.explode(T.added_lines(F.col("patch"), least)).alias("line"))
    matched = lines.where(F.contains("text", "line")).select("instance", "line")
    known = matched.join(corpus.select("instance", "contents"), "instance").where(F.contains("contents", "line")).select("instance", "line").distinct().withColumn("known", F.lit(True))
    told = matched.join(known, ["instance", "line"], "left").groupBy("instance").agg(F.array_sort(F.collect_list("line")).alias("matched"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("line")))).alias("fresh"))
    none = F.array().cast("array<string>")
    out = rows.select("instance", F.col("patch").isNull().alias("patch_missing")).join(held, "instance", "left").join(told, "instance", "left")
    lost = ~F.col("patch_missing") & F.col("there").isNull()
    return out.select("instance", F.coalesce("matched", none).alias("matched"), F.when(F.col("there"), F.coalesce("fresh", none)).otherwise(none).alias("leaked"), "patch_missing", lost.alias("corpus_missing"))


def leak_totals(audit: DataFrame) -> DataFrame:
    """instances, matched_lines, leaked_lines, patch_missing, corpus_missing of leak_audit's rows."""
    lines = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return audit.agg(F.count("*").alias("instances"), lines("matched").alias("matched_lines"), lines("leaked").alias("leaked_lines"), F.count_if("patch_missing").alias("patch_missing"), F.count_if("corpus_missing").alias("corpus_missing"))


def _occurrences(texts: DataFrame, lines: list[str]) -> DataFrame:
    """line, n_texts: how many texts hold each line, where any does."""
    known = texts.sparkSession.sparkContext.broadcast(lines)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, line in enumerate(known.value):
            automaton.add_word(line, k)
        automaton.make_automaton()
        counts: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for k in {k for _, k in automaton.iter(text.as_py())}:
                        counts[k] = counts.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([known.value[k] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["line", "n"])

    return texts.mapInArrow(run, "line string, n long").groupBy("line").agg(F.sum("n").alias("n_texts"))


def keep_last(rows: DataFrame, key: str, order: str, *needed: str) -> DataFrame:
    """The last row of each key whose needed columns aren't empty, with first_pos, the key's first position."""
    good = F.lit(True)
    for c in needed:
        good = good & (F.coalesce(F.col(c), F.lit("")) != "")
    columns = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.groupBy(key).agg(F.max_by(F.when(good, columns), F.when(good, F.col(order))).alias("row"), F.min(order).alias("first_pos"))
    return last.where("row is not null").select("row.*", "first_pos")


def shards(rows: DataFrame, key: str, workers: int) -> DataFrame:
    """Rows with ``shard``: position in sorted order modulo workers.

    Positions come from counts of range partitions, not from one task that sees all rows.
    """
    return numbered(rows, "_place", key).withColumn("shard", F.pmod("_place", F.lit(workers))).drop("_place")
