"""Reports: what covers a patch's hunks, what each method's contexts cost and hit, what ranking and embedding cost."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import repair as RP
from . import spans as S
from .evaluate import method_summary, token_stats

STATS = ("mean", "median", "p90")


# What covers a patch


def pool_cover(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """instance, n_hunks, contained, partial, outside, new_files, line_share, floor_tokens, fallback_hunks: hunks by class, and the least tokens found that cover the contained ones.

    hunks: instance, hunk_id, file, h_start, h_end, count, is_new_file; nodes: instance, id, file,
    line_start, line_end, cost (positive). line_share: of old files' changed lines, those in contained hunks; null
    if there are none. fallback_hunks: hunks that no node covers. The cover is greedy, by most hunks a token.
    """
    key = lambda c: F.struct("instance", F.col(c).alias("of"))
    h = hunks.withColumns({"hunk_id": key("hunk_id"), "file": key("file")}).drop("instance")
    n = nodes.select(F.col("id").alias("node_id"), key("file").alias("file"), "line_start", "line_end")
    classes = S.classify_hunks(h, n).select("hunk_id.instance", F.col("hunk_id.of").alias("hunk_id"), "class")
    is_ = lambda c: F.col("class") == c
    rows = hunks.join(classes, ["instance", "hunk_id"])
    lines = F.sum(F.when(~is_("new"), F.col("count")))
    counts = rows.groupBy("instance").agg(
        F.count("*").alias("n_hunks"),
        *[F.count_if(is_(c)).alias(name) for c, name in (("contained", "contained"), ("partial", "partial"), ("outside", "outside"), ("new", "new_files"))],
        F.when(lines > 0, F.sum(F.when(is_("contained"), F.col("count")).otherwise(0)) / lines).alias("line_share"),
    )
    pairs = S.hunk_nodes(h, n, "contains").select("hunk_id.instance", F.col("node_id").alias("id"), F.col("hunk_id.of").alias("element"))
    costs = nodes.select("instance", "id", "cost")
    label = F.to_json("instance") if isinstance(hunks.schema["instance"].dataType.jsonValue(), dict) else F.col("instance").cast("string")
    names = hunks.select("instance", label.alias("label")).distinct()
    sets = pairs.join(costs, ["instance", "id"]).join(names, "instance").select(F.col("label").alias("instance"), F.col("id").cast("string").alias("set_id"), "element", F.col("cost").cast("double").alias("cost"))
    picked = RP.covers(sets).select(F.col("instance").alias("label"), F.explode("picked").alias("id")).join(names, "label")
    floor = picked.select("instance", "id").join(costs.withColumn("id", F.col("id").cast("string")), ["instance", "id"]).groupBy("instance").agg(F.sum("cost").alias("floor_tokens"))
    return counts.join(floor, "instance", "left").select(*counts.columns, F.coalesce("floor_tokens", F.lit(0)).cast("long").alias("floor_tokens"), (F.col("n_hunks") - F.col("contained")).alias("fallback_hunks"))


def node_cover(hunks: DataFrame, nodes: DataFrame, pools: DataFrame) -> DataFrame:
    """pool, instance, pool_size, gt_nodes, gt_in_pool, pool_recall, and the columns of pool_cover, for each pool and for ``all`` nodes.

    pools: pool, instance, id. gt nodes overlap a hunk of an old file; pool_recall is null without any.
    An instance without hunks in a pool isn't told; one without nodes in it is.
    """
    old = hunks.where(~F.col("is_new_file"))
    key = lambda c: F.struct("instance", F.col(c).alias("of"))
    over = S.hunk_nodes(old.withColumns({"hunk_id": key("hunk_id"), "file": key("file")}).drop("instance"), nodes.select(F.col("id").alias("node_id"), key("file").alias("file"), "line_start", "line_end"), "overlaps")
    gt = over.select("hunk_id.instance", F.col("node_id").alias("id")).distinct()
    every = nodes.select(F.lit("all").alias("pool"), "instance", "id").unionByName(pools.select("pool", "instance", "id"))
    names = every.select("pool").distinct()
    both = F.struct("pool", "instance")
    held = every.join(nodes, ["instance", "id"]).withColumn("instance", both).drop("pool")
    asked = hunks.join(names).withColumn("instance", both).drop("pool")
    cover = pool_cover(asked, held).select("instance.pool", "instance.instance", *["n_hunks", "contained", "partial", "outside", "new_files", "line_share", "floor_tokens", "fallback_hunks"])
    sizes = every.join(gt.withColumn("hit", F.lit(1)), ["instance", "id"], "left").groupBy("pool", "instance").agg(F.count("*").alias("pool_size"), F.count("hit").alias("gt_in_pool"))
    gts = gt.groupBy("instance").agg(F.count("*").alias("gt_nodes"))
    rows = cover.join(sizes, ["pool", "instance"], "left").join(gts, "instance", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select("pool", "instance", zero("pool_size").alias("pool_size"), zero("gt_nodes").alias("gt_nodes"), zero("gt_in_pool").alias("gt_in_pool"), (zero("gt_in_pool") / F.nullif("gt_nodes", F.lit(0))).alias("pool_recall"), *cover.columns[2:])


def cover_report(rows: DataFrame) -> DataFrame:
    """pool, n, hunk_share (contained of all old files' hunks), line_share (mean), pool_recall (mean), fully_covered, pool_size (upper median), floor_mean, floor_median, floor_p90 of node_cover's rows."""
    sums = rows.groupBy("pool").agg(
        F.count("*").alias("n"),
        (F.sum("contained") / F.nullif(F.sum(F.col("contained") + F.col("partial") + F.col("outside")), F.lit(0))).alias("hunk_share"),
        F.avg("line_share").alias("line_share"),
        F.avg("pool_recall").alias("pool_recall"),
        F.avg((F.col("fallback_hunks") == 0).cast("double")).alias("fully_covered"),
    )
    sizes = token_stats(rows, ["pool"], F.col("pool_size")).select("pool", F.col("upper_median").alias("pool_size"))
    floors = token_stats(rows, ["pool"], F.col("floor_tokens")).select("pool", *[F.col(c).alias(f"floor_{c}") for c in STATS])
    return sums.join(sizes, "pool", "left").join(floors, "pool", "left")


# What contexts cost and hit


def _record(rows: DataFrame, method: str, text: Column, counter: Callable, paths: Column) -> DataFrame:
    return rows.select(F.lit(method).alias("method"), "instance", counter(text).cast("long").alias("tokens"), F.size(paths).cast("long").alias("files"), (F.size(F.array_intersect(paths, T.patched_files(F.col("patch")))) > 0).alias("hit"))


def method_records(instances: DataFrame, bm25: DataFrame, found: DataFrame, corpus: DataFrame, solver: DataFrame | None = None, counter: Callable[[Column], Column] = T.tokens_quarter) -> DataFrame:
    """method, instance, tokens, files, hit, from_pool, output_tokens: a row for each method and instance.

    instances: instance, issue, patch, text_inputs; bm25: instance, text; found: instance, found_files
    array; corpus: instance, path, contents; solver: instance, prompt, output, adds the method kg_sr,
    which falls back on text_inputs where it has no prompt (from_pool). A hit shares a file with the
    patch. A missing or empty BM25 text has null tokens and hit. Found files cost the issue and the
    contents that the corpus has.
    """
    none = lambda kind: F.lit(None).cast(kind)
    text = F.coalesce("text_inputs", F.lit(""))
    marks = lambda c: F.array_distinct(T.marked_files(c, "strict"))
    parts = [_record(instances, "kg_pool", text, counter, marks(text)).withColumns({"from_pool": none("boolean"), "output_tokens": none("long")})]
    if solver is not None:
        both = instances.join(solver.select("instance", F.nullif("prompt", F.lit("")).alias("prompt"), F.nullif("output", F.lit("")).alias("output")), "instance", "left").withColumn("used", F.coalesce("prompt", text))
        extra = both.select("instance", F.col("prompt").isNull().alias("from_pool"), F.when(F.col("prompt").isNotNull(), counter(F.col("output"))).cast("long").alias("output_tokens"))
        parts.append(_record(both, "kg_sr", F.col("used"), counter, marks(F.col("used"))).join(extra, "instance"))
    given = instances.join(bm25.select("instance", F.nullif("text", F.lit("")).alias("text")), "instance", "left")
    told = _record(given, "bm25_k5", F.col("text"), counter, F.coalesce(marks(F.col("text")), F.array().cast("array<string>")))
    told = told.join(given.select("instance", F.col("text").isNull().alias("none")), "instance").withColumn("hit", F.when(~F.col("none"), F.col("hit"))).drop("none")
    parts.append(told.withColumns({"from_pool": none("boolean"), "output_tokens": none("long")}))
    lists = instances.join(found.select("instance", "found_files"), "instance", "left").withColumn("found_files", F.coalesce("found_files", F.array().cast("array<string>")))
    cost = lists.select("instance", F.explode("found_files").alias("path")).join(corpus.select("instance", "path", counter(F.col("contents")).alias("t")), ["instance", "path"]).groupBy("instance").agg(F.sum("t").alias("t"))
    listed = _record(lists, "agentless", F.col("issue"), counter, F.col("found_files")).join(cost, "instance", "left").withColumn("tokens", F.col("tokens") + F.coalesce("t", F.lit(0))).drop("t")
    parts.append(listed.withColumns({"from_pool": none("boolean"), "output_tokens": none("long")}))
    return reduce(DataFrame.unionByName, parts)


def found_missing(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """instance, path: found files that the corpus lacks, a row a mention."""
    return found.select("instance", F.explode("found_files").alias("path")).join(corpus.select("instance", "path"), ["instance", "path"], "left_anti")


def method_report(records: DataFrame) -> DataFrame:
    """method, n, avg_files, acc, tokens_per_hit, mean, median, p90, n_fallback, output_n, output_mean, output_median, output_p90 of records with tokens."""
    rows = records.where("tokens is not null")
    stats = token_stats(rows, ["method"], F.col("tokens")).select("method", *STATS)
    out = token_stats(rows, ["method"], F.col("output_tokens")).select("method", *[F.col(c).alias(f"output_{c}") for c in STATS])
    more = rows.groupBy("method").agg(F.count_if("from_pool").alias("n_fallback"), F.count("output_tokens").alias("output_n"))
    return method_summary(rows).join(stats, "method").join(more, "method").join(out, "method", "left")


def usage_summary(usages: DataFrame) -> DataFrame:
    """stage, n, avg_calls, and mean, median and p90 of prompt, completion and total tokens. usages: stage, instance, prompt_tokens, completion_tokens, calls."""
    out = usages.groupBy("stage").agg(F.count("*").alias("n"), F.avg("calls").alias("avg_calls"))
    for name, v in (("prompt", F.col("prompt_tokens")), ("completion", F.col("completion_tokens")), ("total", F.col("prompt_tokens") + F.col("completion_tokens"))):
        out = out.join(token_stats(usages, ["stage"], v).select("stage", *[F.col(c).alias(f"{name}_{c}") for c in STATS]), "stage")
    return out


def solve_summary(predictions: DataFrame, keys: list[str], counter: Callable[[Column], Column] = T.tokens_quarter) -> DataFrame:
    """keys, n, output_n, and mean, median and p90 of input, output and total tokens of predictions (keys, prompt, output); empty texts count for the total only."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    size = lambda c: F.coalesce(counter(F.col(c)), F.lit(0))
    out = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(there("output")).alias("output_n"))
    values = {"input": F.when(there("prompt"), size("prompt")), "output": F.when(there("output"), size("output")), "total": F.when(there("prompt") | there("output"), size("prompt") + size("output"))}
    for name, v in values.items():
        out = out.join(token_stats(predictions, keys, v).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in STATS]), keys, "left")
    return out


def rerank_cost(prompts: DataFrame, calls: DataFrame, answers: DataFrame) -> DataFrame:
    """instance, n_chunks, input_tokens, output_tokens_estimate, retry_multiplier of list-wise ranking.

    prompts: instance, tokens, a row a chunk; calls: instance, n_calls (0: unknown, counted as one a
    chunk); answers: instance, tokens of the expected answer. Prompts count n_calls / n_chunks times,
    and answers get 16 tokens more. An instance without chunks costs nothing.
    """
    sums = prompts.groupBy("instance").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))
    rows = calls.join(sums, "instance", "left").join(answers.select("instance", F.col("tokens").alias("answer")), "instance", "left")
    times = F.when(F.col("n_chunks").isNotNull(), F.when(F.col("n_calls") > 0, F.col("n_calls") / F.col("n_chunks")).otherwise(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("instance", zero(F.col("n_chunks")).alias("n_chunks"), zero(F.bround(F.col("tokens") * times, 0)).alias("input_tokens"), zero(F.when(F.col("n_chunks").isNotNull(), F.coalesce("answer", F.lit(0)) + 16)).alias("output_tokens_estimate"), F.bround(times, 3).alias("retry_multiplier"))


def rerank_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean_input, median_input (upper), mean_output, avg_chunks, avg_retry of rerank_cost's rows."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("input_tokens").alias("mean_input"), F.avg("output_tokens_estimate").alias("mean_output"), F.avg("n_chunks").alias("avg_chunks"), F.avg(F.coalesce("retry_multiplier", F.lit(1.0))).alias("avg_retry"))
    return sums.join(token_stats(rows, keys, F.col("input_tokens")).select(*keys, F.col("upper_median").alias("median_input")), keys)


def embed_totals(documents: DataFrame, prefix: str = "", cap: int = 8192) -> DataFrame:
    """graphs, nodes, total_chars of what an embedding run would send. documents: graph, text, a row a node; each text with its prefix is cut at cap."""
    size = F.least(F.length("text") + len(prefix), F.lit(cap))
    return documents.agg(F.count_distinct("graph").alias("graphs"), F.count("*").alias("nodes"), F.coalesce(F.sum(size), F.lit(0)).alias("total_chars"))
