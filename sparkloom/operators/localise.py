"""Localisation by list-wise ranking: signals of files and nodes, prompt blocks, prompts in chunks, answers, and the run that keeps its progress.

Candidates are rows; only the calls of the model run in workers, by an injected function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rank as R
from . import spans as S
from .evaluate import keep_last
from .lineage import cut

CODE_TYPES = ("Function", "Method", "Class")
#: (temperature, thinking) of the attempts at one answer, in order (fixed values).
ATTEMPTS = ((0.0, True), (0.0, False), (0.7, False))
#: What stands before the issue, the number of candidates and their blocks in a prompt.
FRAME = (
    "Rank these candidates by how likely the issue is to be fixed in them.\nAnswer with a JSON array of the {k} likeliest names, the likeliest first, and nothing else.\n\nIssue:\n",
    "\n\nCandidates (",
    "):\n\n",
)
ANSWERS = "chunk int, answer array<string>, calls int"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def code_nodes(nodes: DataFrame, truthy: bool = True) -> DataFrame:
    """Functions, methods and classes with a span and a source.

    nodes: meta_type, props. truthy: an empty source and a first line 0 count as missing; else only
    absent values do. Adds line_start, line_end (long) and source_code.
    """
    value = lambda k: F.col("props")[k]
    rows = nodes.where(F.col("meta_type").isin(*CODE_TYPES)).withColumns({"line_start": F.expr("try_cast(props['line_start'] as bigint)"), "line_end": F.expr("try_cast(props['line_end'] as bigint)"), "source_code": value("source_code")})
    there = F.col("source_code").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    return rows.where(there & (F.col("source_code") != "") & (F.col("line_start") != 0) & (F.col("line_end") != 0) if truthy else there)


def touch_frequency(touches: DataFrame) -> DataFrame:
    """instance, id, freq: how often each node was touched. touches: instance, id, a row a touch."""
    return touches.groupBy("instance", "id").agg(F.count("*").alias("freq"))


def node_signals(nodes: DataFrame, touches: DataFrame, top_files: DataFrame, sims: DataFrame | None = None, head_chars: int = 120) -> DataFrame:
    """instance, pos, id, path, kind, name, line_start, line_end, touch_freq, head, sim: Python nodes of an instance's top files, most touched first, then by id.

    nodes: instance, id, path, kind, line_start, line_end, source_code; top_files: instance, path;
    sims: instance, id, sim, or None. A node never touched has frequency 0.
    """
    own = nodes.where(F.col("path").endswith(".py")).join(top_files.select("instance", "path").distinct(), ["instance", "path"], "left_semi")
    rows = own.join(touch_frequency(touches), ["instance", "id"], "left")
    rows = rows.join(sims.select("instance", "id", "sim"), ["instance", "id"], "left") if sims is not None else rows.withColumn("sim", F.lit(None).cast("double"))
    rows = rows.withColumn("touch_freq", F.coalesce("freq", F.lit(0).cast("long")))
    pos = F.row_number().over(W.partitionBy("instance").orderBy(F.desc("touch_freq"), "id"))
    return rows.select("instance", pos.alias("pos"), "id", "path", "kind", F.substring_index("id", "-", -1).alias("name"), "line_start", "line_end", "touch_freq", F.left(stripped(F.col("source_code")), F.lit(head_chars)).alias("head"), "sim")


def file_signals(touches: DataFrame, sims: DataFrame | None = None, subparts: int = 3, source_chars: int = 120) -> DataFrame:
    """instance, pos, path, touch_freq, sim_max, sim_mean (of the three best), parts: Python files by touches, ties by first touch.

    touches: instance, seq, id, path, props map<string,string>, a row a touch; sims: instance, id, sim.
    parts: the first ``subparts`` touches (at least one) whose node has properties, in the order of
    exploration, as struct<kind, name, docstring, line_start, line_end, source>; source_chars 0 keeps
    whole sources.
    """
    rows = touches.where(F.col("path").endswith(".py"))
    rows = rows.join(sims.select("instance", "id", "sim"), ["instance", "id"], "left") if sims is not None else rows.withColumn("sim", F.lit(None).cast("double"))
    p, by = F.col("props"), W.partitionBy("instance", "path")
    source = stripped(F.coalesce(p["source_code"], F.lit("")))
    source = F.replace(F.left(source, F.lit(source_chars)) if source_chars else source, F.lit("\n"), F.lit(" | "))
    docstring = F.element_at(F.split(stripped(F.coalesce(p["docstring"], F.lit(""))), "\n"), 1)
    name = F.coalesce(F.nullif(p["name"], F.lit("")), F.substring_index("id", "-", -1))
    part = F.struct("seq", F.coalesce(p["meta_type"], F.lit("")).alias("kind"), name.alias("name"), docstring.alias("docstring"), p["line_start"].alias("line_start"), p["line_end"].alias("line_end"), source.alias("source"))
    held = F.coalesce(F.size(p), F.lit(0)) > 0
    # Of a file's touches only the first few with properties and the three best similarities are gathered.
    k_part = F.sum(held.cast("int")).over(by.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    k_sim = F.row_number().over(by.orderBy(F.desc_nulls_last("sim"), "seq"))
    rows = rows.select("instance", "path", "seq", "sim", F.when(held & (k_part <= max(1, subparts)), part).alias("part"), k_sim.alias("k_sim"))
    files = rows.groupBy("instance", "path").agg(
        F.count("*").alias("touch_freq"),
        F.min("seq").alias("first_seq"),
        F.max("sim").alias("sim_max"),
        F.round(F.avg(F.when(F.col("k_sim") <= 3, F.col("sim"))), 4).alias("sim_mean"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    pos = F.row_number().over(W.partitionBy("instance").orderBy(F.desc("touch_freq"), "first_seq", "path"))
    bare = F.transform("parts", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "name", "docstring", "line_start", "line_end", "source")]))
    return files.select("instance", pos.alias("pos"), "path", "touch_freq", "sim_max", "sim_mean", bare.alias("parts"))


def _line(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def file_block(signals: list[str]) -> Column:
    """A file's block for a prompt, from the columns of file_signals; signals: some of freq, sim_max, sim_mean, parts."""
    on = lambda name, value: value if name in signals else F.lit(None).cast("string")
    told = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    head = _line(on("freq", told("touched", "touch_freq")), on("sim_max", told("similarity", "sim_max")), on("sim_mean", told("best three", "sim_mean")))
    span = lambda x: F.concat(F.lit("- "), x["kind"], F.lit(" "), x["name"], F.lit(" (lines "), F.coalesce(x["line_start"], F.lit("?")), F.lit("-"), F.coalesce(x["line_end"], F.lit("?")), F.lit(")"))
    one = lambda x: F.concat(span(x), F.when(x["docstring"] != "", F.concat(F.lit(': "'), x["docstring"], F.lit('"'))).otherwise(""), F.when(x["source"] != "", F.concat(F.lit("\n  "), x["source"])).otherwise(""))
    parts = on("parts", F.nullif(F.array_join(F.transform("parts", one), "\n"), F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("### "), "path"), head, parts)


def node_block(signals: list[str]) -> Column:
    """A node's block for a prompt, from the columns of node_signals; signals: some of freq, sim."""
    where = F.concat_ws(" | ", "kind", "name", F.concat(F.lit("lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")), "path")
    on = lambda name, value: value if name in signals else F.lit(None).cast("string")
    told = _line(on("freq", F.concat(F.lit("touched: "), F.col("touch_freq").cast("string"))), on("sim", F.when(F.col("sim").isNotNull(), F.concat(F.lit("similarity: "), F.format_string("%.4f", "sim")))))
    return F.concat_ws("\n", F.concat(F.lit("### "), "id"), where, told, F.when(F.col("head") != "", F.replace("head", F.lit("\n"), F.lit(" | "))))


def list_prompt(issue: Column, blocks: Column, n: Column, k: int) -> Column:
    """The question that asks for the k likeliest of n candidates; blocks: array<string>."""
    return F.concat(F.lit(FRAME[0].format(k=k)), issue, F.lit(FRAME[1]), n.cast("string"), F.lit(FRAME[2]), F.array_join(blocks, "\n\n"))


def list_prompts(blocks: DataFrame, issues: DataFrame, k: int, max_chars: int) -> DataFrame:
    """instance, chunk, items array<string>, prompt: candidates in order, in chunks whose prompts are at most max_chars long.

    blocks: instance, pos, item, block; issues: instance, issue. A chunk closes when the next block
    would make its prompt too long; each has one candidate at least.
    """
    empty = list_prompt(F.col("issue"), F.array().cast("array<string>"), F.lit(0), k)
    rows = blocks.join(issues.select("instance", "issue", F.length(empty).alias("overhead")), "instance")
    size = F.length("block") + 2
    # What a prompt leaves for blocks differs by instance.
    left = rows.withColumn("room", F.greatest(F.lit(max_chars) - F.col("overhead"), F.lit(0)))
    own = left.groupBy("instance", "issue", "room").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "block", size.cast("long").alias("size")))).alias("e"))
    batch = S.fold_batches(F.col("e"), F.lit(2**31 - 1), F.col("room"))
    each = own.select("instance", "issue", F.explode(F.arrays_zip("e", batch.alias("batch"))).alias("x")).select("instance", "issue", "x.e.pos", "x.e.item", "x.e.block", F.col("x.batch").alias("chunk"))
    chunks = each.groupBy("instance", "issue", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "block"))).alias("c"))
    names, texts = F.transform("c", lambda x: x["item"]), F.transform("c", lambda x: x["block"])
    return chunks.select("instance", "chunk", names.alias("items"), list_prompt(F.col("issue"), texts, F.size("c"), k).alias("prompt"))


def parse_list(text: str | None) -> list[str] | None:
    """The first bracketed JSON array of strings, else None; functions.text.list_answer for workers."""
    found = re.search(r"\[.*?\]", text or "", re.S)
    try:
        out = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return out if isinstance(out, list) and all(isinstance(x, str) for x in out) else None


def ask_all(prompts: DataFrame, ask: Callable[[str, float, bool], str], attempts: tuple = ATTEMPTS) -> DataFrame:
    """instance, chunk, answer, calls of prompts (instance, chunk, prompt): each is asked until an answer is a list, with the attempts' settings in turn; null if none is.

    A call that raises is a failed attempt.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for instance, chunk, prompt in zip(pdf.instance, pdf.chunk, pdf.prompt):
                answer, calls = None, 0
                for temperature, thinking in attempts:
                    calls += 1
                    try:
                        answer = parse_list(ask(prompt, temperature, thinking))
                    except Exception:  # noqa: BLE001  whatever the provider raises
                        continue
                    if answer is not None:
                        break
                out.append((instance, chunk, answer, calls))
            yield pd.DataFrame(out, columns=["instance", "chunk", "answer", "calls"])

    kind = prompts.schema["instance"].dataType.simpleString()
    return prompts.select("instance", "chunk", "prompt").mapInPandas(run, f"instance {kind}, {ANSWERS}")


def rank_listwise(blocks: DataFrame, issues: DataFrame, ask: Callable, k: int = 5, max_chars: int = 100_000) -> DataFrame:
    """instance, ranked array<string>, failed, n_files, n_comparisons (calls): candidates ranked by the model's answers to each chunk.

    Winners of chunks take turns, then come the rest in the given order. Names that aren't in the
    chunk are dropped. It failed only if every chunk did. One candidate is a ranking already.
    """
    n = blocks.groupBy("instance").agg(F.count("*").alias("n_files"))
    prompts = list_prompts(blocks.join(n.where("n_files > 1"), "instance", "left_semi"), issues, k, max_chars)
    answers = prompts.select("instance", "chunk", "items").join(ask_all(prompts, ask), ["instance", "chunk"])
    won = answers.select("instance", "chunk", F.posexplode(F.array_intersect("answer", "items")).alias("pos", "item"))
    pool = blocks.select("instance", "pos", "item")
    merged = R.merge_chunks(won, pool)
    ranked = merged.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("ranked"))
    told = answers.groupBy("instance").agg(F.every(F.col("answer").isNull()).alias("failed"), F.sum("calls").alias("n_comparisons"))
    return n.join(ranked, "instance").join(told, "instance", "left").select("instance", "ranked", F.coalesce("failed", F.lit(False)).alias("failed"), "n_files", F.coalesce("n_comparisons", F.lit(0).cast("long")).alias("n_comparisons"))


def rank_pairwise(candidates: DataFrame, judge: Callable[[str, str, str], str | None]) -> DataFrame:
    """instance, ranked, failed, n_files, n_comparisons: each instance's items (instance, issue, items array<string>) sorted by a judge of pairs.

    judge(issue, a, b) names "a" or "b"; if it ever names neither, the given order stays. An instance's
    comparisons depend on each other, so they are one worker's.
    """
    kind = candidates.schema["instance"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for instance, issue, items in zip(pdf.instance, pdf.issue, pdf["items"]):
                ranked, calls, failed = R.comparator_sort(list(items), lambda a, b: judge(issue, a, b))  # noqa: B023
                out.append((instance, ranked, failed, len(items), calls))
            yield pd.DataFrame(out, columns=["instance", "ranked", "failed", "n_files", "n_comparisons"])

    return candidates.select("instance", "issue", "items").mapInPandas(run, f"instance {kind}, ranked array<string>, failed boolean, n_files long, n_comparisons long")


def rankable(progress: DataFrame, split: DataFrame, gold: DataFrame, only: str | None = None) -> DataFrame:
    """The last finished row of each instance that is in the split and has gold files, and is ``only`` if given.

    progress: instance, text_inputs and an ordering column line_no; split, gold: column instance.
    """
    rows = progress if only is None else progress.where(F.col("instance") == only)
    rows = rows.join(split.select("instance").distinct(), "instance", "left_semi").join(gold.select("instance").distinct(), "instance", "left_semi")
    return keep_last(rows, "instance", "line_no", "text_inputs")


def models(progress: DataFrame) -> DataFrame:
    """model: the distinct non-empty ones that a progress table names."""
    return progress.where(F.coalesce("model", F.lit("")) != "").select("model").distinct()


def rank_run(spark: SparkSession, blocks: DataFrame, issues: DataFrame, path: str, ask: Callable, model: str = "", limit: int = 0, dry_run: bool = False, spec: dict | None = None, **options) -> dict:
    """Ranks the instances that the progress table at ``path`` (JSON lines) lacks, and appends them: run statistics.

    limit: how many new ones, the first by id, at most (0: all). dry_run only counts, with one call
    an instance as the estimate. spec: columns that every row carries.
    """
    from ..sources.files import RERANK, path_exists, read_lines

    every = blocks.select("instance").distinct()
    done = read_lines(spark, path, RERANK).select(F.col("instance_id").alias("instance")).distinct() if path_exists(spark, path) else every.limit(0)
    todo = every.join(done, "instance", "left_anti")
    n_all, n = every.count(), todo.count()
    stats = {"instances": n, "skipped": n_all - n, "processed": 0, "failed": 0, "comparisons": 0, "estimated_comparisons": n}
    if dry_run or not n:
        return stats
    if limit:
        todo = todo.orderBy("instance").limit(limit)
    ranked = rank_listwise(blocks.join(todo, "instance", "left_semi"), issues, ask, **options)
    rows = ranked.select(F.col("instance").alias("instance_id"), F.lit(model).alias("model"), F.col("ranked").alias("ranked_files"), "failed", "n_files", "n_comparisons", *[F.lit(v).alias(c) for c, v in (spec or {}).items()])
    rows = cut(rows)  # asked once, and apart from the table that it is appended to
    rows.write.mode("append").json(path)
    sums = rows.agg(F.count("*").alias("processed"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("n_comparisons"), F.lit(0)).alias("comparisons")).first()
    return stats | sums.asDict()


def pools(nodes: DataFrame, touches: DataFrame, ranked: DataFrame, ks: tuple = (1, 3, 5)) -> DataFrame:
    """pool, instance, id: all nodes of the k first files (file<k>), all touched ones (touched), and those touched in the five first files (touched_file5).

    nodes: instance, id, path; touches: instance, id; ranked: instance, pos (from 1), path.
    """
    own = nodes.select("instance", "id", "path")
    top = lambda k: own.join(ranked.where(F.col("pos") <= k).select("instance", "path").distinct(), ["instance", "path"], "left_semi")
    hit = touches.select("instance", "id").distinct()
    parts = [(f"file{k}", top(k)) for k in sorted(set(ks))] + [("touched", own.join(hit, ["instance", "id"], "left_semi")), ("touched_file5", top(5).join(hit, ["instance", "id"], "left_semi"))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("pool"), "instance", "id") for name, df in parts])


def repair_prompt(issue: Column, code: Column, mode: str = "sr") -> Column:
    """The question for a repair: as search/replace edits ("sr") or as whole nodes ("node")."""
    how = {
        "sr": "For each change give a section: a line '### path', then blocks\n<<<<<<< SEARCH\nlines as they are\n=======\nlines as they should be\n>>>>>>> REPLACE",
        "node": "For each function, method or class to change give a section: a line '### name in path', then its new source in a code fence. Other changes go in SEARCH and REPLACE blocks under '### path'.",
    }[mode]
    return F.concat(F.lit("Fix this issue in the code below.\n\nIssue:\n"), issue, F.lit("\n\nCode:\n"), code, F.lit(f"\n\n{how}\n"))


def repair_run(spark: SparkSession, prompts: DataFrame, path: str, ask: Callable[[str, bool], str], model: str = "") -> dict:
    """Answers of prompts (instance, prompt) that the predictions at ``path`` (JSON lines) lack are appended: instance_id, model_name_or_path, text, full_output, thinking_retry.

    A blank answer is asked for once more without thinking. Returns counts.
    """
    from ..sources.files import path_exists, read_lines

    done = read_lines(spark, path, "instance_id string").select(F.col("instance_id").alias("instance")).distinct() if path_exists(spark, path) else None
    todo = prompts if done is None else prompts.join(done, "instance", "left_anti")

    def run(batches):
        for pdf in batches:
            out = []
            for instance, prompt in zip(pdf.instance, pdf.prompt):
                text, again = ask(prompt, True), False
                if not (text or "").strip():
                    text, again = ask(prompt, False), True
                out.append((instance, model, prompt, text or "", again))
            yield pd.DataFrame(out, columns=["instance_id", "model_name_or_path", "text", "full_output", "thinking_retry"])

    schema = "instance_id string, model_name_or_path string, text string, full_output string, thinking_retry boolean"
    rows = cut(todo.select("instance", "prompt").mapInPandas(run, schema))
    rows.write.mode("append").json(path)
    sums = rows.agg(F.count("*").alias("processed"), F.count_if("thinking_retry").alias("retried")).first().asDict()
    return sums | {"skipped": prompts.count() - sums["processed"]}
