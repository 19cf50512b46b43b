"""Edits: parsing and applying them, unified diffs, diff hunks, set cover, and budgeted sections. Plain functions for workers, and their DataFrame forms."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, numbered

_BLOCK = re.compile(r"<<<<<<< SEARCH\n(.*?)\n?=======\n(.*?)\n?>>>>>>> REPLACE", re.S)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_PAIR = re.compile(r"^(\S+)\s+in\s+(\S+)$")


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) of the parts that begin with ``### title``."""
    out = []
    for part in re.split(r"(?m)(?=^###\s)", text or ""):
        if part.startswith("###"):
            head, _, body = part.partition("\n")
            out.append((head[3:].strip(), body))
    return out


def search_replace(text: str) -> list[tuple[str, str, str]]:
    """(path, search, replace) of every block of every section, in order."""
    return [(title.strip("`* "), m[1], m[2]) for title, body in sections(text) for m in _BLOCK.finditer(body)]


def apply_search_replace(content: str, search: str, replace: str) -> str | None:
    """content with the one window of whole lines that equals search replaced; None if there's none, several, or search has no line.

    Lines end as str.splitlines sees them. The content's own line ends stay, and new lines get a line feed.
    """
    want = search.splitlines()
    if not want:
        return None
    lines = content.splitlines(keepends=True)
    bare = content.splitlines()
    at = [k for k in range(len(bare) - len(want) + 1) if bare[k] == want[0] and bare[k : k + len(want)] == want]
    if len(at) != 1:
        return None
    first, last = at[0], at[0] + len(want)
    new = "".join(x + "\n" for x in replace.splitlines())
    if last == len(lines) and lines[-1] == bare[-1]:
        new = new.removesuffix("\n")  # the content's last line has no end either
    return "".join(lines[:first]) + new + "".join(lines[last:])


def node_edits(text: str) -> list[tuple[str, str, str]]:
    """(name, path, code) of sections ``### name in path`` without SEARCH blocks; code comes from the section's fence."""
    out = []
    for title, body in sections(text):
        pair, code = _PAIR.match(title.strip("`* ")), re.search(r"```(?:[A-Za-z]+)?\n(.*?)\n?```", body, re.S)
        if pair and code and "<<<<<<< SEARCH" not in body:
            out.append((pair[1], pair[2], code[1]))
    return out


def replace_lines(content: str, start: int, end: int, expected: str, new: str) -> str | None:
    """content with lines start..end replaced, if they still are the expected source; else None."""
    lines = content.split("\n")
    if start < 1 or end > len(lines) or [x.rstrip() for x in lines[start - 1 : end]] != [x.rstrip() for x in expected.rstrip("\n").split("\n")]:
        return None
    return "\n".join(lines[: start - 1] + new.split("\n") + lines[end:])


def unified(path: str, old: str, new: str) -> str:
    """A unified diff with three lines of context, '' if nothing changes."""
    rows = list(difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{path}", f"b/{path}", lineterm="", n=3))
    return f"diff --git a/{path} b/{path}\n" + "\n".join(rows) + "\n" if rows else ""


def synthesise(files: dict[str, str], edits: list[tuple[str, str, str]]) -> tuple[str, int]:
    """(patch, failed) of search/replace edits in order, files sorted; edits that don't apply are skipped and counted."""
    now, failed = dict(files), 0
    for path, search, replace in edits:
        done = apply_search_replace(now[path], search, replace) if path in now else None
        if done is None:
            failed += 1
        else:
            now[path] = done
    return "".join(unified(p, files[p], now[p]) for p in sorted(files) if now[p] != files[p]), failed


def synthesise_nodes(files: dict[str, str], edits: list[tuple[str, str, str]], index: dict[tuple[str, str], tuple[int, int, str]], rest: list[tuple[str, str, str]] = ()) -> tuple[str, int]:
    """The same for node edits, in the answer's order, and then for search/replace edits (rest).

    index: (name, path) -> (first line, last line, source), as in the unedited file. An edit whose lines
    no longer are that source, because an earlier one has moved them, fails like any other drift.
    """
    now, failed = dict(files), 0
    for name, path, code in edits:
        span = index.get((name, path))
        done = replace_lines(now[path], *span, code) if span is not None and path in now else None
        failed += done is None
        if done is not None:
            now[path] = done
    for path, search, replace in rest:
        done = apply_search_replace(now[path], search, replace) if path in now else None
        failed += done is None
        if done is not None:
            now[path] = done
    return "".join(unified(p, files[p], now[p]) for p in sorted(files) if now[p] != files[p]), failed


def patches(instances: DataFrame) -> DataFrame:
    """instance, patch, failed of rows (instance, answer, files map<path, content>)."""

    def run(batches):
        for pdf in batches:
            out = [synthesise({k: v for k, v in dict(f or {}).items() if v is not None}, search_replace(a)) for a, f in zip(pdf.answer, pdf.files)]
            yield pd.DataFrame({"instance": pdf.instance, "patch": [p for p, _ in out], "failed": [n for _, n in out]})

    return instances.select("instance", "answer", "files").mapInPandas(run, "instance string, patch string, failed int")


@dataclass(frozen=True)
class Hunk:
    """Lines of the old file that a hunk covers; start is the line behind which it inserts if count is 0."""

    file: str
    start: int
    end: int
    count: int
    is_new_file: bool


def hunks(patch: str) -> list[Hunk]:
    """Hunks of a git diff. A new file's are marked, deleted files go by their old name, binary files have none."""
    out, old, new, file, binary = [], None, None, None, False
    for line in (patch or "").split("\n"):
        if line.startswith("diff --git"):
            old = new = file = None
            binary = False
        elif line.startswith("GIT binary patch"):
            binary = True
        elif line.startswith("--- ") and (m := re.match(r"--- (?:a/)?(.+?)\s*$", line)):
            old, binary = m[1], False
        elif line.startswith("+++ ") and (m := re.match(r"\+\+\+ (?:b/)?(.+?)\s*$", line)):
            new = m[1]
            file = old if new == "/dev/null" else new
        elif file and not binary and (m := _HUNK.match(line)):
            start, count = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append(Hunk(file, start, start + max(count, 1) - 1, count, old == "/dev/null"))
    return out


def hunk_rows(rows: DataFrame) -> DataFrame:
    """instance, hunk_id, file, h_start, h_end, count, is_new_file of rows (instance, patch)."""

    def run(batches):
        for pdf in batches:
            out = [(i, k, h.file, h.start, h.end, h.count, h.is_new_file) for i, p in zip(pdf.instance, pdf.patch) for k, h in enumerate(hunks(p))]
            yield pd.DataFrame(out, columns=["instance", "hunk_id", "file", "h_start", "h_end", "count", "is_new_file"])

    return rows.select("instance", "patch").mapInPandas(run, "instance string, hunk_id int, file string, h_start long, h_end long, count long, is_new_file boolean")


def greedy_cover(covers: dict[str, set], costs: dict[str, float]) -> list[str]:
    """Sets that cover all that can be covered, picked by most new elements a cost, then least cost, then id. A free set counts as infinitely good."""
    left, picked = set().union(*covers.values()) if covers else set(), []
    while left:
        ratio = lambda k: (len(covers[k] & left) / costs[k]) if costs[k] else float("inf")
        best = min((k for k in covers if covers[k] & left), key=lambda k: (-ratio(k), costs[k], k))
        picked.append(best)
        left -= covers[best]
    return picked


def covers(rows: DataFrame) -> DataFrame:
    """instance, picked array<set_id> of rows (instance, set_id, element, cost); an instance's sets are one task's work, as each pick depends on the last."""

    own = rows.groupBy("instance").agg(F.collect_list(F.struct("set_id", "element", "cost")).alias("s"))

    def run(batches):
        for batch in batches:
            picked = []
            for entries in batch.column(1).to_pylist():
                sets: dict[str, set] = {}
                costs: dict[str, float] = {}
                for x in entries:
                    sets.setdefault(x["set_id"], set()).add(x["element"])
                    costs[x["set_id"]] = min(x["cost"], costs.get(x["set_id"], x["cost"]))
                picked.append(greedy_cover(sets, costs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.list_(pa.string()))], names=["instance", "picked"])

    return own.mapInArrow(run, f"instance {rows.schema['instance'].dataType.simpleString()}, picked array<string>")


#: Most sets whose costs and ids are sent to the workers; with more, covers() gets all rows.
BROADCAST_SETS = 1_000_000
#: Instances are covered in so many waves, so that the sets of a part of them only are on disk at a time.
WAVES = 8


def _batch_covers(group: np.ndarray, ranks: np.ndarray, sizes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and ranks of the sets picked, in order by group, as greedy_cover would; each row, an element of its group, holds the next sizes ranks.

    While an element is open, its cheapest set is at hand, so no other set is picked for it that costs
    over that set's cost times the instance's elements, and none that serves this element alone. What
    is left are the cheapest sets and the few that serve several elements. That needs costs of 0 or
    more; an element with negative costs only keeps all its sets, and others never need those.
    """
    n, total = int(group[-1]) + 1, len(group)
    row = np.repeat(np.arange(total), sizes)
    first_free = int(np.searchsorted(costs, 0.0))  # ranks below have negative costs
    best = np.minimum.reduceat(np.where(ranks >= first_free, ranks, len(costs)), np.cumsum(sizes) - sizes)
    negative = best == len(costs)
    most = np.where(negative, 0.0, np.append(costs, 0.0)[best]) * np.bincount(group, minlength=n)[group] * (1 + 1e-9)
    keep = np.flatnonzero((ranks >= first_free) & (costs[ranks] <= most[row]) | negative[row])
    row, rank = row[keep], ranks[keep]
    key = group[row].astype(np.int64) * len(costs) + rank
    ordered = np.sort(key)
    several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    place = np.searchsorted(several, key)
    keep = (rank == best[row]) | negative[row]
    if len(several):
        keep |= several[np.minimum(place, len(several) - 1)] == key
    row, key = row[keep], key[keep]
    picks = []
    while len(row):
        sets, which, left = np.unique(key, return_inverse=True, return_counts=True)
        of, rank = np.divmod(sets, len(costs))
        with np.errstate(divide="ignore"):
            ratio = np.where(costs[rank] == 0, np.inf, left / costs[rank])
        order = np.lexsort((rank, -ratio, of))
        chosen = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        picks.append(sets[chosen])
        taken = np.zeros(len(sets), bool)
        taken[chosen] = True
        covered = np.zeros(total, bool)
        covered[row[taken[which]]] = True
        open_ = ~covered[row]
        row, key = row[open_], key[open_]
    picked = np.concatenate(picks)
    of, rank = np.divmod(picked, len(costs))
    order = np.argsort(of, kind="stable")
    return of[order], rank[order]


def offered_covers(need: DataFrame, offers: DataFrame, sets: DataFrame) -> DataFrame:
    """instance, picked array<set_id> as covers() gives them, where each instance (instance, element) may use all sets (set_id, cost) that offer (element, set_id).

    An element's sets are one array of ranks by cost and id, so instances needn't be joined with every
    set of every element as rows. A cost that is null or not a number counts as infinite. Instances
    whose elements nobody offers are left out, as are null ones.
    """
    spark = need.sparkSession
    cost = F.coalesce(F.nanvl(F.col("cost").cast("double"), F.lit(float("inf"))), F.lit(float("inf")))
    own = sets.where("set_id is not null").groupBy("set_id").agg(F.min(cost).alias("cost"))
    own = cut(numbered(own.withColumn("name", F.col("set_id").cast("string")), "rank", "cost", "name"))
    n = own.count()
    need = need.select("instance", "element").where("instance is not null and element is not null")
    if not n:
        return need.limit(0).select("instance", F.array().cast("array<string>").alias("picked"))
    if n > BROADCAST_SETS:
        return covers(need.distinct().join(offers.select("element", "set_id").distinct(), "element").join(own, "set_id").select("instance", F.col("name").alias("set_id"), "element", "cost"))
    known = own.select("rank", "cost", "name").toPandas().sort_values("rank")
    shared = spark.sparkContext.broadcast((known["cost"].to_numpy(), pa.array(known["name"], pa.string())))
    ranked = offers.select("element", "set_id").join(F.broadcast(own.select("set_id", F.col("rank").cast("int").alias("rank"))), "set_id").select("element", "rank")
    lists = ranked.repartition("element").groupBy("element").agg(F.collect_set("rank").alias("ranks")).withColumn("cell", F.monotonically_increasing_id())
    kind = need.schema["instance"].dataType.simpleString()

    def run(batches):
        costs, names = shared.value

        def picked(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            instance = rows.column("instance").combine_chunks()
            group = instance.dictionary_encode().indices.to_numpy()
            cell = rows.column("cell").to_numpy()
            fresh = np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])]  # repeated needs are neighbours
            if not fresh.all():
                rows = rows.filter(pa.array(fresh))
                group = group[fresh]
            held = rows.column("ranks").combine_chunks()
            of, rank = _batch_covers(group, held.flatten().to_numpy(), held.value_lengths().to_numpy(), costs)
            ends = np.searchsorted(of, np.arange(int(group[-1]) + 2)).astype(np.int32)
            return pa.RecordBatch.from_arrays([instance.dictionary_encode().dictionary, pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(rank)))], names=["instance", "picked"])

        waiting = []  # rows of the last instance, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("instance").dictionary_encode().indices.to_numpy()
            last = int(np.searchsorted(codes, codes[-1]))
            if last == 0 and waiting and waiting[-1].column("instance")[-1] == batch.column("instance")[0]:
                waiting.append(batch)
                continue
            if waiting or last:
                yield picked([*waiting, *([batch.slice(0, last)] if last else [])])
            waiting = [batch.slice(last)]
        if waiting:
            yield picked(waiting)

    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")  # shuffle files go once the lists or a wave are done
    out = []
    try:
        lists = cut(lists)
        for wave in range(WAVES):
            some = need.where(F.pmod(F.xxhash64("instance"), F.lit(WAVES)) == wave)
            rows = some.join(lists, "element").select("instance", "cell", "ranks").repartition("instance").sortWithinPartitions("instance", "cell")
            out.append(cut(rows.mapInArrow(run, f"instance {kind}, picked array<string>")))
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return reduce(DataFrame.unionByName, out)


STUB = "[content left out]"


def truncate_sections(parts: list[tuple[str, str]], max_files: int, max_chars: int, total_chars: int) -> list[tuple[str, str]]:
    """(path, text) sections under limits: too long ones keep halves of what they may have around a note of what is left out.

    Once little more than the stub could stand, the stub alone does and costs nothing; notes cost nothing
    either. Sections beyond max_files go.
    """
    out, used = [], 0
    for path, text in parts[:max_files]:
        room = min(max_chars, total_chars - used)
        if room <= len(STUB) + 64:
            out.append((path, STUB))
            continue
        used += min(len(text), room)
        if len(text) > room:
            half = room // 2
            text = f"{text[:half]}\n[{len(text) - room} characters left out]\n{text[len(text) - half :]}"
        out.append((path, text))
    return out


def truncated(sections: Column, max_files: int, max_chars: int, total_chars: int) -> Column:
    """truncate_sections over an ordered array<struct<path, text>>."""
    n = lambda x: F.length(x["text"])
    room = lambda used: F.least(F.lit(max_chars), F.lit(total_chars) - used)

    def step(acc: Column, x: Column) -> Column:
        may = room(acc["used"])
        stub, half = may <= len(STUB) + 64, F.floor(may / 2).cast("int")
        note = F.concat(F.left(x["text"], half), F.lit("\n["), (n(x) - may).cast("string"), F.lit(" characters left out]\n"), F.right(x["text"], half))
        text = F.when(stub, STUB).when(n(x) > may, note).otherwise(x["text"])
        return F.struct((acc["used"] + F.when(stub, 0).otherwise(F.least(n(x), may))).alias("used"), F.array_append(acc["out"], F.struct(x["path"].alias("path"), text.alias("text"))).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<path:string,text:string>>").alias("out"))
    return F.aggregate(F.slice(sections, 1, max_files), start, step, lambda acc: acc["out"])
