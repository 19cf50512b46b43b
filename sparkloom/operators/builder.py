"""Building a graph from a schema's executors: resolved by name, run phase by phase, committed in batches, checked at the end.

An executor gives a Batch of tables for the files it is given; the schema's types name it. Names are
looked up in a registry and never imported, so a schema can run nothing that isn't registered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import path_exists
from . import extract as X
from . import validate as VA
from .graph import PropertyGraph, from_rows
from .write import Batch, load_snapshot, save_snapshot, update_graph


@dataclass
class Context:
    """What an executor sees: its files (path, content), the requirements' lines, and the graph so far."""

    spark: SparkSession
    files: DataFrame
    requirements: DataFrame | None
    graph: PropertyGraph


@dataclass(frozen=True)
class Executor:
    """phase: executors of a lower one come first. run: Context -> Batch."""

    name: str
    phase: int
    run: Callable[[Context], Batch]


@dataclass
class Summary:
    total_nodes: int = 0
    total_edges: int = 0
    skipped_edges: int = 0
    committed_batches: int = 0
    rejected_batches: int = 0
    errors: list = field(default_factory=list)
    verification_passed: bool | None = None
    verification_errors: list = field(default_factory=list)

    def __str__(self) -> str:
        state = {True: "passed", False: "failed", None: "not run"}[self.verification_passed]
        return f"{self.total_nodes} nodes, {self.total_edges} edges ({self.skipped_edges} skipped) in {self.committed_batches} batches ({self.rejected_batches} rejected), {len(self.errors)} errors, verification {state}"


def _batch(facts: DataFrame, edges: DataFrame | None = None) -> Batch:
    """A batch of nodes (id, label, props) and edges (label, source, target)."""
    values = facts.select("id", F.explode("props").alias("key", "value"))
    own = edges.distinct().select(F.concat_ws("-", "source", "label", "target").alias("id"), "label", "source", "target") if edges is not None else None
    return Batch(nodes=facts.select("id", "label"), edges=own, values=values)


def _folders(ctx: Context) -> Batch:
    files = X.wanted(ctx.files)
    dirs, contains = X.folders(files)
    tree = dirs.select("id", "label", F.create_map(F.lit("meta_type"), F.lit("Directory"), F.lit("relative_path"), F.col("folder")).alias("props"))
    leaves = files.select(F.concat(F.lit("File-"), "path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.create_map(F.lit("meta_type"), F.lit("File"), F.lit("relative_path"), F.col("path")).alias("props"))
    return _batch(tree.unionByName(leaves), contains.withColumn("label", F.lit("CONTAINS")))


def _sources(ctx: Context) -> Batch:
    facts = X.extract(X.wanted(ctx.files))
    order = F.struct("path", "seq")
    nodes = facts.where("kind = 'node'").groupBy("id").agg(F.max_by("label", order).alias("label"), F.max_by("props", order).alias("props"))
    return _batch(nodes, facts.where("kind = 'edge'").select("label", "source", "target"))


def _dependencies(ctx: Context) -> Batch:
    if ctx.requirements is None:
        return Batch()
    deps = X.dependencies(ctx.requirements)
    props = F.map_filter(F.create_map(F.lit("meta_type"), F.lit("Dependency"), F.lit("name"), F.col("name"), F.lit("version"), F.col("version")), lambda k, v: v.isNotNull())
    names = deps.agg(F.array_sort(F.collect_list("name")).alias("names"))  # one row: the lines of one file
    edges = X.wanted(ctx.files).join(F.broadcast(names)).select(F.concat(F.lit("File-"), "path").alias("source"), F.explode("names").alias("n"))
    return _batch(deps.select(F.concat(F.lit("Dependency-"), "name").alias("id"), F.col("name").alias("label"), props.alias("props")), edges.select(F.lit("DEPENDS_ON").alias("label"), "source", F.concat(F.lit("Dependency-"), "n").alias("target")))


def _links(ctx: Context) -> Batch:
    facts, nodes = X.extract(X.wanted(ctx.files)), ctx.graph.nodes
    parts = [df.withColumn("label", F.lit(rel)) for rel, df in (("CALLS", X.resolve_calls(facts, nodes)), ("IMPORTS", X.resolve_imports(facts, nodes)), ("INHERITS", X.resolve_bases(facts, nodes)))]
    edges = VA.union(parts).distinct().select(F.concat_ws("-", "source", "label", "target").alias("id"), "label", "source", "target")
    return Batch(edges=edges)


EXECUTORS = {e.name: e for e in (Executor("python:folders", 0, _folders), Executor("python:sources", 1, _sources), Executor("python:dependencies", 1, _dependencies), Executor("python:links", 2, _links))}


def schema_executors(meta: PropertyGraph) -> DataFrame:
    """executor, types array<string>: what a meta graph's node and edge types name as their executor, once each."""
    rows = meta.nodes.where(F.col("meta_type").isin("NodeType", "EdgeType")).select(F.col("props")["executor"].alias("executor"), "id").where("executor <> ''")
    return rows.groupBy("executor").agg(F.array_sort(F.collect_set("id")).alias("types"))


def resolve(named: DataFrame, known: dict[str, Executor] = EXECUTORS) -> list[Executor]:
    """The executors of schema_executors' rows by phase. An unknown name raises and tells its types. A schema is a short list."""
    rows = sorted(named.collect())
    if missing := [(r.executor, r.types) for r in rows if r.executor not in known]:
        raise LookupError("; ".join(f"no executor {name!r} for {', '.join(types)}" for name, types in missing))
    return sorted((known[r.executor] for r in rows), key=lambda e: e.phase)


def file_batches(files: DataFrame, size: int) -> DataFrame:
    """Files with ``batch``: their place by path, divided by size."""
    return files.withColumn("batch", F.floor((F.row_number().over(W.orderBy("path")) - 1) / size)) if size else files.withColumn("batch", F.lit(0).cast("long"))


def build(spark: SparkSession, files: DataFrame, executors: list[Executor], allowed: DataFrame | None = None, requirements: DataFrame | None = None, batch_size: int = 0, verify_commits: Callable | None = None, verify: Callable | None = None) -> tuple[PropertyGraph, Summary]:
    """(graph, summary) of a source tree's files.

    Executors run by phase; one that fails is told in the summary and the others go on. Of a batch, edges
    that no signature (allowed: label, source_type, target_type) fits are left out. batch_size: files a
    commit (0: all in one, which is what suits large trees). verify_commits and verify give violations of a graph.
    """
    graph, told = from_rows(spark, [], []), Summary()
    for executor in executors:
        whole = executor.phase > 1  # links go from any file to any other
        dealt = file_batches(files, 0 if whole else batch_size).cache()
        try:
            for k in sorted(r.batch for r in dealt.select("batch").distinct().collect()):
                ctx = Context(spark, dealt.where(F.col("batch") == k).drop("batch"), requirements, graph)
                graph = _commit(spark, graph, executor.run(ctx), allowed, verify_commits, told, executor.name)
        except Exception as e:  # noqa: BLE001  one executor's failure must not end the build
            told.errors.append({"source": executor.name, "message": str(e)})
        finally:
            dealt.unpersist()
    if verify is not None:
        found = verify(graph).limit(101).collect()
        told.verification_passed, told.verification_errors = not found, [r.asDict() for r in found]
    return graph, told


def _commit(spark: SparkSession, graph: PropertyGraph, batch: Batch, allowed: DataFrame | None, verify: Callable | None, told: Summary, source: str) -> PropertyGraph:
    if batch.edges is not None and allowed is not None:
        kinds = graph.nodes.select("id", "meta_type")
        if batch.values is not None:
            new = batch.values.where("key = 'meta_type'").select("id", F.col("value").alias("meta_type"))
            kinds = kinds.join(new, "id", "left_anti").unionByName(new)
        kept, dropped = VA.keep_valid_edges(PropertyGraph(kinds, batch.edges), allowed)
        told.skipped_edges += dropped.count()
        batch = Batch(batch.nodes, kept, batch.values)
    done = update_graph(spark, graph, batch, verify)
    if not done.committed:
        told.rejected_batches += 1
        told.errors.append({"source": source, "message": f"{done.n_errors} errors, such as {done.errors[:3]}"})
        return graph
    told.committed_batches += 1
    told.total_nodes += done.applied["nodes"]
    told.total_edges += done.applied["edges"]
    return PropertyGraph(_cut(done.graph.nodes), _cut(done.graph.edges))


def _cut(df: DataFrame) -> DataFrame:
    from .lineage import cut

    return cut(df)


def build_cached(spark: SparkSession, key: str, root: str, load: Callable[[], DataFrame], executors: list[Executor], **options) -> tuple[PropertyGraph, Summary | None]:
    """The graph of a commit (key: repo__commit) under ``root``: read if it was built before, else built from load()'s files and saved."""
    at = f"{root.rstrip('/')}/{key}"
    if path_exists(spark, f"{at}/current"):
        return load_snapshot(spark, at), None
    graph, told = build(spark, load(), executors, **options)
    save_snapshot(spark, graph, at, 1)
    return load_snapshot(spark, at), told


def build_all(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], root: str, executors: list[Executor], **options) -> dict[str, str]:
    """Builds each commit's graph that isn't there yet: key -> built, kept or the error's text. Its work is spread over executors by Spark, so commits go one after another."""
    out = {}
    for key, load in sorted(sources.items()):
        try:
            out[key] = "kept" if build_cached(spark, key, root, load, executors, **options)[1] is None else "built"
        except Exception as e:  # noqa: BLE001
            out[key] = str(e)
    return out
