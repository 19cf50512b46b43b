"""The typed property graph and its read operators: lookup, search, neighbours, paths, nearest typed node.

Elements keep their position in the source as ``ord``, which stands for list order wherever an
operator's ties need one. Property values are held as strings, as comparisons see them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

NODE_COLUMNS = "id string, label string, meta_type string, props map<string,string>, ord long"
EDGE_COLUMNS = "id string, label string, source string, target string, props map<string,string>, ord long"

#: Levels of a walk with so many ids in their paths at most are broadcast, so that the edges aren't shuffled for them.
BROADCAST_IDS = 100_000


class GraphError(ValueError):
    """An operator's refusal; ``code`` names it, as in NODE_NOT_FOUND."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class PropertyGraph:
    """nodes: NODE_COLUMNS. edges: EDGE_COLUMNS; parallel edges, self-loops and missing end nodes are legal."""

    nodes: DataFrame
    edges: DataFrame

    def elements(self) -> DataFrame:
        """All nodes, then all edges, with ``kind``; an edge whose id is a node's gives way to the node."""
        nodes = self.nodes.select(F.lit("node").alias("kind"), "id", "label", "meta_type", "props", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "ord")
        edges = self.edges.select(F.lit("edge").alias("kind"), "id", "label", F.col("props")["meta_type"].alias("meta_type"), "props", "source", "target", "ord")
        return nodes.unionByName(edges)

    def cache(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.cache(), self.edges.cache())

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()


def from_rows(spark: SparkSession, nodes: list, edges: list, values: dict | None = None) -> PropertyGraph:
    """A graph of (id, label) and (id, label, source, target) rows and {id: {key: value}}."""
    values = values or {}
    held = lambda i: {k: str(v) for k, v in values.get(i, {}).items() if v is not None}
    n = [(i, label, held(i).get("origin_type") or held(i).get("meta_type"), held(i), k) for k, (i, label) in enumerate(nodes)]
    e = [(i, label, s, t, held(i), k) for k, (i, label, s, t) in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(n, NODE_COLUMNS), spark.createDataFrame(e, EDGE_COLUMNS))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a shell glob: ``*``, ``?`` and ``[...]`` are live, all else is literal."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", k + (glob[k : k + 1] in "!^]") + (glob[k : k + 2] in ("!]", "^]")))
            if end < 0:
                out.append(r"\[")
                continue
            body = glob[k:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]")
            k = end + 1
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if c.isascii() else c)
    return "(?s)^" + "".join(out) + "$"


def property_filter(props: Column, wanted: dict) -> Column:
    """All keys must be there and equal as strings, or match where the wanted value holds a ``*``."""
    out = F.lit(True)
    for key, value in wanted.items():
        value = str(value)
        here = props[key]
        out = out & F.coalesce(here.rlike(glob_pattern(value)) if "*" in value else here == value, F.lit(False))
    return out


def search_elements(
    graph: PropertyGraph, kind: str = "any", meta_type: str | None = None, label_contains: str | None = None, properties_filter: dict | None = None, limit: int | None = None, offset: int = 0, sort_by: str = "id", sort_order: str = "asc", include: tuple = ()
) -> DataFrame:
    """Elements that pass all filters, sorted stably, cut to a page; ``total`` counts them before the cut.

    Sorting by a property needs ``include`` to hold "properties"; otherwise every key is null and
    the id decides. Nulls come first. In both orders, equal keys keep their source order.
    """
    rows = graph.elements() if kind == "any" else graph.elements().where(F.col("kind") == kind)
    if meta_type:
        rows = rows.where(F.col("meta_type") == meta_type)
    if label_contains:
        rows = rows.where(F.contains(F.lower(F.coalesce("label", "id")), F.lower(F.lit(label_contains))))
    if properties_filter:
        rows = rows.where(property_filter(F.col("props"), properties_filter))
    own = {"id", "label", "kind", "source", "target"}
    key = F.col(sort_by) if sort_by in own else F.col("props")[sort_by] if "properties" in include else F.col("id")
    first = F.when(F.col("kind") == "node", 0).otherwise(1)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(key.desc_nulls_last() if sort_order == "desc" else key.asc_nulls_first(), first, "ord")
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    columns = ["kind", "id", "label", "source", "target", *(["props"] if "properties" in include else [])]
    return page.join(F.broadcast(total)).select(*columns, "total")


def incident(graph: PropertyGraph, ids: DataFrame, direction: str = "both", edge_label: str | None = None) -> DataFrame:
    """Edges at each of ids (column ``center``): center, edge_id, edge_label, source, target, direction, neighbor, ord.

    A self-loop is at its node in both directions, so it comes twice; its neighbour is the node itself.
    """
    edges = graph.edges if edge_label is None else graph.edges.where(F.col("label") == edge_label)
    edges = edges.select(F.col("id").alias("edge_id"), F.col("label").alias("edge_label"), "source", "target", "ord")
    out = []
    if direction in ("out", "both"):
        out.append(ids.join(edges, F.col("center") == F.col("source")).withColumns({"direction": F.lit("out"), "neighbor": F.col("target")}))
    if direction in ("in", "both"):
        out.append(ids.join(edges, F.col("center") == F.col("target")).withColumns({"direction": F.lit("in"), "neighbor": F.col("source")}))
    if not out:
        raise GraphError("INVALID_DIRECTION", direction)
    return reduce(DataFrame.unionByName, out)


def get_neighbors(graph: PropertyGraph, ids: DataFrame, direction: str = "both", edge_label: str | None = None) -> DataFrame:
    """Distinct neighbours of each center: center, id, label, meta_type, n_edges. A missing node's label is its id."""
    found = incident(graph, ids, direction, edge_label).groupBy("center", "neighbor").agg(F.count_distinct("edge_id").alias("n_edges"))
    nodes = graph.nodes.select("id", "label", "meta_type")
    return found.join(nodes, found.neighbor == nodes.id, "left").select("center", F.col("neighbor").alias("id"), F.coalesce("label", "neighbor").alias("label"), "meta_type", "n_edges")


def get_element(graph: PropertyGraph, element_id: str, include: tuple = ()) -> DataFrame:
    """One row: kind, id, label, source, target, and as included props, edges (in source order), neighbors (by id).

    A node goes before an edge of the same id. ``edges`` and ``neighbors`` bring the properties along.
    """
    one = graph.elements().where(F.col("id") == element_id).orderBy(F.when(F.col("kind") == "node", 0).otherwise(1), "ord").limit(1)
    if one.isEmpty():
        raise GraphError("ELEMENT_NOT_FOUND", element_id)
    columns = ["kind", "id", "label", "source", "target"] + (["props"] if {"properties", "edges", "neighbors"} & set(include) else [])
    out = one.select(*columns)
    center = one.where("kind = 'node'").select(F.col("id").alias("center"))
    if "edges" in include:
        edges = incident(graph, center).dropDuplicates(["center", "edge_id"]).groupBy("center").agg(F.array_sort(F.collect_list(F.struct("ord", "edge_id", "edge_label", "source", "target"))).alias("edges"))
        out = out.join(edges.withColumnRenamed("center", "id"), "id", "left")
    if "neighbors" in include:
        near = get_neighbors(graph, center).groupBy("center").agg(F.array_sort(F.collect_list(F.struct("id", "label", "meta_type"))).alias("neighbors"))
        out = out.join(near.withColumnRenamed("center", "id"), "id", "left")
    return out


def normalise_pattern(pattern: list | None) -> list[dict]:
    out = []
    for step in pattern or []:
        if isinstance(step, str):
            step = {"edge_label": step}
        if not isinstance(step, dict):
            raise GraphError("INVALID_PATTERN", repr(step))
        out.append(step)
    return out


def traverse(graph: PropertyGraph, starts: DataFrame, max_depth: int = 3, pattern: list | None = None, limit_paths: int | None = None) -> DataFrame:
    """Simple paths of exactly max_depth edges from each start (column ``start``): start, node_ids, edge_ids.

    Edges may be walked both ways. Step k of the pattern limits the k-th edge's label and direction
    ("out" or "in" as seen from where the path stands); hops beyond the pattern are free, and steps
    beyond max_depth are ignored. limit_paths keeps, for each start, the first paths by edge ids;
    0 gives none, unless max_depth is 0.
    """
    steps = normalise_pattern(pattern)
    paths = starts.select("start", F.col("start").alias("at"), F.array("start").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"))
    for hop in range(max_depth):
        want = steps[hop] if hop < len(steps) else {}
        edges = graph.edges if want.get("edge_label") is None else graph.edges.where(F.col("label") == want["edge_label"])
        ways = []
        if want.get("direction") in (None, "out"):
            ways.append(edges.select(F.col("source").alias("at"), F.col("target").alias("to"), F.col("id").alias("edge_id")))
        if want.get("direction") in (None, "in"):
            ways.append(edges.select(F.col("target").alias("at"), F.col("source").alias("to"), F.col("id").alias("edge_id")))
        step = reduce(DataFrame.unionByName, ways)
        paths = paths.join(step, "at").where(~F.array_contains("node_ids", F.col("to")))
        paths = paths.select("start", F.col("to").alias("at"), F.array_append("node_ids", F.col("to")).alias("node_ids"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
    paths = paths.select("start", "node_ids", "edge_ids")
    if limit_paths is not None:
        if not limit_paths and max_depth:
            return paths.limit(0)
        # The best few of each start, kept as a bounded array while aggregating.
        from pyspark.sql import Window as W

        rank = F.row_number().over(W.partitionBy("start").orderBy("edge_ids", "node_ids"))
        paths = paths.withColumn("rank", rank).where(F.col("rank") <= max(limit_paths, 1)).drop("rank")
    return paths


def find_connected(graph: PropertyGraph, starts: DataFrame, meta_type: str, edge_label: str | None = None, direction: str = "in", max_depth: int = 20) -> DataFrame:
    """For each start (column ``start``) the nearest node of a type: start, id, depth, path. No row if there is none.

    The start itself counts at depth 0. ``direction`` "in" walks edges from target to source. Of
    equally near nodes, the one with the lexicographically least path of ids wins, which is what a
    breadth-first walk over sorted neighbours meets first. The walk goes back from all nodes of the
    type together, level by level, and gives each node it meets first its least path; so a level has a
    row a node, however many starts lie behind it. It ends once all starts are met.
    """
    edges = graph.edges if edge_label is None else graph.edges.where(F.col("label") == edge_label)
    ways = []
    if direction in ("in", "both"):
        ways.append(edges.select(F.col("target").alias("at"), F.col("source").alias("to")))
    if direction in ("out", "both"):
        ways.append(edges.select(F.col("source").alias("at"), F.col("target").alias("to")))
    step = cut(reduce(DataFrame.unionByName, ways))  # read at every level
    starts = cut(starts.select(F.col("start").alias("at")).where("at is not null").distinct())
    level = cut(graph.nodes.where(F.col("meta_type") == meta_type).select(F.col("id").alias("at")).where("at is not null").distinct().select("at", F.array("at").alias("path")))
    levels, left = [], starts.count()
    for depth in range(max_depth + 1):
        n = level.count()
        level = F.broadcast(level) if n * (depth + 1) <= BROADCAST_IDS else level
        levels.append(level)
        left -= starts.join(level.select("at"), "at", "left_semi").count()
        if not left or depth == max_depth or not n:
            break
        behind = step.join(level.select(F.col("at").alias("to"), "path"), "to").select("at", "path")
        # Both ways, an edge joins nodes whose levels differ by one at most.
        for met in levels[-2:] if direction == "both" else levels:
            behind = behind.join(met.select("at"), "at", "left_anti")
        # Paths of a level are equally long, so the least of those behind begins the least one here.
        level = cut(behind.groupBy("at").agg(F.min("path").alias("path")).select("at", F.concat(F.array("at"), "path").alias("path")))
    found = starts.join(reduce(DataFrame.unionByName, levels), "at")
    return found.select(F.col("at").alias("start"), F.element_at("path", -1).alias("id"), (F.size("path") - 1).alias("depth"), "path")


def links_per_hop(graph: PropertyGraph, start: DataFrame, max_depth: int) -> DataFrame:
    """depth (from 1), edge_label, direction, n: edges met from the nodes first reached at each depth - 1, both ways."""
    front, seen, out = start.select(F.col("start").alias("center")).distinct(), None, []
    for depth in range(1, max_depth + 1):
        met = cut(incident(graph, front))
        out.append(met.groupBy("edge_label", "direction").agg(F.count("*").alias("n")).select(F.lit(depth).alias("depth"), "edge_label", "direction", "n"))
        seen = front if seen is None else seen.unionByName(front)
        front = cut(met.select(F.col("neighbor").alias("center")).distinct().join(seen, "center", "left_anti"))
    return reduce(DataFrame.unionByName, out)


def best_link(links: DataFrame) -> DataFrame:
    """The most frequent link of each depth; outgoing before incoming, then by label."""
    order = F.struct(-F.col("n"), F.when(F.col("direction") == "out", 0).otherwise(1), "edge_label")
    return links.groupBy("depth").agg(F.min_by(F.struct("edge_label", "direction", "n"), order).alias("x")).select("depth", "x.*")


def first_failing_step(graph: PropertyGraph, starts: DataFrame, pattern: list) -> int | None:
    """The first hop (from 1) of a pattern that no path takes, or None if all do."""
    for hop in range(1, len(pattern) + 1):
        if traverse(graph, starts, hop, pattern[:hop]).isEmpty():
            return hop
    return None


def traverse_hint(graph: PropertyGraph, start: DataFrame, pattern: list, max_depth: int | None = None) -> DataFrame:
    """depth, links array<struct<edge_label, direction, n>>, failing, message, edge_label, direction: why no path fits a pattern, a row a hop.

    failing marks the first step whose label, or label with direction, isn't met at its hop; message
    says so there, and on the first row that the steps don't fit in sequence if none fails.
    edge_label and direction are the suggested step: the asked label as it is met, else the best link.
    """
    steps = normalise_pattern(pattern)
    depth = max_depth or max(len(steps), 1)
    links = links_per_hop(graph, start, depth)
    order = F.struct((-F.col("n")).alias("k"), F.when(F.col("direction") == "out", 0).otherwise(1).alias("way"), "edge_label", "direction", "n")
    hops = links.groupBy("depth").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["edge_label"].alias("edge_label"), x["direction"].alias("direction"), x["n"].alias("n"))).alias("links"))
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(k + 1, s.get("edge_label"), s.get("direction")) for k, s in enumerate(steps)] or [(0, None, None)], "depth int, want string, way string")
    rows = hops.join(asked, "depth", "left")
    named = F.filter("links", lambda x: x["edge_label"] == F.col("want"))
    no_label = F.col("want").isNotNull() & (F.size(named) == 0)
    no_way = F.col("want").isNotNull() & F.col("way").isNotNull() & (F.size(named) > 0) & ~F.exists(named, lambda x: x["direction"] == F.col("way"))
    offered = F.array_join(F.transform("links", lambda x: F.concat(x["edge_label"], F.lit(" ("), x["direction"], F.lit(", "), x["n"].cast("string"), F.lit(")"))), ", ")
    text = F.when(no_label, F.concat(F.lit("step "), F.col("depth").cast("string"), F.lit(" asks for "), "want", F.lit(", its hop has only "), offered)).when(no_way, F.concat(F.lit("step "), F.col("depth").cast("string"), F.lit(" asks for "), "want", F.lit(" going "), "way", F.lit(", it only goes "), F.get(named, F.lit(0))["direction"]))
    pick = F.when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(F.get("links", F.lit(0)))
    rows = rows.select("depth", "links", text.alias("text"), pick.alias("pick"))
    first = rows.agg(F.min(F.when(F.col("text").isNotNull(), F.col("depth"))).alias("first"))
    failing = F.coalesce(F.col("depth") == F.col("first"), F.lit(False))
    message = F.when(failing, F.col("text")).when(F.col("first").isNull() & (F.col("depth") == 1), "each step is met at its hop, but not one after another")
    return rows.join(F.broadcast(first)).where(F.col("depth") <= max(len(steps), 1)).select("depth", "links", failing.alias("failing"), message.alias("message"), "pick.edge_label", "pick.direction")


def file_of(graph: PropertyGraph, rule: str = "nearest") -> DataFrame:
    """id, path: the file that contains each node, by CONTAINS edges upward; nodes in no file are left out.

    "nearest": the nearest File over all parents; its relative_path, else its label, else its id. "last":
    of several parents only the last edge's counts, and a File without a relative_path isn't one. A
    node's own File is itself.
    """
    path = F.nullif(F.col("props")["relative_path"], F.lit(""))
    files = graph.nodes.where("meta_type = 'File'").select("id", (F.coalesce(path, F.nullif("label", F.lit("")), "id") if rule == "nearest" else path).alias("path")).where("path is not null")
    edges = graph.edges.where("label = 'CONTAINS'")
    if rule == "last":
        edges = edges.groupBy("target").agg(F.max_by("source", "ord").alias("source")).select(F.lit("CONTAINS").alias("label"), "source", "target")
    marked = graph.nodes.select("id", F.lit("other").alias("meta_type")).join(files, "id", "left_anti").unionByName(files.select("id", F.lit("File").alias("meta_type")))
    found = find_connected(PropertyGraph(marked, edges), graph.nodes.select(F.col("id").alias("start")), "File", "CONTAINS")
    return found.select(F.col("start").alias("node"), "id").join(files, "id").select(F.col("node").alias("id"), "path")


def touched(events: DataFrame) -> DataFrame:
    """Accumulates touches (instance, seq, id, label, props): the latest non-empty label and value of each key win.

    Returns instance, id, first_seq, label, props; first_seq gives the order of first touches.
    """
    base = events.groupBy("instance", "id").agg(F.min("seq").alias("first_seq"), F.max_by(F.when(F.col("label") != "", F.col("label")), F.when(F.col("label") != "", F.col("seq"))).alias("label"))
    pairs = events.select("instance", "id", "seq", F.explode("props")).where("value is not null and value <> ''")
    latest = pairs.groupBy("instance", "id", "key").agg(F.max_by("value", "seq").alias("value"))
    props = latest.groupBy("instance", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    return base.join(props, ["instance", "id"], "left")


def rank_files(touches: DataFrame) -> DataFrame:
    """Files by how many touched nodes they hold. touches: instance, path, seq. Ties: the first touched comes first."""
    from pyspark.sql import Window as W

    freq = touches.groupBy("instance", "path").agg(F.count("*").alias("freq"), F.min("seq").alias("first_seq"))
    return freq.withColumn("rank", F.row_number().over(W.partitionBy("instance").orderBy(F.desc("freq"), "first_seq", "path")))
