"""Schema checks of graphs: violations as rows (level, error_type, element_id, detail)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph

#: Edge labels every schema knows, and the meta level's vocabulary (fixed values).
BUILT_IN_EDGES = ("HAS_SOURCE", "HAS_TARGET", "HAS_PROPERTY")
META_CONCEPTS = ("NodeType", "EdgeType", "PropertyType", "HAS_SOURCE", "HAS_TARGET", "HAS_PROPERTY")
DATA_TYPES = ("string", "integer", "date", "url", "boolean", "float")


def _rows(df: DataFrame, level: str, error: str | Column, element: str | Column, detail: Column) -> DataFrame:
    kind = F.lit(error) if isinstance(error, str) else error
    return df.select(F.lit(level).alias("level"), kind.alias("error_type"), (F.col(element) if isinstance(element, str) else element).alias("element_id"), detail.cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def node_types(graph: PropertyGraph, types: DataFrame) -> DataFrame:
    """Nodes whose type isn't in types (column meta_type)."""
    return _rows(graph.nodes.join(types, "meta_type", "left_anti"), "data", "INVALID_NODE_TYPE", "id", F.col("meta_type"))


def edge_types(graph: PropertyGraph, labels: DataFrame) -> DataFrame:
    """Edges whose label is neither in labels (column label) nor built in."""
    return _rows(graph.edges.where(~F.col("label").isin(*BUILT_IN_EDGES)).join(labels, "label", "left_anti"), "data", "INVALID_EDGE_TYPE", "id", F.col("label"))


def typed_edges(graph: PropertyGraph) -> DataFrame:
    n = graph.nodes.select("id", "meta_type")
    s, t = n.select(F.col("id").alias("source"), F.col("meta_type").alias("source_type")), n.select(F.col("id").alias("target"), F.col("meta_type").alias("target_type"))
    return graph.edges.join(s, "source", "left").join(t, "target", "left")


def signatures(graph: PropertyGraph, allowed: DataFrame) -> DataFrame:
    """Edges whose end types match none of their label's signatures (label, source_type, target_type); labels without any are skipped."""
    known = typed_edges(graph).join(allowed.select("label").distinct(), "label", "left_semi")
    bad = known.join(allowed, ["label", "source_type", "target_type"], "left_anti")
    return _rows(bad, "data", "INVALID_EDGE_SIGNATURE", "id", F.concat_ws("-", "source_type", "label", "target_type"))


def keep_valid_edges(graph: PropertyGraph, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) edges at build time: an unknown label or an end without a type keeps the edge."""
    typed = typed_edges(graph)
    doubtful = typed.where("source_type is not null and target_type is not null").join(allowed.select("label").distinct(), "label", "left_semi")
    dropped = doubtful.join(allowed, ["label", "source_type", "target_type"], "left_anti")
    return graph.edges.join(dropped.select("id"), "id", "left_anti"), dropped


def dangling(graph: PropertyGraph) -> DataFrame:
    ids = graph.nodes.select(F.col("id").alias("end"))
    ends = graph.edges.select("id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("end")), F.struct(F.lit("target").alias("side"), F.col("target").alias("end")))).alias("x")).select("id", "x.side", "x.end")
    return _rows(ends.join(ids, "end", "left_anti"), "data", "REFERENTIAL_INTEGRITY", "id", F.concat_ws(" ", "side", "end"))


def stray_properties(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Property owners (column id) that are no element."""
    there = graph.nodes.select("id").unionByName(graph.edges.select("id"))
    return _rows(ids.join(there, "id", "left_anti"), "data", "ELEMENT_NOT_FOUND", "id", F.lit("properties without an element"))


def mandatory(graph: PropertyGraph, rules: DataFrame) -> DataFrame:
    """Nodes that lack a mandatory property. rules: meta_type, key, mandatory as text ("true" counts)."""
    need = rules.where(F.lower("mandatory") == "true").select("meta_type", "key")
    rows = graph.nodes.join(need, "meta_type").where(F.col("props")[F.col("key")].isNull())
    return _rows(rows, "data", "MISSING_REQUIRED_PROPERTY", "id", F.col("key"))


def value_type_ok(kind: Column, json_type: Column) -> Column:
    """Whether a JSON value's type fits a declared one. Booleans pass as integers and floats; urls are unchecked."""
    return (
        F.when(kind.isin("string", "date"), json_type == "STRING")
        .when(kind == "integer", json_type.isin("BIGINT", "BOOLEAN"))
        .when(kind == "float", json_type.isin("BIGINT", "DOUBLE", "BOOLEAN") | json_type.startswith("DECIMAL"))
        .when(kind == "boolean", json_type == "BOOLEAN")
        .otherwise(True)
    )


def property_types(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values (id, meta_type, key, json) whose JSON type isn't the declared one. rules: meta_type, key, data_type."""
    rows = values.join(rules, ["meta_type", "key"]).withColumn("found", F.schema_of_variant(F.try_parse_json("json")))
    return _rows(rows.where(~F.coalesce(value_type_ok(F.col("data_type"), F.col("found")), F.lit(False))), "data", "INVALID_PROPERTY_TYPE", "id", F.concat_ws(" ", "key", "found"))


def patterns(graph: PropertyGraph, rules: DataFrame) -> DataFrame:
    """Property values that their pattern doesn't match from the start on. rules: meta_type, key, pattern."""
    rows = graph.nodes.join(rules, "meta_type").withColumn("value", F.col("props")[F.col("key")])
    bad = rows.where("value is not null").where(~F.rlike(F.col("value"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))))
    return _rows(bad, "data", "PATTERN_VALIDATION_FAILED", "id", F.concat_ws("=", "key", "value"))


def cardinality(graph: PropertyGraph, rules: DataFrame) -> DataFrame:
    """Nodes with too few or too many outgoing edges of a label. rules: meta_type, label, min_count, max_count (null: no limit)."""
    counts = graph.edges.groupBy(F.col("source").alias("id"), "label").agg(F.count("*").alias("n"))
    rows = graph.nodes.select("id", "meta_type").join(rules, "meta_type").join(counts, ["id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    error = F.when(F.col("n") < F.col("min_count"), "CARDINALITY_VIOLATION_MIN").when(F.col("n") > F.col("max_count"), "CARDINALITY_VIOLATION_MAX")
    return _rows(rows.withColumn("error", error).where("error is not null"), "data", F.col("error"), "id", F.concat_ws(" ", "label", "n"))


def paired_signatures(meta: PropertyGraph) -> DataFrame:
    """Edge types of a meta graph with unequal numbers of HAS_SOURCE and HAS_TARGET edges."""
    counts = meta.edges.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("label").startswith("HAS_SOURCE")).alias("s"), F.count_if(F.col("label").startswith("HAS_TARGET")).alias("t"))
    return _rows(counts.where("s <> t"), "meta", "MALFORMED_SIGNATURE", "id", F.concat_ws(" ", "s", "t"))


def read_signatures(meta: PropertyGraph) -> DataFrame:
    """label, source_type, target_type: the k-th HAS_SOURCE edge of an edge type pairs with its k-th HAS_TARGET edge."""
    from pyspark.sql import Window as W

    names = meta.nodes.select(F.col("id").alias("target"), F.col("label").alias("name"))
    own = meta.nodes.select(F.col("id").alias("source"), F.col("label").alias("type"))
    rows = meta.edges.withColumn("side", F.when(F.col("label").startswith("HAS_SOURCE"), "s").when(F.col("label").startswith("HAS_TARGET"), "t")).where("side is not null").join(names, "target").join(own, "source")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("type", "side").orderBy("ord")))
    s, t = rows.where("side = 's'").select("type", "k", F.col("name").alias("source_type")), rows.where("side = 't'").select("type", "k", F.col("name").alias("target_type"))
    return s.join(t, ["type", "k"]).select(F.col("type").alias("label"), "source_type", "target_type")


def compiles(pattern: Column) -> Column:
    """Whether it is a regular expression; null for null."""

    @F.pandas_udf("boolean")
    def good(patterns: pd.Series) -> pd.Series:
        def one(p):
            try:
                return p if p is None else bool(re.compile(p))
            except re.error:
                return False

        return pd.Series([one(p) for p in patterns], dtype=object)

    return good(pattern)


def meta_checks(meta: PropertyGraph) -> DataFrame:
    """Violations of a meta graph: types, end points, data types, patterns, counts and mandatory flags."""
    elements = meta.elements().withColumn("type", F.coalesce(F.nullif(F.col("props")["origin_type"], F.lit("")), F.nullif(F.col("props")["meta_type"], F.lit(""))))
    nodes, props = elements.where("kind = 'node'"), F.col("props")
    known = F.col("type").isin(*META_CONCEPTS)
    number = lambda k: F.expr(f"try_cast(props['{k}'] as bigint)")
    ends = dangling(meta).select(F.lit("meta").alias("level"), F.when(F.col("detail").startswith("source"), "MISSING_SOURCE").otherwise("MISSING_TARGET").alias("error_type"), "element_id", "detail")
    flag = F.lower(props["isMandatory"])
    return union(
        [
            _rows(nodes.where("type is null"), "meta", "UNKNOWN_TYPE", "id", F.lit("no type")),
            _rows(nodes.where("type is not null").where(~known), "meta", "INVALID_TYPE", "id", F.col("type")),
            ends,
            _rows(elements.where(props["dataType"].isNotNull() & ~props["dataType"].isin(*DATA_TYPES)), "meta", "INVALID_DATATYPE", "id", props["dataType"]),
            _rows(elements.where(props["minCount"].isNotNull() & F.coalesce(number("minCount") < 0, F.lit(True))), "meta", "INVALID_MIN_COUNT", "id", props["minCount"]),
            _rows(elements.where(props["maxCount"].isNotNull() & F.coalesce(number("maxCount") < 0, F.lit(True))), "meta", "INVALID_MAX_COUNT", "id", props["maxCount"]),
            _rows(elements.where(number("maxCount") < number("minCount")), "meta", "INVALID_CARDINALITY", "id", F.concat_ws(">", props["minCount"], props["maxCount"])),
            _rows(elements.where(props["isMandatory"].isNotNull() & ~flag.isin("true", "false")), "meta", "INVALID_MANDATORY", "id", props["isMandatory"]),
            _rows(nodes.where((F.col("type") == "PropertyType") & props["validationRegex"].isNotNull()).where(~compiles(props["validationRegex"])), "meta", "INVALID_REGEX", "id", props["validationRegex"]),
            _rows(paired_signatures(meta), "meta", "MALFORMED_SIGNATURE", "element_id", F.col("detail")),
        ]
    )


def property_warnings(meta: PropertyGraph) -> DataFrame:
    """HAS_PROPERTY constraints (property owners SOURCE-HAS_PROPERTY-KEY) whose source or key is no node: warnings, which fail nothing."""
    owners = meta.edges.where(F.size("props") > 0).where(F.contains("id", F.lit("HAS_PROPERTY")) | F.contains("id", F.lit("has_property"))).select("id", F.split("id", "-").alias("p")).where(F.size("p") >= 3)
    ends = owners.select("id", F.explode(F.array(F.struct(F.lit("node").alias("what"), F.col("p")[0].alias("name")), F.struct(F.lit("property").alias("what"), F.col("p")[2].alias("name")))).alias("x")).select("id", "x.*")
    return _rows(ends.join(meta.nodes.select(F.col("id").alias("name")), "name", "left_anti"), "meta", "UNKNOWN_REFERENCE", "id", F.concat_ws(" ", "what", "name"))


def id_signature(edge_id: Column) -> Column:
    """struct(source, relation, target) of an edge id of three parts, or of four with HAS_PROPERTY as the second, whose third is the target then; else null."""
    p = F.split(edge_id, "-")
    fits = (F.size(p) == 3) | ((F.size(p) == 4) & (F.get(p, F.lit(1)) == "HAS_PROPERTY"))
    return F.when(fits, F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("relation"), F.get(p, F.lit(2)).alias("target")))


def schema_text(meta: PropertyGraph) -> DataFrame:
    """line: a meta graph as text, a line a type: node types with their sorted properties, then the other nodes that are no property types."""
    kind = F.coalesce(F.col("meta_type"), F.lit(""))
    props = meta.edges.where("label = 'HAS_PROPERTY'").groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("p"))
    rows = meta.nodes.where(kind != "PropertyType").join(props, "id", "left")
    text = F.when(kind == "NodeType", F.concat(F.lit("node type "), "id", F.lit(": "), F.coalesce("p", F.lit("")))).otherwise(F.concat(F.lit("edge type "), "id"))
    return rows.orderBy(F.when(kind == "NodeType", 0).otherwise(1), "ord").select(text.alias("line"))


def cardinality_rules(meta: PropertyGraph) -> DataFrame:
    """meta_type, label, min_count, max_count: count bounds on the first edge of a meta graph from a node type to an edge type; most schemas have none."""
    n = meta.nodes.select("id", "meta_type", "label")
    e = meta.edges.join(n.where("meta_type = 'NodeType'").select(F.col("id").alias("source"), F.col("label").alias("type")), "source").join(n.where("meta_type = 'EdgeType'").select(F.col("id").alias("target"), F.col("label").alias("edge_type")), "target")
    bound = lambda k: F.expr(f"try_cast(props['{k}'] as int)").alias(k)
    first = e.groupBy(F.col("type").alias("meta_type"), F.col("edge_type").alias("label")).agg(F.min_by("props", "ord").alias("props"))
    return first.select("meta_type", "label", bound("minCount"), bound("maxCount")).toDF("meta_type", "label", "min_count", "max_count").where("min_count is not null or max_count is not null")


def first_error(violations: DataFrame) -> str:
    """The first violation as a line, '' if there is none."""
    row = violations.orderBy("level", "error_type", "element_id", "detail").first()
    return f"{row.error_type} ({row.level}): {row.element_id}: {row.detail}" if row else ""


def bad_patterns(spark, patterns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(element_id, pattern) of a schema's patterns that don't compile. A schema is a small list."""
    import re

    out = []
    for element, pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            out.append((element, pattern))
    return out


def data_checks(graph: PropertyGraph, types: DataFrame, allowed: DataFrame, required: DataFrame, regexes: DataFrame, counts: DataFrame) -> DataFrame:
    """All violations of a data graph."""
    return union(
        [node_types(graph, types), edge_types(graph, allowed.select("label").distinct()), signatures(graph, allowed), dangling(graph), mandatory(graph, required), patterns(graph, regexes), cardinality(graph, counts)]
    )


def satisfiable(meta: PropertyGraph) -> bool:
    """Whether a schema's constraints can hold together: distinct ids, bounds from 0 up, maximum not below minimum."""
    repeated = meta.nodes.groupBy("id").count().where("count > 1")
    wrong = meta_checks(meta).where(F.col("error_type").isin("INVALID_MIN_COUNT", "INVALID_MAX_COUNT", "INVALID_CARDINALITY"))
    return repeated.isEmpty() and wrong.isEmpty()


def smt_text(meta: PropertyGraph) -> DataFrame:
    """The same constraints as SMT-LIB lines (column line), one per count bound."""
    bounds = meta.elements().select("id", F.expr("try_cast(props['minCount'] as bigint)").alias("lo"), F.expr("try_cast(props['maxCount'] as bigint)").alias("hi")).where("lo is not null or hi is not null")
    lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(2**31 - 1))
    return bounds.select(F.format_string("(assert (and (>= %d 0) (>= %d %d))) ; %s", lo, hi, lo, F.col("id")).alias("line"))
