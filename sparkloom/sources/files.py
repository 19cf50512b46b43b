"""Readers and writers: graph documents, JSON lines, progress logs, file trees, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import GraphError, PropertyGraph

INSTANCE = """instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string, hints_text string, created_at string,
version string, FAIL_TO_PASS string, PASS_TO_PASS string, environment_setup_commit string, text_inputs string, touched_nodes array<string>"""
RETRIEVAL = "instance_id string, hits array<struct<docid: string, score: double>>"
RERANK = "instance_id string, model string, ranked_files array<string>, failed boolean, n_files int, n_comparisons int"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _text(json_value: Column) -> Column:
    """A JSON value as comparisons see it: booleans as True and False, strings without quotes."""
    return F.when(json_value == "true", "True").when(json_value == "false", "False").when(json_value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json_value, F.lit("}")), "$.v")).otherwise(json_value)


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph document {nodes, edges, allValues}, or with the keys nodes_data, edges_data, all_values_data.

    Values may be a map from id to properties or a list of objects with an id. Nulls are left out. A
    document is one row until its arrays are exploded, so it must fit in a task; larger graphs are
    kept as tables (operators/write.py).
    """
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        if raw.where("v is not null").isEmpty():
            raise GraphError("INVALID_JSON", path)
    except AnalysisException as e:
        raise GraphError("GRAPH_FILE_NOT_FOUND", path) from e
    get = lambda key, kind: F.try_variant_get("v", key, kind)
    nodes = raw.select(F.posexplode(F.coalesce(get("$.nodes", "array<string>"), get("$.nodes_data", "array<string>"), F.array().cast("array<string>"))).alias("ord", "j"))
    edges = raw.select(F.posexplode(F.coalesce(get("$.edges", "array<string>"), get("$.edges_data", "array<string>"), F.array().cast("array<string>"))).alias("ord", "j"))
    as_map = F.coalesce(get("$.allValues", "map<string,string>"), get("$.all_values_data", "map<string,string>"))
    as_list = F.coalesce(get("$.allValues", "array<string>"), get("$.all_values_data", "array<string>"))
    values = raw.select(F.explode(as_map).alias("id", "own")).unionByName(raw.select(F.explode(as_list).alias("own")).select(F.get_json_object("own", "$.id").alias("id"), "own"))
    # A variant keeps each value's JSON form, which tells "1" from 1 and true from "true".
    pairs = values.select("id", F.explode(F.try_variant_get(F.parse_json("own"), "$", "map<string,variant>")).alias("k", "val")).select("id", "k", F.to_json("val").alias("j"))
    props = pairs.where("k <> 'id' and j <> 'null'").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", _text(F.col("j"))))).alias("props"))
    field = lambda k: F.get_json_object("j", f"$.{k}").alias(k)
    empty = F.create_map().cast("map<string,string>")

    def typed(df: DataFrame) -> DataFrame:
        out = df.join(props, "id", "left").withColumn("props", F.coalesce("props", empty)).withColumn("ord", F.col("ord").cast("long"))
        return out.withColumn("meta_type", F.coalesce(F.nullif(F.col("props")["origin_type"], F.lit("")), F.nullif(F.col("props")["meta_type"], F.lit(""))))

    n = typed(nodes.select(field("id"), field("label"), "ord")).select("id", "label", "meta_type", "props", "ord")
    e = typed(edges.select(field("id"), field("label"), field("source"), field("target"), "ord")).select("id", "label", "source", "target", "props", "ord")
    return PropertyGraph(n, e)


_LOADED: dict[tuple, PropertyGraph] = {}


def load_graph(spark: SparkSession, name: str, base: str = ".") -> PropertyGraph:
    """The graph base/<name>.json, else base/graph_store/<name>.json, cached until clear_graphs.

    Refusals: GRAPH_FILE_NOT_FOUND, INVALID_JSON, and READ_ERROR for whatever else keeps it from being read.
    """
    at = next((p for p in (f"{base}/{name}.json", f"{base}/graph_store/{name}.json") if path_exists(spark, p)), None)
    if at is None:
        raise GraphError("GRAPH_FILE_NOT_FOUND", name)
    key = (spark.sparkContext.applicationId, at)
    if key not in _LOADED:
        try:
            _LOADED[key] = read_graph(spark, at).cache()
        except GraphError:
            raise
        except Exception as e:
            raise GraphError("READ_ERROR", at) from e
    return _LOADED[key]


def clear_graphs(name: str | None = None) -> None:
    """Forgets one loaded graph, or all."""
    for key in [k for k in _LOADED if name is None or k[1].endswith(f"/{name}.json")]:
        _LOADED.pop(key).unpersist()


def write_graph(graph: PropertyGraph, path: str, style: str = "short") -> None:
    """The graph as JSON lines of elements in three folders, named in either spelling; each element is a row."""
    names = {"short": ("nodes", "edges", "allValues"), "long": ("nodes_data", "edges_data", "all_values_data")}[style]
    graph.nodes.select(F.to_json(F.struct("id", "label")).alias("value")).write.mode("overwrite").text(f"{path}/{names[0]}")
    graph.edges.select(F.to_json(F.struct("id", "label", "source", "target")).alias("value")).write.mode("overwrite").text(f"{path}/{names[1]}")
    graph.elements().where(F.size("props") > 0).select(F.to_json(F.struct("id", "props")).alias("value")).write.mode("overwrite").text(f"{path}/{names[2]}")


def write_graph_document(graph: PropertyGraph, path: str, style: str = "short") -> None:
    """The graph as one JSON document that read_graph reads back. It is put together in one row, as it is read, so it must fit in a task."""
    names = {"short": ("nodes", "edges", "allValues"), "long": ("nodes_data", "edges_data", "all_values_data")}[style]
    part = lambda df, *c: df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", F.to_json(F.struct(*c)).alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("v"))
    held = graph.elements().where(F.size("props") > 0).select(F.concat(F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(":"), F.to_json("props")).alias("j"))
    values = held.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("}")).alias("v"))
    n, e = part(graph.nodes, "id", "label").withColumnRenamed("v", "n"), part(graph.edges, "id", "label", "source", "target").withColumnRenamed("v", "e")
    text = F.concat(F.lit(f'{{"{names[0]}":'), "n", F.lit(f',"{names[1]}":'), "e", F.lit(f',"{names[2]}":'), "v", F.lit("}"))
    n.join(e).join(values).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)  # joins of one row each


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped. Adds file and line_no, a line's place in its file."""
    from pyspark.sql.types import StructType

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))
    names = StructType.fromDDL(schema).names
    parsed = rows.where(F.trim("value") != "").where(F.try_parse_json("value").isNotNull()).withColumn("r", F.from_json("value", schema))
    return parsed.select(*[F.col("r")[n].alias(n) for n in names], "file", "line_no")


def skip_first(rows: DataFrame, n: int, order: str = "line_no", defaults: dict | None = None) -> DataFrame:
    """Rows behind the first n, and nulls replaced by defaults: the first n are found as a top n, so nothing is sorted as a whole."""
    out = rows
    if n:
        last = rows.orderBy(order).limit(n).agg(F.max(order).alias("_last"))
        out = rows.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")
    return out.fillna(defaults) if defaults else out


FOUND = "instance_id string, found_files array<string>"


def found_files(rows: DataFrame) -> DataFrame:
    """instance, pos, item of located files (instance_id, found_files), README files left out."""
    kept = F.filter(F.coalesce("found_files", F.array().cast("array<string>")), lambda p: ~T.is_readme(p))
    return rows.select(F.col("instance_id").alias("instance"), F.posexplode(kept).alias("pos", "item"))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """instance, path, contents of root/<instance>/documents.jsonl; an instance without a folder has no rows."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "instance string, path string, contents string")
    rows = read_lines(spark, f"{root.rstrip('/')}/*/documents.jsonl", "id string, contents string")
    return rows.select(F.element_at(F.split("file", "/"), -2).alias("instance"), F.col("id").alias("path"), F.coalesce("contents", F.lit("")).alias("contents"))


def prompt_texts(spark: SparkSession, path: str) -> DataFrame:
    """instance, text of a prompts table: JSON lines, or Parquet files of a dataset's splits; the last of several wins."""
    if path.endswith((".jsonl", ".json")):
        rows = read_lines(spark, path, "instance_id string, text string")
    else:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(path).withColumn("line_no", F.monotonically_increasing_id())
    last = rows.groupBy(F.col("instance_id").alias("instance")).agg(F.max_by(F.coalesce("text", F.lit("")), "line_no").alias("text"))
    return last


def finished(progress: DataFrame) -> DataFrame:
    """Ids of instances with non-empty text_inputs: what a resumed run skips."""
    return progress.where(F.coalesce("text_inputs", F.lit("")) != "").select("instance_id").distinct()


def retrieved(rows: DataFrame) -> DataFrame:
    """instance, pos, item, score of retrieval rows, best first, README files left out."""
    hits = rows.select(F.col("instance_id").alias("instance"), F.posexplode("hits").alias("k", "h")).where(~T.is_readme(F.col("h.docid")))
    pos = F.row_number().over(W.partitionBy("instance").orderBy(F.desc("h.score"), "k"))
    return hits.select("instance", pos.alias("pos"), F.col("h.docid").alias("item"), F.col("h.score").alias("score"))


def gold(rows: DataFrame) -> DataFrame:
    """instance, pos, item: files of the gold patches; instances without any are left out."""
    return rows.select(F.col("instance_id").alias("instance"), F.posexplode(T.patched_files(F.col("patch"))).alias("pos", "item"))


def marked(rows: DataFrame, column: str = "text_inputs", dialect: str = "anywhere") -> DataFrame:
    """instance, pos, item: files that a prompt shows."""
    return rows.select(F.col("instance_id").alias("instance"), F.posexplode(T.marked_files(F.col(column), dialect)).alias("pos", "item"))


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """path (below root), content of a folder's files; bytes that aren't UTF-8 become replacement signs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "").alias("path"), _decoded().alias("content"), F.sha1(F.concat(F.lit("blob ").cast("binary"), F.length("content").cast("string").cast("binary"), F.lit(b"\0"), F.col("content"))).alias("blob"))


def _decoded() -> Column:
    """Bytes as text without failing on bad ones."""
    return F.expr("coalesce(try_validate_utf8(cast(content as string)), make_valid_utf8(cast(content as string)))")


def readmes(tree: DataFrame) -> DataFrame:
    """Root files whose name begins with readme, in any case."""
    return tree.where(~F.col("path").contains("/") & F.lower("path").startswith("readme")).orderBy("path")


def write_progress(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def to_dataset(rows: DataFrame) -> DataFrame:
    """Dataset columns of progress rows: the patch in tags, the text stripped with two line feeds behind it."""
    names = [c.strip().split(" ")[0] for c in INSTANCE.replace("\n", " ").split(", ")][:12]
    body = F.concat(F.regexp_replace("text_inputs", r"^\s+|\s+$", ""), F.lit("\n\n"))
    return rows.select(*[F.concat(F.lit("<patch>\n"), F.col(n), F.lit("\n</patch>")).alias(n) if n == "patch" else F.col(n) for n in names], body.alias("text"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A report's rows as a Markdown table, all of them, fetched a partition at a time."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.orderBy(*order).toLocalIterator():
        lines.append("| " + " | ".join("-" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |")
    return "\n".join(lines) + "\n"


def output_path(base: str, split: str, model: str, variant: str | None = None) -> str:
    """A result's folder, distinct for each split, model and variant."""
    import re

    clean = lambda x: re.sub(r"[^A-Za-z0-9._-]+", "_", x)
    return "/".join([base.rstrip("/"), f"split={clean(split)}", f"model={clean(model)}", *([f"variant={clean(variant)}"] if variant else [])])
