"""Embedding caches and indexes on disk: shared by key, opened by fingerprint, complete when their stamp says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_slug
from ..sources.files import path_exists
from . import vectors as V

CACHE, MANIFEST = "key string, vector array<float>", "fingerprint string, model string, dim int, version long"


def fingerprint(*parts: Column) -> Column:
    """The parts joined by bars: what a cache's vectors depend on. A null part counts as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def _manifest(spark: SparkSession, path: str):
    if not path_exists(spark, f"{path}/manifest"):
        return None
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(F.desc("version")).limit(1).collect()
    return rows[0] if rows else None


def open_cache(spark: SparkSession, path: str, mark: str, model: str, dim: int) -> tuple[DataFrame, int]:
    """(cache, version): the cache's vectors if its fingerprint, model and length are the given ones, else an empty cache under a new version."""
    last = _manifest(spark, path)
    if last and (last.fingerprint, last.model, last.dim) == (mark, model, dim):
        at = f"{path}/v{last.version}"
        rows = spark.read.schema(CACHE).parquet(at) if path_exists(spark, at) else spark.createDataFrame([], CACHE)
        return rows.where(F.size("vector") == dim).dropDuplicates(["key"]), last.version
    version = last.version + 1 if last else 0
    spark.createDataFrame([(mark, model, dim, version)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return spark.createDataFrame([], CACHE), version


def add_to_cache(spark: SparkSession, path: str, version: int, rows: DataFrame) -> None:
    """Appends key, vector rows to a version of the cache; repeated keys do no harm."""
    rows.select("key", "vector").write.mode("append").parquet(f"{path}/v{version}")


def save_index(spark: SparkSession, index: DataFrame, path: str, mark: str) -> int:
    """Writes an index (id, key, vector) and then its stamp (fingerprint and count), without which it counts as broken off."""
    index.write.mode("overwrite").parquet(f"{path}/rows")
    n = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(mark, n)], "fingerprint string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/stamp")
    return n


def is_complete(spark: SparkSession, path: str, mark: str | None = None) -> bool:
    """Whether an index has as many rows as its stamp says, and the given fingerprint."""
    if not path_exists(spark, f"{path}/stamp") or not path_exists(spark, f"{path}/rows"):
        return False
    rows = spark.read.schema("fingerprint string, n long").json(f"{path}/stamp").collect()  # one row
    return len(rows) == 1 and mark in (None, rows[0].fingerprint) and spark.read.parquet(f"{path}/rows").count() == rows[0].n


def backfill(spark: SparkSession, paths: list[str], cache_path: str, mark: str, model: str, dim: int) -> dict:
    """Copies the vectors of complete indexes of the same fingerprint into the shared cache, keys that it lacks only: counts of indexes added and skipped, and of vectors."""
    cache, version = open_cache(spark, cache_path, mark, model, dim)
    good = [p for p in paths if is_complete(spark, p, mark)]
    before = cache.count()
    if good:
        rows = spark.read.parquet(*[f"{p}/rows" for p in good]).where(F.size("vector") == dim).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
        add_to_cache(spark, cache_path, version, rows)
    after = open_cache(spark, cache_path, mark, model, dim)[0].count()
    return {"added": len(good), "skipped": len(paths) - len(good), "vectors": after - before}


def precompute(spark: SparkSession, graphs: dict[str, DataFrame], out: str, cache_path: str, mark: str, model: str, dim: int, provider=None) -> dict:
    """Builds the index of each graph (key -> nodes) that has no complete one, by way of the shared cache: counts of built and skipped."""
    stats = {"built": 0, "skipped": 0}
    for key, nodes in sorted(graphs.items()):
        at = f"{out}/{key}"
        if is_complete(spark, at, mark):
            stats["skipped"] += 1
            continue
        cache, version = open_cache(spark, cache_path, mark, model, dim)
        items = V.embeddable(nodes)
        _, misses = V.cache_split(items, cache, dim)
        add_to_cache(spark, cache_path, version, V.embed(misses, dim, provider))
        hits, _ = V.cache_split(items, open_cache(spark, cache_path, mark, model, dim)[0], dim)
        save_index(spark, hits.select("id", "meta_type", "key", "vector"), at, mark)
        stats["built"] += 1
    return stats


def page(index: DataFrame, after: str | None, size: int) -> DataFrame:
    """The next ``size`` rows by id, behind the id ``after``: pages of an index without an offset that scans again."""
    rows = index if after is None else index.where(F.col("id") > after)
    return rows.orderBy("id").limit(size)


def head_start(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest, by similarity rounded to 4 places and then by nearness."""
    return V.knn(vectors, queries, k)


def cache_path(base: str, model: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), model_slug(model))
