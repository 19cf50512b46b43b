"""Exact cosine k-NN, node texts and content-keyed embedding caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cache_key

#: Types that carry no text of their own worth embedding.
SKIPPED = ("Exception", "TypeAnnotation", "Dependency", "Directory")

#: Queries that are broadcast or stand in one block, and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 65_536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the non-zero rows of a column of arrays, and which rows those are."""
    m = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1)
    keep = np.isfinite(n) & (n > 0)
    return m[keep] / n[keep, None], keep


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of v for each row of q, ties by id; products are made for some rows of q at a time."""
    parts = [pd.DataFrame({"query_id": q_ids[:0], "id": ids[:0], "similarity": np.zeros(0)})]
    step = max(1, (1 << 22) // max(len(v), 1))
    for a in range(0, len(q) if len(v) else 0, step):
        for own, sims in zip(q_ids[a : a + step], q[a : a + step] @ v.T):
            near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k]) if len(sims) > k else np.arange(len(sims))
            top = near[np.lexsort((ids[near], -sims[near]))[:k]]
            parts.append(pd.DataFrame({"query_id": own, "id": ids[top], "similarity": sims[top]}))
    return pd.concat(parts)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, meta_type: str | None = None, decimals: int | None = 4, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest vectors by cosine, ties by id.

    vectors: id, embedding, and meta_type if filtered by; queries: query_id, embedding, a stated set
    of queries. Up to ``query_block`` queries (by count) are broadcast, and each batch of vectors gives
    its best k of a query. Beyond that, both sides are dealt to blocks, and each pair of blocks gives its
    best k. A null or zero vector is near nothing.
    """
    if meta_type is not None:
        vectors = vectors.where(F.col("meta_type") == meta_type)
    vectors = vectors.where("embedding is not null").select("id", "embedding")
    queries = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    kind, qkind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, id {kind}, similarity double"
    n = queries.limit(query_block + 1).count()
    if n <= query_block:
        rows = queries.toPandas()
        q, good = _unit(rows.e)
        known = vectors.sparkSession.sparkContext.broadcast((rows.query_id.to_numpy()[good], q))

        def near(batches):
            for pdf in batches:
                v, keep = _unit(pdf.embedding)
                yield _nearest(*known.value, pdf.id.to_numpy()[keep], v, k)

        found = vectors.mapInPandas(near, schema)
    else:
        nq, nv = -(-queries.count() // query_block), -(-vectors.count() // vector_block)
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(m, 1) - 1).cast("long")))
        left = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(max(nv, 1))).alias("vb"), every(nq).alias("qb"))
        right = queries.select("query_id", "e", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"), every(nv).alias("vb"))

        def pair(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            (v, keep), (q, good) = _unit(vs.embedding), _unit(qs.e)
            return _nearest(qs.query_id.to_numpy()[good], q, vs.id.to_numpy()[keep], v, k)

        found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(pair, schema)
    value = F.round("similarity", decimals) if decimals is not None else F.col("similarity")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("similarity", value)


def file_signals(sims: DataFrame) -> DataFrame:
    """instance, path, sim_max, sim_mean of the three best, both rounded to 4 places. sims: instance, path, sim."""
    rank = F.row_number().over(W.partitionBy("instance", "path").orderBy(F.desc("sim")))
    top = sims.withColumn("k", rank).where("k <= 3")
    return top.groupBy("instance", "path").agg(F.round(F.max("sim"), 4).alias("sim_max"), F.round(F.avg("sim"), 4).alias("sim_mean"))


def compose(meta_type: Column, props: Column) -> Column:
    """A node's text for embedding: its type and name, where it lies, and what it says, by type."""
    get = lambda k: F.when(props[k] != "", props[k])
    head = F.concat_ws(" ", meta_type, F.coalesce(get("name"), get("relative_path"), get("imported_name"), get("module_path")))
    code = F.concat_ws("\n", head, get("docstring"), get("source_code"))
    return (
        F.when(meta_type.isin("Function", "Method", "Class"), code)
        .when(meta_type == "Variable", F.concat_ws("\n", head, get("value")))
        .when(meta_type == "Import", F.concat_ws("\n", head, get("module_path")))
        .when(meta_type == "Decorator", head)
        .when(meta_type == "File", head)
        .otherwise(head)
    )


def embeddable(nodes: DataFrame) -> DataFrame:
    """id, meta_type, text, key of the nodes that are embedded at all; key identifies the text's content."""
    rows = nodes.where(~F.col("meta_type").isin(*SKIPPED)).select("id", "meta_type", compose(F.col("meta_type"), F.col("props")).alias("text"))
    return rows.withColumn("key", cache_key(F.col("meta_type"), F.col("text")))


def cache_split(items: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Items (key) with their cached vectors of the right length, and the distinct keys (with a text) that are missing."""
    usable = cache.where(F.size("vector") == dim).dropDuplicates(["key"])
    hits = items.join(usable.select("key", "vector"), "key")
    misses = items.join(usable.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    return hits, misses


def hash_vector(text: str, dim: int) -> list[float]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of unit length."""
    out = np.zeros(dim)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32).tolist()


def embed(items: DataFrame, dim: int, provider: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
    """key, vector of items (key, text), by a provider called with up to ``batch`` texts at once."""
    call = provider or (lambda texts: [hash_vector(t, dim) for t in texts])

    def run(batches):
        for pdf in batches:
            vectors = []
            for a in range(0, len(pdf), batch):
                vectors += call(pdf.text.iloc[a : a + batch].tolist())
            yield pd.DataFrame({"key": pdf.key, "vector": vectors})

    return items.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def build_index(nodes: DataFrame, cache: DataFrame, dim: int, provider=None) -> tuple[DataFrame, DataFrame]:
    """(index, cache): id, meta_type, vector of every embeddable node, and the cache with the new vectors. Equal texts are embedded once."""
    items = embeddable(nodes)
    hits, misses = cache_split(items, cache, dim)
    fresh = embed(misses, dim, provider)
    index = hits.select("id", "meta_type", "vector").unionByName(items.join(fresh, "key").select("id", "meta_type", "vector"))
    return index, cache.where(F.size("vector") == dim).select("key", "vector").unionByName(fresh)
