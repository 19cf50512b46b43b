"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where needed.

Vectors are compared when their labels (and lengths) are equal. A unit vector u is kept as int8
codes q and a scale s, with e = |u - s q| computed after rounding and rounded up. Then
|u.v - s_u s_v (q_u . q_v)| <= e_u (1 + e_v) + e_v (1 + e_u) + e_u e_v, since |s q| <= 1 + e. Code
products are exact in float32 (64 * 127**2 < 2**24; longer vectors use float64). Pairs whose bound
lies wholly below the threshold go, pairs wholly above it are links, and the rest are computed from
the original components in double precision.

Equal vectors of a label form a class of which one is compared; classes have numbers of their own,
since a vec_id may occur with several vectors. A label's classes are dealt by hash to blocks
of about BLOCK, and each two blocks meet in a task of their own, so no label is gathered anywhere.
A tile gives each vector's number of links and edges that connect what it links (at most one for
each vector), never its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, components

BLOCK, SLICE = 2048, 512
#: What float64 rounding may add to a cosine of up to some thousand components.
ROUNDING = 1e-11


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error bounds of unit vectors of the rows of v (finite, not zero)."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1) / 127
    codes = np.clip(np.rint(u / scale[:, None]), -127, 127).astype(np.int8)
    rest = u - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double-precision cosines of the rows of a with those of b."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def links(v: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """A boolean matrix of cosine(v, w) >= threshold, and how many pairs were computed in full precision."""
    (qv, sv, ev), (qw, sw, ew) = quantise(v), quantise(w)
    kind = np.float32 if v.shape[1] * 127**2 < 1 << 24 else np.float64
    qw = qw.astype(kind).T
    out, full = np.empty((len(v), len(w)), bool), 0
    for a in range(0, len(v), SLICE):
        b = a + SLICE
        near = (qv[a:b].astype(kind) @ qw).astype(np.float64) * sv[a:b, None] * sw[None, :]
        bound = ev[a:b, None] * (1 + ew) + ew * (1 + ev[a:b, None]) + ev[a:b, None] * ew + ROUNDING
        sure = near - bound >= threshold
        i, j = np.nonzero((near + bound >= threshold) & ~sure)
        for c in range(0, len(i), 1 << 16):
            x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            sure[x, y] = cosines(v[a + x], w[y]) >= threshold
        out[a:b] = sure
        full += len(i)
    return out, full


def spanning(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id) that connect what a link matrix connects. left and right: the ids of rows and columns."""
    rows, cols = mask.any(axis=1), mask.any(axis=0)
    if not rows.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, a, b = mask[np.ix_(rows, cols)], left[rows], right[cols]
    top = np.iinfo(np.int64).max
    x, y = a.copy(), b.copy()
    while True:
        low_y = np.full(len(y), top)
        for k in range(0, len(m), SLICE):
            np.minimum(low_y, np.where(m[k : k + SLICE], x[k : k + SLICE, None], top).min(axis=0), out=low_y)
        new_y = np.minimum(y, low_y)
        new_x = x.copy()
        for k in range(0, len(m), SLICE):
            new_x[k : k + SLICE] = np.minimum(x[k : k + SLICE], np.where(m[k : k + SLICE], new_y[None, :], top).min(axis=1))
        if (new_x == x).all() and (new_y == y).all():
            break
        x, y = new_x, new_y
    ids, to = np.concatenate([a, b]), np.concatenate([x, y])
    # A label is the least id that reaches the vertex inside the tile, so these edges connect as the links do.
    return ids[ids != to], to[ids != to]


def _rows(batches):
    for batch in batches:
        ids, label = batch.column(0), batch.column(2)
        keys, raw, dims = [], [], []
        for v, known in zip(batch.column(1).to_pylist(), label.is_valid().to_pylist()):
            own = None
            if v and known and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    own = (x + 0.0).astype("<f8").tobytes()  # a negative zero is a zero
            raw.append(own)
            dims.append(len(own) // 8 if own else 0)
            keys.append(None if own is None else hashlib.blake2b(own, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "key", "raw"])


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, size, first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "n", "first"))
        order = np.argsort(cls, kind="stable")
        v = np.frombuffer(b"".join(table.column("raw").to_pylist()), "<f8").reshape(len(cls), -1)[order]
        cls, size, first = cls[order], size[order], first[order]
        # Not told by the blocks alone: of a tile of two, one may be empty.
        if table.column("i")[0] == table.column("j")[0]:
            mask, _ = links(v, v, threshold)
            np.fill_diagonal(mask, False)
            mask |= mask.T
            left = right = np.arange(len(cls))
            counts = mask @ size.astype(np.float64)
            ids = cls
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            mask, _ = links(v[left], v[right], threshold)
            ids = np.concatenate([cls[left], cls[right]])
            counts = np.concatenate([mask @ size[right].astype(np.float64), size[left].astype(np.float64) @ mask])
        a, b = spanning(mask, cls[left], cls[right])
        some = counts > 0
        n = counts[some].astype(np.int64)
        return pa.table({"a": pa.array(np.concatenate([ids[some], a])), "b": pa.array(np.concatenate([ids[some], b])), "links": pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))})

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors: vec_id long, embedding array<float or double>, label; other columns are ignored. A
    vector that is null, empty, zero, or holds a null or non-finite component, or has no label,
    links with nothing: n_links 0, its own component, kept. Vectors of different lengths never
    link. Repeated rows are vectors of their own and link with each other; a row of null vec_id
    takes no part (component_id null, kept). An empty table gives no rows.
    """
    kept = Stored(spark)
    read = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    schema = f"vec_id long, label {read.schema['label'].dataType.simpleString()}, dim int, key binary, raw binary"
    rows = kept.put("qp_rows", read.mapInArrow(_rows, schema))
    usable = rows.where("vec_id is not null and key is not null")
    classes = kept.put("qp_class", usable.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    sizes = kept.put("qp_size", classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("blocks")))
    held = usable.select(F.col("vec_id").alias("rep"), "label", "dim", "key", "raw").join(classes, ["label", "dim", "key", "rep"]).dropDuplicates(["cls"])
    dealt = kept.put("qp_dealt", held.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).drop("key", "rep"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), "cls", "n", "raw")
    found = kept.put("qp_found", tiles.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold), "a long, b long, links long"))
    comp = components(spark, found.where("a <> b").select("a", "b"), kept)
    counts = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # A component's name is the least vec_id of its classes. Both sides of the join by component are stored, so a large one is split.
    member = kept.put("qp_member", comp.withColumnRenamed("id", "cls").join(classes.select("cls", "rep"), "cls"))
    least = kept.put("qp_least", member.groupBy("comp").agg(F.min("rep").alias("least")))
    final = classes.join(counts, "cls", "left").join(member.select("cls", "comp").join(least, "comp").drop("comp"), "cls", "left")
    final = kept.put("qp_final", final.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")))
    kept.drop("qp_size", "qp_dealt", "qp_found", "qp_class", "qp_member", "qp_least", "components")
    joined = rows.drop("raw").where("vec_id is not null and key is not null").join(final, ["label", "dim", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.drop("raw").where("vec_id is null or key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
