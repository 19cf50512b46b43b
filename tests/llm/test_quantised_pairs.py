import numpy as np
import pytest

from sparkloom.llm.quantised_pairs import cosines, links, near_vectors, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"


def test_bounds_hold():
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 64)) * np.exp(r.normal(size=(300, 1)) * 5)
    v[:20] = 0
    v[np.arange(20), np.arange(20)] = 1e-30
    q, s, e = quantise(v)
    near = (q.astype(np.float64) @ q.T) * np.outer(s, s)
    for i in range(300):
        exact = cosines(np.broadcast_to(v[i], v.shape) / np.abs(v[i]).max(), v / np.abs(v).max(axis=1, keepdims=True))
        assert (np.abs(near[i] - exact) <= e[i] * (1 + e) + e * (1 + e[i]) + e[i] * e + 1e-11).all()


def brute(rows, threshold=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if v and label is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[k] = np.array(v, np.float32).astype(np.float64)
    n, root = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = list(good)
    for x, a in enumerate(ks):
        for b in ks[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and cosines(good[a][None], good[b][None])[0] >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                if p != q:
                    root[q] = p
    low = {}
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0]) if rows[k][0] is not None else None
    return sorted((str(rows[k][0]), n[k], str(low[find(k)])) for k in range(len(rows)))


def test_same_as_brute_force(spark):
    r = np.random.default_rng(1)
    rows = []
    for c in range(25):
        center = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            v = (center + r.normal(size=16) * r.choice([0, 0.05, 0.1, 0.2])).astype(np.float32)
            rows.append((len(rows), v.tolist(), int(c % 3)))
    rows += [(len(rows) + k, v, label) for k, (v, label) in enumerate([(None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), ([1.0] * 16, None), ([1.0] * 16, None), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1.0] * 16, 1)])]
    rows.append((0, rows[0][1], rows[0][2]))
    rows.append((None, rows[0][1], rows[0][2]))
    df = spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], SCHEMA)
    for block in (2048, 7):
        out = near_vectors(spark, df, block=block).collect()
        assert sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in out) == brute(rows)
        assert all(x.kept == (x.vec_id is None or x.vec_id == x.component_id) for x in out)


def test_vec_ids_with_several_vectors(spark):
    r = np.random.default_rng(3)
    a, b, c = (r.normal(size=16).astype(np.float32).tolist() for _ in range(3))
    near = [x * 1.001 + 0.001 for x in b]
    rows = [(1, a, 0), (1, b, 0), (1, b, 1), (2, a, 0), (3, near, 0), (4, near, 1), (5, c, 0), (5, c, 0), (5, near, 2), (6, b, 2), (0, c, 1)]
    df = spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], SCHEMA)
    for block in (2048, 2):
        out = near_vectors(spark, df, block=block).collect()
        assert sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in out) == brute(rows)


def test_empty(spark):
    assert near_vectors(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_precision_is_rare():
    v = np.random.default_rng(2).normal(size=(400, 64))
    mask, full = links(v, v, 0.98)
    assert mask.sum() == 400 and full <= 800
