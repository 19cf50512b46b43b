import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import domain_score as ds
from sparkloom.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, target string, chunk int"


def brute(rows, targets):
    enc = Encoder()
    ids = [[*enc.ids(t).tolist()] for _, t, *_ in rows]
    mine = [i is not None and i in targets for i, *_ in rows]
    big, ctx, one, n = [[Counter() for _ in range(2)] for _ in range(3)] + [[0, 0]]
    for x, t in zip(ids, mine):
        m = 0 if t else 1
        before = [ds.START, *x[:-1]]
        big[m].update(zip(before, x))
        ctx[m].update(before[: len(x)])
        one[m].update(x)
        n[m] += len(x)
    out = []
    for (i, *_), x, t in zip(rows, ids, mine):
        before, loss = [ds.START, *x[:-1]], []
        for m in (0, 1):
            own = (m == 0) == t
            b0, c0, o0 = (Counter(zip(before, x)), Counter(before[: len(x)]), Counter(x)) if own else ({},) * 3
            total = 0.0
            for a, b in zip(before, x):
                left = ctx[m][a] - c0.get(a, 0) if own else ctx[m][a]
                w = left / (left + ds.PULL)
                c = big[m][a, b] - (b0[a, b] if own else 0)
                u = one[m][b] - (o0[b] if own else 0)
                p = w * c / max(left, 1) + (1 - w) * (u + ds.SMOOTH) / (n[m] - (len(x) if own else 0) + ds.SMOOTH * ds.VOCABULARY)
                total -= math.log(p)
            loss.append(total / len(x) if x else 0.0)
        out.append((i, len(x), t, *loss))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    r = random.Random(0)
    rows = []
    for i in range(80):
        words = ["law", "court", "appeal", "judge"] if i % 4 == 0 else ["cat", "dog", "apple", "judge", "é"]
        rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 30, 300]))), "x", 1))
    rows += [(80, None, "", 0), (81, "", "", 0), (None, "law court", "", 0), (3, rows[3][1], "", 0)]
    targets = spark.createDataFrame([(i,) for i in range(0, 40, 4)] + [(0,), (None,), (999,)], "doc_id long")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    out = ds.score(spark, df, targets).collect()
    key = lambda x: str((x.doc_id, x.n_tokens, x.score))
    for chunk, frequent in ((100, 0), (100, 7), (400, 10**6)):  # many chunks; no, some and all shared bigrams broadcast
        again = ds.score(spark, df, targets, chunk=chunk, frequent=frequent).collect()
        assert [tuple(x) for x in sorted(again, key=key)] == [tuple(x) for x in sorted(out, key=key)]
    got = sorted(((x.doc_id, x.n_tokens, x.target, x.loss_target, x.loss_background) for x in out), key=str)
    want = brute(rows, set(range(0, 40, 4)))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, want) for a, b in zip(x[3:], y[3:]))
    legal = [x.score for x in out if x.doc_id is not None and x.doc_id % 4 == 0 and x.n_tokens > 25]
    other = [x.score for x in out if x.doc_id is not None and x.doc_id % 4 and x.n_tokens > 25]
    assert max(legal) < min(other)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert ds.score(spark, spark.createDataFrame([], SCHEMA), none).count() == 0
    assert ds.score(spark, spark.createDataFrame([(1, "a b", "", 1)], SCHEMA), none).first().target is False


def test_frequent_bigrams_are_bounded(spark):
    sums = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9] * 5 + [100] * 3)], "code long, n long")
    for most, want in ((0, 0), (2, 0), (3, 3), (7, 3), (8, 8), (27, 8), (28, 28), (1000, 28)):
        assert sums.where(F.col("n") >= ds.frequent_from(sums, most)).count() == want
