import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import toxicity as tx

SCHEMA = "doc_id long, text string, p_toxic double, places int"


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        junk, toxic = r.random() < 0.2, r.random() < 0.15
        words = [f"w{r.randrange(3000)}x" for _ in range(r.choice([40, 200]))]
        if junk:
            words = [w + " zzz" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["Nasty,", "awful!", "gemeinheit" + "en" * r.randrange(3)])
        rows.append((i, " ".join(words), 1.0, 2))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_features_do_not_depend_on_batches():
    texts = ["Idiot, idiot", None, "", "réêou ab", "x" * 70000]
    whole, at = tx.features(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = tx.features(pa.array([t], pa.string()))
        assert (whole[at[i] : at[i + 1]] == alone).all()
    assert at[1] == 2  # a word of five letters, and its prefix of five


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in tx.classify(spark, df, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")).collect()}
    held = [(got[i], j) for i, j in enumerate(labels) if i >= 900]
    assert np.mean([x.is_toxic == bool(j[2]) for x, j in held]) > 0.98
    assert np.mean([x.is_junk == (j[1] == 0) for x, j in held]) > 0.98
    assert np.mean([x.is_toxic for x, j in held if not j[2]]) < 0.01


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600)
    at = np.arange(601)
    places = np.where(y == 1, 5, 9)  # the first category is plain to see, the second equals it
    chain, oof = tx.fit_chain(places, at, np.stack([y, y], axis=1))
    assert chain.models[1].earlier[0] > 0 and ((oof[:, 1] > 0.5) == y).all()


def test_nulls_repeats_and_no_labels(spark):
    rows, labels = corpus(60, 2)
    rows += [(None, rows[0][1], None, None), (0, rows[0][1], None, None), (99, None, None, None)]
    ls = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = tx.classify(spark, spark.createDataFrame(rows, SCHEMA), ls).collect()
    assert len(out) == 63 and len({x.p_toxic for x in out if x.doc_id in (0, None)}) == 1
    none = tx.classify(spark, spark.createDataFrame(rows, SCHEMA), ls.limit(0)).collect()
    assert len(none) == 63 and not any(x.is_toxic or x.is_junk for x in none)
    assert tx.classify(spark, spark.createDataFrame([], SCHEMA), ls).count() == 0
