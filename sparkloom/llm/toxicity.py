"""Toxicity by a classifier chain of linear models over hashed features of whole texts.

Categories are predicted one after another; each model sees the word features and the earlier
categories' probabilities. In training, those are out-of-fold predictions, so that a later model
learns how far the earlier ones can be trusted on texts they haven't seen; copies of a text share a
fold. The models are logistic regressions fitted on at most SAMPLE labelled documents, chosen by a
hash of doc_id; everything else runs over all documents.

Features are a text's distinct words (runs of ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased) and the words' prefixes of PREFIXES bytes, hashed to 2**BITS places; prefixes stand in
for word stems, which carry the sense in inflecting languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import semi_filter, small_batches
from .textkernel import LOWER, U, mix, released, row_slices, text_bytes, word_hashes

#: Most labelled documents that a chain is fitted on.
SAMPLE = 8_000
BITS, PREFIXES, FOLDS, MIN_DOCS = 20, (5, 6, 7, 9), 5, 4
STEPS, L2, SCORE = 300, 0.3, 4.0
#: (category, label column, value that means yes), in the order of the chain.
CATEGORIES = [("junk", "quality", 0), ("toxic", "toxic", 1)]

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature places of each text, and offsets (one more than texts)."""
    raw, at = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    fresh, last = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    parts, docs = [word_hashes(raw, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts >= n
        parts.append(mix(word_hashes(raw, starts[long], starts[long] + n) + U(n)))
        docs.append(doc[long])
    code = (np.concatenate(docs).astype(U) << U(BITS)) | (np.concatenate(parts) >> U(64 - BITS))
    code = np.sort(code)
    if len(code):
        code = code[np.concatenate(([True], code[1:] != code[:-1]))]
    which = (code >> U(BITS)).astype(np.int64)
    return (code & U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(which, np.arange(len(at)))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """A logistic regression: weights of feature places, of earlier categories' log odds, and a bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, places: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        return sigmoid(sums(self.weights[places], at) + before @ self.earlier + self.bias)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def telling(places: np.ndarray, y: np.ndarray, lens: np.ndarray, size: int) -> np.ndarray:
    """Places held by MIN_DOCS documents or more whose yes share differs from the overall one by SCORE standard errors."""
    held = np.bincount(places, minlength=size)
    hits = np.bincount(places, weights=np.repeat(y, lens), minlength=size)
    rate = y.mean()
    return np.flatnonzero((held >= MIN_DOCS) & (np.abs(hits - held * rate) >= SCORE * np.sqrt(held * rate * (1 - rate))))


def fit(places: np.ndarray, at: np.ndarray, before: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Minimises the log loss plus an L2 penalty over the telling places by accelerated gradient steps.

    Each weight's step is bounded by 0.25 * sum of |its feature| * (sum of |all features|) over
    documents, which dominates the Hessian, so no step size needs tuning.
    """
    n = len(y)
    model = Linear(np.zeros(size), np.zeros(before.shape[1]), -10.0)
    if not n or y.min() == y.max():
        model.bias = -10.0 if not n or not y[0] else 10.0
        return model
    used = telling(places, y, np.diff(at), size)
    new = np.full(size, -1)
    new[used] = np.arange(len(used))
    good = new[places] >= 0
    doc = np.repeat(np.arange(n), np.diff(at))[good]
    own = new[places][good]
    m, e = len(used), before.shape[1]
    dense = np.hstack([before, np.ones((n, 1))])
    reach = np.bincount(doc, minlength=n) + np.abs(dense).sum(axis=1)
    bound = 0.25 * np.concatenate([np.bincount(own, weights=reach[doc], minlength=m), np.abs(dense).T @ reach])
    penalty = np.concatenate([np.full(m + e, L2), [0.0]])
    w = np.zeros(m + e + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    look, t = w, 1.0
    for _ in range(STEPS):
        miss = sigmoid(np.bincount(doc, weights=look[own], minlength=n) + dense @ look[m:]) - y
        grad = np.concatenate([np.bincount(own, weights=miss[doc], minlength=m), dense.T @ miss]) + penalty * look
        nxt = look - grad / (bound + penalty)
        again = 1.0 if grad @ (nxt - w) > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = nxt + (0.0 if again == 1.0 else (t - 1) / again) * (nxt - w)
        w, t = nxt, again
    model.weights[used] = w[:m]
    model.earlier, model.bias = w[m : m + e], float(w[-1])
    return model


def subset(places: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(at)[rows]
    new = np.concatenate(([0], np.cumsum(lens)))
    take = np.repeat(at[rows] - new[:-1], lens) + np.arange(new[-1])
    return places[take], new


@dataclass
class Chain:
    """The fitted models in order, and the cutoff of each category's probability."""

    models: list[Linear]
    cutoffs: list[float]

    def predict(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.predict(places, at, odds(out[:, :k]))
        return out


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff with the highest F1 on out-of-fold predictions, in the middle of its gap; 0.5 if there is no yes."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ends = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0)
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


def folds(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A fold for each text by its least feature hash: copies share one, near copies do so with a chance equal to their similarity."""
    out = np.zeros(len(at) - 1, np.int64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = (mix(np.minimum.reduceat(mix(places.astype(U)), at[full])) % U(FOLDS)).astype(np.int64)
    return out


def fit_chain(places: np.ndarray, at: np.ndarray, labels: np.ndarray, fold: np.ndarray | None = None) -> tuple[Chain, np.ndarray]:
    """labels: (documents, categories), 0 or 1; fold: by document, in turn if not given. Returns the chain and the out-of-fold probabilities."""
    size = 1 << BITS
    n, m = labels.shape
    fold = np.arange(n) % FOLDS if fold is None else fold
    oof = np.zeros((n, m))
    models, cutoffs = [], []
    for k in range(m):
        y, before = labels[:, k].astype(float), odds(oof[:, :k])
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test) and len(train):
                model = fit(*subset(places, at, train), before[train], y[train], size)
                oof[test, k] = model.predict(*subset(places, at, test), before[test])
        model = fit(places, at, before, y, size)
        models.append(Linear(model.weights.astype(np.float32), model.earlier, model.bias))
        cutoffs.append(best_cutoff(oof[:, k], labels[:, k]))
    return Chain(models, cutoffs), oof


def _feature_rows(batches):
    for batch in batches:
        for a, b in row_slices(batch.column(1)):
            places, at = features(batch.column(1).slice(a, b - a))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "places"])


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fits a chain. The features of at most ``sample`` labelled doc_ids come to the driver, one text for each (of several, the least)."""
    yes = [(F.max((F.col(c) == v).cast("int"))).alias(name) for name, c, v in categories]
    names = [name for name, _, _ in categories]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*yes).dropna()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = chosen.collect()
    if not rows:
        return Chain([Linear(np.zeros(1 << BITS, np.float32), np.zeros(k), -10.0) for k in range(len(names))], [0.5] * len(names))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")
    texts = semi_filter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", limit=max(sample, 1))
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(released(_feature_rows), "doc_id long, places array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("places").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    by = {r.doc_id: [r[n] for n in names] for r in rows}
    y = np.array([by[i] for i in got.column("doc_id").to_pylist()], np.int64).reshape(-1, len(names))
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    places = lists.flatten().to_numpy().astype(np.int64)
    chain, _ = fit_chain(places, at, y, folds(places, at))
    return chain


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, p_<category> and is_<category> for each, in the chain's order.

    docs: doc_id, text; labels: doc_id and the categories' label columns; other columns are ignored.
    A document with several labels is a yes if any row says so; rows with a null label are left out
    unless another row has one. A null text has no features. Repeated rows and null doc_ids are
    classified like any other. Without labels, nothing is in any category. An empty table gives no
    rows.
    """
    names = [name for name, _, _ in categories]
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, categories, sample))

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                p = model.value.predict(*features(batch.column(1).slice(a, b - a)))
                cols = [batch.column(0).slice(a, b - a)]
                for k in range(len(names)):
                    cols += [pa.array(p[:, k]), pa.array(p[:, k] >= model.value.cutoffs[k])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[x + n for n in names for x in ("p_", "is_")]])

    schema = "doc_id long, " + ", ".join(f"p_{n} double, is_{n} boolean" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), schema)
