"""Cross-entropy difference: how much more a target model expects a document than a background model.

Both are bigram models over one vocabulary, that of the tokenizer, with the same interpolation:
p(b | a) = w c(a b) / c(a) + (1 - w) (c(b) + s) / (N + s V), where w = c(a) / (c(a) + K). The target
counts come from the documents labelled good, the background counts from all other documents. A
document's loss is the mean over its tokens, the first one's context being the end-of-text token;
its score is the target loss less the background loss, so low scores are like the target. A target
document's own counts are taken off the target counts before it is scored, and likewise for the
background, so no document is judged by a model that has read it.

Counts cover all documents. Texts are dealt in chunks of at most CHUNK tokens, whose distinct
bigrams are summed by bigram, and the sums go back to the chunks that hold them; so no task or
machine has to hold the whole model, and bigrams may be as many as they like. The sums of bigrams
that very many chunks hold, FREQUENT of them at most, are broadcast instead; only the others are
joined, of which none is in many chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Stored
from .textkernel import released
from .tokens import Encoder

CHUNK, VOCABULARY, START = 1 << 20, 50_257, 50_256
SMOOTH, PULL = 0.1, 5.0
#: Most bigrams (20 bytes each) whose sums every worker gets.
FREQUENT = 1 << 20


def bigrams(ids: np.ndarray) -> np.ndarray:
    """Codes of the bigrams that end at each token (context * VOCABULARY + token), as uint32."""
    before = np.concatenate(([START], ids[:-1])) if len(ids) else ids
    return (before.astype(np.uint64) * np.uint64(VOCABULARY) + ids.astype(np.uint64)).astype(np.uint32)


def _tokenised(encoder: tuple, size: int):
    def run(batches):
        pid = TaskContext.get().partitionId()
        encode = Encoder.shared(*encoder).ids
        chunk, used, rows = 0, 0, []

        def batch_of(rows):
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["chunk", "doc_id", "target", "ids"])

        for batch in batches:
            for doc, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py())
                if len(ids) and int(ids.max()) >= VOCABULARY:
                    raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {VOCABULARY}")
                rows.append(((pid << 24) + chunk, doc, target, ids.astype("<u2").tobytes()))
                used += len(ids) + 1
                if used >= size:
                    yield batch_of(rows)
                    chunk, used, rows = chunk + 1, 0, []
        if rows:
            yield batch_of(rows)

    return run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    at = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, "<u2")), at


def _codes(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), np.uint32)
    for a, b in zip(at[:-1], at[1:]):
        out[a:b] = bigrams(ids[a:b])
    return out


def _counted(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    ids, at = _ids(table.column("ids"))
    target = np.repeat(table.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
    codes, where = np.unique(_codes(ids, at), return_inverse=True)
    t = np.bincount(where, weights=target, minlength=len(codes)).astype(np.int64)
    all_ = np.bincount(where, minlength=len(codes)).astype(np.int64)
    chunk = np.full(len(codes), table.column("chunk")[0].as_py(), np.int64)
    return pa.table({"chunk": chunk, "code": codes.astype(np.int64), "t": t, "b": all_ - t})


class Unigrams:
    """Counts of the vocabulary's tokens, and as contexts, in both models."""

    def __init__(self, tokens: np.ndarray, contexts: np.ndarray):
        self.tokens, self.contexts, self.all = tokens, contexts, tokens.sum(axis=1)


def losses(ids: np.ndarray, pair: np.ndarray, uni: Unigrams, target: bool) -> tuple[float, float]:
    """Mean losses under both models. pair: (2, tokens) counts of the bigrams ending at each token."""
    if not len(ids):
        return 0.0, 0.0
    before = np.concatenate(([START], ids[:-1]))
    own = 0 if target else 1
    out = []
    for m in (0, 1):
        c, left, one, total = pair[m].astype(float), uni.contexts[m][before].astype(float), uni.tokens[m][ids].astype(float), float(uni.all[m])
        if m == own:  # take this document off its own model
            _, where, times = np.unique(bigrams(ids), return_inverse=True, return_counts=True)
            c = c - times[where]
            _, where, times = np.unique(before, return_inverse=True, return_counts=True)
            left = left - times[where]
            _, where, times = np.unique(ids, return_inverse=True, return_counts=True)
            one, total = one - times[where], total - len(ids)
        w = left / (left + PULL)
        p = w * c / np.maximum(left, 1) + (1 - w) * (one + SMOOTH) / (total + SMOOTH * VOCABULARY)
        out.append(float(-np.log(p).mean()))
    return out[0], out[1]


def frequent_from(sums: DataFrame, most: int) -> float:
    """A number of chunks that at most ``most`` bigrams reach, the least of a ladder of four steps for each doubling. sums: n, the chunks of a bigram."""
    step = F.floor(4 * F.log2("n")).cast("int")
    ladder = sorted(((r.step, r.c) for r in sums.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()), reverse=True)  # some hundred rows at most
    least, total = None, 0
    for k, c in ladder:
        if total + c > most or k < 4:
            break
        least, total = k, total + c
    return 2 ** (least / 4) if least is not None else float("inf")


def _found(codes: np.ndarray, known: np.ndarray, counts: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Fills out[:, rows] with the counts of codes[rows] that are known (sorted); the rows that aren't."""
    if not len(known) or not len(rows):
        return rows
    spot = np.searchsorted(known, codes[rows])
    spot[spot == len(known)] = 0
    hit = known[spot] == codes[rows]
    out[:, rows[hit]] = counts[:, spot[hit]]
    return rows[~hit]


def _rare(frequent):
    def run(batches):
        for batch in batches:
            known = frequent.value[0]
            code = batch.column(1).to_numpy().astype(np.uint32)
            spot = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            yield batch.filter(pa.array(known[spot] != code)) if len(known) else batch

    return run


def _scored(uni, frequent):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        ids, at = _ids(docs.column("ids")) if docs.num_rows else (np.zeros(0, "<u2"), np.zeros(1, np.int64))
        order = np.argsort(sums.column("code").to_numpy(), kind="stable")
        rare = sums.column("code").to_numpy()[order].astype(np.uint32), np.stack([sums.column(c).to_numpy()[order] for c in ("st", "sb")])
        codes = _codes(ids, at)
        pair = np.zeros((2, len(codes)), np.int64)
        left = _found(codes, *frequent.value, pair, np.arange(len(codes)))
        if len(_found(codes, *rare, pair, left)):
            raise ValueError("a bigram without a count")
        target = docs.column("target").to_pylist()
        got = [losses(ids[a:b].astype(np.int64), pair[:, a:b], uni.value, x) for a, b, x in zip(at[:-1], at[1:], target)]
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(np.diff(at)), "target": docs.column("target"), "loss_target": pa.array([x for x, _ in got], pa.float64()), "loss_background": pa.array([y for _, y in got], pa.float64())})

    return run


def score(spark: SparkSession, docs: DataFrame, targets: DataFrame, encoder: tuple = (), chunk: int = CHUNK, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_tokens, target, loss_target, loss_background, score.

    docs: doc_id, text; targets: doc_id of the target documents, repeats and nulls allowed; other
    columns are ignored. A null or empty text has no tokens: losses and score are 0. A row of null
    doc_id is no target. Repeated rows count, and come back, once each. Without targets, the target
    model is uniform. An empty table gives no rows. ``chunk`` and ``frequent`` bound what a task and a
    broadcast hold and change no result.
    """
    kept = Stored(spark)
    ids = kept.put("ds_target", targets.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()).withColumn("target", F.lit(True))
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    told = kept.put("ds_tokens", marked.mapInArrow(released(_tokenised(encoder, chunk), Encoder.forget), "chunk long, doc_id long, target boolean, ids binary"), compression="zstd")
    counted = kept.put("ds_count", told.groupBy("chunk").applyInArrow(_counted, "chunk long, code long, t long, b long"))
    sums = kept.put("ds_sum", counted.groupBy("code").agg(F.sum("t").alias("st"), F.sum("b").alias("sb"), F.count("*").alias("n")))
    # Two rows for each id of the vocabulary at most.
    one = {}
    for name, col in (("tokens", F.pmod("code", F.lit(VOCABULARY))), ("contexts", F.floor(F.col("code") / VOCABULARY))):
        one[name] = np.zeros((2, VOCABULARY), np.int64)
        for r in sums.groupBy(col.cast("int").alias("id")).agg(F.sum("st").alias("t"), F.sum("sb").alias("b")).collect():
            one[name][:, r.id] = r.t, r.b
    uni = spark.sparkContext.broadcast(Unigrams(one["tokens"], one["contexts"]))
    often = sums.where(F.col("n") >= frequent_from(sums, frequent)).select("code", "st", "sb").toArrow().sort_by("code")
    known = spark.sparkContext.broadcast((often.column("code").to_numpy().astype(np.uint32), np.stack([often.column(c).to_numpy() for c in ("st", "sb")])))
    back = counted.select("chunk", "code").mapInArrow(_rare(known), "chunk long, code long").join(sums, "code").select("chunk", "code", "st", "sb")
    out = told.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scored(uni, known), "doc_id long, n_tokens long, target boolean, loss_target double, loss_background double")
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
