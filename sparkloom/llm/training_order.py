"""Token sequences in training order: a keyed Feistel permutation gives every sequence a global slot.

Texts become one stream of ids in each input partition, every document followed by ``end_id``, cut
into sequences of ``length``; the stream's last sequence is filled up with ``end_id`` and says how
many of its ids are real. Sequences are numbered through all partitions; the number's slot is its
image under a Feistel network over the next even power of two, walked along its cycle until it
falls below the number of sequences. Range partitions of slots are sorted and written, some waves of them, as raw shards
whose records all have the same stride, so that slot s lies in shard s // shard_rows at
(s % shard_rows) * stride: a reader goes on from any slot without an index.

A record is a little-endian uint16 count, ``length`` little-endian uint16 ids, and two line feeds.
"""

from __future__ import annotations

import re
import zlib
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, make_folder, new_path
from .textkernel import U, mix
from .tokens import Encoder

LENGTH, END_ID, SHARD_ROWS, ROUNDS = 1024, 50256, 8192, 6
#: Shards are shuffled and written in so many waves at most, so that a part of the ids only is on disk thrice.
WAVES = 4
TRAILER = b"\n\n"


def stride(length: int = LENGTH) -> int:
    return 2 + 2 * length + len(TRAILER)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1, applied to x."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix((np.arange(ROUNDS, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) ^ U(key & (1 << 64) - 1))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << U(half)) | right

    out = once(x.astype(U))
    while (over := np.flatnonzero(out >= U(n))).size:
        out[over] = once(out[over])
    return out.astype(np.int64)


def _sequences(length: int, end_id: int, encoder: tuple):
    def run(batches):
        pid = TaskContext.get().partitionId()
        encode = Encoder.shared(*encoder).ids
        held, first, n = [], (None, 0), 0  # ids that aren't given out yet, the document and place of the first, their number
        local = 0

        def rows(final: bool):
            nonlocal held, first, n, local
            flat = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint32)
            begins = np.cumsum([0, *(len(x) for x, _ in held)])
            count = len(flat) // length + (final and len(flat) % length > 0)
            out = []
            for k in range(count):
                own = flat[k * length : (k + 1) * length]
                at = int(np.searchsorted(begins, k * length, "right")) - 1
                start = k * length - int(begins[at]) + (first[1] if at == 0 else 0)
                body = np.full(length, end_id, "<u2")
                body[: len(own)] = own
                out.append((pid, local, held[at][1], start, len(own), body.tobytes()))
                local += 1
            rest = flat[count * length :]
            if len(rest):
                at = int(np.searchsorted(begins, count * length, "right")) - 1
                first = (held[at][1], count * length - int(begins[at]) + (first[1] if at == 0 else 0))
                keep = [(held[at][0][count * length - int(begins[at]) :], held[at][1]), *held[at + 1 :]]
            else:
                first, keep = (None, 0), []
            held, n = keep, len(rest)
            return out

        def batch_of(out):
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["pid", "local", "first_doc", "first_at", "n", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                if int(ids.max()) > 0xFFFF:
                    raise ValueError(f"id {int(ids.max())} doesn't fit in two bytes")
                held.append((ids, doc.as_py()))
                n += len(ids)
                if n >= 512 * length:
                    yield batch_of(rows(False))
        if n:
            yield batch_of(rows(True))

    return run


def materialise(spark: SparkSession, docs: DataFrame, key: int = 20_26, length: int = LENGTH, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, encoder: tuple = ()) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and a table (slot, first_doc, first_at, n, ids_crc32).

    docs: doc_id, text; other columns are ignored. A null or empty text is end_id alone. first_doc
    and first_at name the document and the place in it at which a sequence begins. end_id and all
    ids must be below 65536. An empty table gives no shard and no row.
    """
    kept = Stored(spark)
    schema = "pid long, local long, first_doc long, first_at long, n int, ids binary"
    cut = kept.put("to_sequence", docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sequences(length, end_id, encoder), schema), compression="zstd")
    # One row for each input partition.
    counts = sorted((r.pid, r.n) for r in cut.groupBy("pid").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    pids = np.array([p for p, _ in counts], np.int64)
    bases = np.cumsum([0, *(n for _, n in counts)])[:-1].astype(np.int64)
    path = new_path(spark, "to_shards")
    make_folder(spark, path)

    def slots(first: int, last: int, records: bool):
        """Rows of the slots in [first, last), with their records or with what tells of them."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                number = bases[np.searchsorted(pids, batch.column(0).to_numpy())] + batch.column(1).to_numpy()
                slot = permute(number, max(total, 1), key)
                rows = pa.array(np.flatnonzero((slot >= first) & (slot < last)))
                _, _, doc, at, n, ids = (c.take(rows) for c in batch.columns)
                slot, raw = pa.array(slot).take(rows), ids.to_pylist()
                if records:
                    record = pa.array([int(k).to_bytes(2, "little") + x for k, x in zip(n.to_pylist(), raw)], pa.binary())
                    yield pa.RecordBatch.from_arrays([slot, record], names=["slot", "record"])
                else:
                    crc = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                    yield pa.RecordBatch.from_arrays([slot, doc, at, n, crc], names=["slot", "first_doc", "first_at", "n", "ids_crc32"])

        return run

    told = kept.put("to_told", cut.mapInArrow(slots(0, total, False), "slot long, first_doc long, first_at long, n int, ids_crc32 long"))
    shards = -(-total // shard_rows)
    each = max(1, -(-shards // WAVES))
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")  # a wave's shuffle files go once its shards are written
    try:
        for first in range(0, shards, each):
            now = min(each, shards - first)
            rows = cut.mapInArrow(slots(first * shard_rows, (first + now) * shard_rows, True), "slot long, record binary")
            dealt = rows.repartitionById(now, (F.floor(F.col("slot") / shard_rows) - first).cast("int")).sortWithinPartitions("slot")
            dealt.select(F.col("record").cast("string").alias("value")).write.option("lineSep", TRAILER.decode()).text(f"{path}/from-{first:09d}")
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    kept.drop("to_sequence")
    return path, told


def _shard_of(path: str) -> int:
    where = PurePosixPath(path)
    return int(where.parent.name.removeprefix("from-")) + int(re.match(r"part-(\d+)", where.name)[1])


def shard_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a materialised folder and their shards, by the names alone. Raises FileNotFoundError if there is no such folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    names = [str(x.getPath()) for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "from-*/part-*")) or []]
    return sorted(((n, _shard_of(n)) for n in names), key=lambda x: x[1])


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, from_slot: int = 0) -> DataFrame:
    """Sequences of the shards from ``from_slot`` on: slot, shard, position, n, ids (binary), ids_crc32.

    Shards that end before ``from_slot`` are left out by their names and not opened. An empty folder
    gives no rows, a missing one raises.
    """
    size = stride(length)

    def records(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = _shard_of(name)
                raw = content.as_buffer()
                rows = len(raw) // size
                if rows * size != len(raw):
                    raise ValueError(f"{name}: {len(raw)} bytes are no whole number of records")
                begin = max(0, from_slot - shard * shard_rows)
                for a in range(begin, rows, 1024):
                    table = np.frombuffer(raw, np.uint8)[a * size : min(rows, a + 1024) * size].reshape(-1, size)
                    position = np.arange(a, a + len(table), dtype=np.int64)
                    n = table[:, :2].copy().view("<u2").reshape(-1).astype(np.int32)
                    ids = [x.tobytes() for x in table[:, 2 : 2 + 2 * length]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(position + shard * shard_rows), pa.array(np.full(len(table), shard, np.int64)), pa.array(position), pa.array(n), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                        names=["slot", "shard", "position", "n", "ids", "ids_crc32"],
                    )

    schema = "slot long, shard long, position long, n int, ids binary, ids_crc32 long"
    files = [f for f, shard in shard_files(spark, path) if (shard + 1) * shard_rows > from_slot]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(records, schema)


def written_and_read(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Materialises docs and reads the shards back: a row for each sequence, ``verified`` if both agree."""
    path, told = materialise(spark, docs, **options)
    back = read_shards(spark, path).select("slot", "shard", "position", F.col("n").alias("n_ids"), "ids_crc32")
    told = told.select("slot", "first_doc", "first_at", F.col("n").alias("told_n"), F.col("ids_crc32").alias("told_crc"))
    joined = told.join(back, "slot", "full_outer")
    same = F.coalesce((F.col("told_n") == F.col("n_ids")) & (F.col("told_crc") == F.col("ids_crc32")), F.lit(False))
    return joined.select("slot", "shard", "position", "first_doc", "first_at", "n_ids", "ids_crc32", same.alias("verified"))
