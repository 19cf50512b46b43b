"""Packing documents into as few fixed-length sequences as possible, by linear grouping and best fit.

Documents longer than a sequence are cut into whole sequences, the first piece taking what is over.
The plan is made from the histogram of piece lengths alone, which has at most ``capacity`` entries:
pieces above ``small`` are sorted and cut into groups of equal cardinality, each rounded up to its
largest length; configurations of the few sizes left are chosen one after another, each the fullest
that holds the largest size still there, and used as often as the counts allow; then real lengths
replace the rounded ones, and small pieces go, longest first, where they leave the least room. A plan
takes a fraction of a second whatever the number of pieces, so one is made for each setting of
GROUPS and SMALL, from coarse to exact lengths, and the one with the fewest sequences is taken;
``Plan.bound`` is what no packing can go below.
Pieces get their places by rank among those of their length, so that no group is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored
from .textkernel import released
from .tokens import Encoder

CAPACITY = 1024
#: Numbers of groups, and shares of a sequence up to which a piece is small, that plans are made for.
GROUPS, SMALL = (128, 512, 4096), (8, 16, 32)


class Plan:
    """Places for the pieces of each length, by rank: runs of (length, first rank, first sequence, offset, pieces a sequence)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0], small: int | None = None):
        self.capacity, self.small = capacity, capacity // 8 if small is None else small
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.taken: dict[int, int] = defaultdict(int)
        self.sequences = 0
        #: The least number of sequences: by tokens, or by pieces that no other such piece fits beside.
        self.bound = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs of (first sequence, number)
        self.frees: list[int] = []
        self._large({n: c for n, c in counts.items() if n > self.small and c}, groups)
        for n in sorted((n for n, c in counts.items() if n <= self.small and c), reverse=True):
            self._best_fit(n, counts[n])

    def _put(self, n: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        self.runs.append((n, self.taken[n], sequence, offset, each))
        self.taken[n] += count

    def _room(self, free: int, sequence: int, number: int) -> None:
        if free and number:
            if not self.rooms[free]:
                insort(self.frees, free)
            self.rooms[free].append((sequence, number))

    def _large(self, counts: dict[int, int], groups: int) -> None:
        lengths = sorted(counts, reverse=True)
        share = -(-sum(counts.values()) // groups) if counts else 1
        sizes: list[int] = []  # rounded sizes, descending
        members: dict[int, list[list[int]]] = {}  # of a size: [length, number], longest first
        left = 0
        for n in lengths:
            count = counts[n]
            while count:
                if not left:
                    left = share
                    if not sizes or sizes[-1] != n:
                        sizes.append(n)
                        members[n] = []
                now = min(left, count)
                own = members[sizes[-1]]
                if own and own[-1][0] == n:
                    own[-1][1] += now
                else:
                    own.append([n, now])
                left, count = left - now, count - now
        there = {s: sum(c for _, c in members[s]) for s in sizes}
        sizes = [s for s in sizes if there[s]]
        while sizes:
            pattern = self._configuration(sizes, there)
            times = min(there[s] // m for s, m in pattern.items())
            self._substitute(pattern, times, members)
            for s, m in pattern.items():
                there[s] -= m * times
            sizes = [s for s in sizes if there[s]]

    def _configuration(self, sizes: list[int], there: dict[int, int]) -> dict[int, int]:
        """The fullest multiset that holds sizes[0]: subset sums as bits of an integer, one step for each size and use."""
        room = self.capacity - sizes[0]
        mask, bits = (1 << (room + 1)) - 1, 1
        steps = []
        for s in sizes:
            uses = min(room // s, there[s] - (s == sizes[0])) if s <= room else 0
            for _ in range(uses):
                steps.append((s, bits))
                bits |= (bits << s) & mask
        at, pattern = bits.bit_length() - 1, {sizes[0]: 1}
        for s, before in reversed(steps):
            if not (before >> at) & 1:
                pattern[s] = pattern.get(s, 0) + 1
                at -= s
        return pattern

    def _substitute(self, pattern: dict[int, int], times: int, members: dict[int, list[list[int]]]) -> None:
        """Gives the next real lengths of each group to the slots; sequences with equal lengths in all slots form a run."""
        slots: list[list[list[int]]] = []
        for s, m in pattern.items():
            for _ in range(m):
                own, need = [], times
                while need:
                    n, c = members[s][0]
                    now = min(c, need)
                    own.append([n, now])
                    need -= now
                    members[s][0][1] -= now
                    if not members[s][0][1]:
                        members[s].pop(0)
                slots.append(own)
        left = times
        while left:
            now = min(own[0][1] for own in slots)
            offset = 0
            for own in slots:
                self._put(own[0][0], now, self.sequences, offset)
                offset += own[0][0]
                own[0][1] -= now
                if not own[0][1]:
                    own.pop(0)
            self._room(self.capacity - offset, self.sequences, now)
            self.sequences += now
            left -= now

    def _best_fit(self, n: int, count: int) -> None:
        while count:
            k = bisect_left(self.frees, n)
            if k == len(self.frees):
                each = self.capacity // n
                number = -(-count // each)
                self._room(self.capacity, self.sequences, number)
                self.sequences += number
                continue
            free = self.frees[k]
            sequence, number = self.rooms[free].pop()
            if not self.rooms[free]:
                self.frees.pop(k)
            each = min(free // n, count)
            used = min(number, count // each)
            self._put(n, used * each, sequence, self.capacity - free, each)
            self._room(free - n * each, sequence, used)
            self._room(free, sequence + used, number - used)
            count -= used * each

    def table(self) -> tuple[np.ndarray, ...]:
        """Columns length, first rank, first sequence, offset, pieces a sequence, sorted by length and rank."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return tuple(runs.T)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple = GROUPS, small: tuple = SMALL) -> Plan:
    """The plan of fewest sequences of all settings; the first of equals, and the first that reaches the bound."""
    best = None
    for g in groups:
        for share in small:
            plan = Plan(counts, capacity, g, capacity // share)
            if best is None or plan.sequences < best.sequences:
                best = plan
            if best.sequences == best.bound:
                return best
    return best


def place(table: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences and offsets of pieces, given their lengths and ranks among the pieces of that length."""
    n, first, sequence, offset, each = table
    key = (n << np.int64(45)) | first
    at = np.searchsorted(key, (length << np.int64(45)) | rank, "right") - 1
    by = rank - first[at]
    return sequence[at] + by // each[at], offset[at] + (by % each[at]) * length


def _pieces(capacity: int, end_id: int, encoder: tuple):
    def run(batches):
        pid = TaskContext.get().partitionId()
        encode = Encoder.shared(*encoder).ids
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for a in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                for k in range(a, min(a + 512, batch.num_rows)):
                    own = np.append(encode(batch.column(1)[k].as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                    cut = (len(own) - 1) % capacity + 1
                    for piece, (lo, hi) in enumerate(zip([0, *range(cut, len(own), capacity)], range(cut, len(own) + 1, capacity))):
                        n = hi - lo
                        rows.append((k, piece, lo, n, zlib.crc32(own[lo:hi].tobytes()), seen[n]))
                        seen[n] += 1
                at, piece, start, n, crc, rank = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), pid, np.int64)), ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc), pa.array(rank)],
                    names=["pid", "doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                )

    return run


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, groups: tuple = GROUPS, encoder: tuple = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text; other columns are ignored. Each row is a document of its own, repeated or
    null doc_ids included. A null text is empty: its one piece holds end_id alone. A piece is never
    longer than ``capacity``. An empty table gives no rows. Equal lengths are placed by their order
    in the input's partitions.
    """
    kept = Stored(spark)
    schema = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
    pieces = kept.put("pk_piece", docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_pieces(capacity, end_id, encoder), Encoder.forget), schema))
    counts = kept.put("pk_count", pieces.groupBy("pid", "length").agg(F.count("*").alias("n")))
    # A histogram: one row for each length up to the capacity.
    plan = best_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, groups)
    table = spark.sparkContext.broadcast(plan.table())
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("pid", "length", F.coalesce(earlier, F.lit(0)).alias("base"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = place(table.value, length, rank + batch.column(batch.schema.names.index("base")).to_numpy())
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    return pieces.join(base, ["pid", "length"]).mapInArrow(released(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
