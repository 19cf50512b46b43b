"""SentencePiece ids of whole texts, and texts of ids; giant texts by a max-plus parallel scan.

A byte-pair segmentation is the one path through the lattice of pieces on which any two neighbours
stay apart when the merges run on their concatenation alone. So it's found by max-plus products over
states (last piece, how far it reaches past a boundary): pairs that would merge differently weigh
minus infinity, and pieces their scores. A giant text is cut every CHUNK characters, wherever that
falls. Each chunk yields the matrix of best scores from its entry states to its exit states. The
matrices of SPAN chunks in a row are multiplied, as a tree, in a task of their own; of the products,
of which a text of 2 GB has some hundred, the states at the ends of every span follow, and within
each span, again in a task of its own, those at every boundary. Then each chunk traces its own ids
back from its two states, on whatever executor it lies.

No piece of the vocabulary runs from another character into a space sign (checked when the model is
loaded). So in a chunk that holds two word starts or more only its first and last stretch need the
lattice, and what lies between is encoded word by word; a chunk without one goes through it whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored

#: Characters from which on a text is giant, and of a chunk of it. A chunk is longer than any piece.
GIANT, CHUNK = 32_768, 16_384
#: Chunks in a row whose matrices are combined in one task.
SPAN = 256
#: Words whose ids a worker keeps, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
SIGN = "▁"
_SEGMENTS = re.compile(" *[^ ]+| +$")
_POLY = 0xEDB88320


class Words(dict):
    """Ids of words as little-endian uint32 bytes, computed once each."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class Codec:
    _shared: dict = {}

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        # A text's last space, if it stands alone, is a word without letters.
        self.words = Words(lambda w: sp.encode(w, num_threads=1) if w else [sp.piece_to_id(SIGN)])
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.table: list[bytes] = []
        self.byte_ids = [sp.piece_to_id(f"<0x{k:02X}>") for k in range(256)]
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.table.append(b"" if sp.is_control(k) else " ⁇ ".encode())
            else:
                self.table.append(piece.replace(SIGN, " ").encode())
                self.score[piece], self.id[piece] = sp.get_score(k), k
        if any(SIGN in p.lstrip(SIGN) for p in self.id) or sp.normalize(" a  \nﬁ") != f"{SIGN}{SIGN}a{SIGN}{SIGN}\nﬁ":
            raise ValueError("the scan is made for models whose pieces don't run into a space sign and that leave texts as they are")
        self.longest = max(map(len, self.id))
        self.apart = lru_cache(1 << 18)(self._apart)
        self.whole = lru_cache(1 << 17)(lambda t: self.merged(t) == [t])

    @classmethod
    def shared(cls, path: str | None = None) -> Codec:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    # ordinary texts

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids. A space sign in the text counts as a space."""
        if not text:
            return b""
        if SIGN in text:
            text = text.replace(SIGN, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = [x[1:] for x in _SEGMENTS.findall(" " + text)]
        else:
            parts = text.split(" ")
        return b"".join(map(self.words.__getitem__, parts))

    def decode(self, ids: bytes, begins: bool = True) -> bytes:
        """UTF-8 text. begins: the ids begin a text, whose first piece carries the space that encoding puts before it."""
        out = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:] if begins and out[:1] == b" " else out

    # the lattice

    def merged(self, text: str) -> list[str]:
        """The merges' outcome on a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [p for p in pairs if p is not None]
            if not known:
                break
            k = pairs.index(max(known))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def fits(self, a: str, b: str) -> bool:
        return not a or (b[0] == SIGN and a[-1] != SIGN) or self.apart(a, b)

    def pieces_at(self, text: str, at: int, stop: int) -> list[str]:
        """Pieces that begin at ``at`` and end by ``stop``; a character outside the vocabulary is a piece of its own."""
        out = [text[at : at + 1]]
        for n in range(2, min(self.longest, stop - at) + 1):
            piece = text[at : at + n]
            if piece in self.id and self.whole(piece):
                out.append(piece)
        return out

    def weight(self, piece: str) -> float:
        return self.score.get(piece, 0.0)

    def piece_ids(self, piece: str) -> list[int]:
        k = self.id.get(piece)
        return [k] if k is not None else [self.byte_ids[b] for b in piece.encode()]

    def states(self, text: str, at: int, end: bool, begin: bool) -> list[tuple[int, str]]:
        """(reach, piece) of all pieces that start before ``at`` and end there or later, in order."""
        if begin:
            return [(0, "")]
        out = []
        for s in range(max(0, at - self.longest), at):
            out += [(s + len(p) - at, p) for p in self.pieces_at(text, s, at if end else len(text)) if s + len(p) >= at]
        return sorted(set(out))

    def paths(self, text: str, start: dict, stop: int, limit: int, trace: bool = False):
        """Best scores from start states to all states past ``stop``.

        start: {position: {piece: vector}}; pieces may end up to ``limit``. Returns {position:
        {piece: vector}} of states whose piece begins before stop and ends there or later; with
        trace, also the predecessor of each state (for single-element vectors).
        """
        open_, done, back = {k: dict(v) for k, v in start.items()}, {}, {}
        while open_:
            at = min(open_)
            here = open_.pop(at)
            if at >= stop:
                done[at] = here
                continue
            for piece in self.pieces_at(text, at, limit):
                best, source = None, None
                for last, vector in here.items():
                    if self.fits(last, piece):
                        now = vector + self.weight(piece)
                        if trace and (best is None or now[0] > best[0]):
                            source = last
                        best = now if best is None else np.maximum(best, now)
                if best is not None and np.isfinite(best).any():
                    to = open_.setdefault(at + len(piece), {})
                    if piece in to:
                        raise AssertionError("a piece and its end fix its start")
                    to[piece] = best
                    if trace:
                        back[at + len(piece), piece] = (at, source)
        return (done, back) if trace else done

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last word start in [lo, hi), or None if there is none."""
        first = re.compile(f"(?<=[^{SIGN}]){SIGN}").search(text, max(lo, 1), hi)
        if not first:
            return None
        a, b = first.start(), hi
        while True:
            b = text.rfind(SIGN, a, b)
            if b == a or text[b - 1] != SIGN:
                return a, b

    def matrix(self, text: str, lo: int, hi: int, begin: bool, end: bool) -> np.ndarray:
        """Best scores from the states at lo to those at hi, by the pieces that begin in [lo, hi)."""
        entry, exit_ = self.states(text, lo, False, begin), self.states(text, hi, end, False)
        limit = hi if end else len(text)
        place = {s: k for k, s in enumerate(exit_)}
        unit = np.full((len(entry), len(entry)), -np.inf)
        np.fill_diagonal(unit, 0.0)
        start: dict = {}
        for (reach, piece), row in zip(entry, unit):
            start.setdefault(lo + reach, {})[piece] = row
        out = np.full((len(entry), len(exit_)), -np.inf)
        cut = self.cuts(text, lo, hi)
        if cut:
            heads = [v for v in self.paths(text, start, cut[0], cut[0]).get(cut[0], {}).values()]
            head = np.maximum.reduce(heads) if heads else np.full(len(entry), -np.inf)
            middle = self.encode(text[cut[0] : cut[1]].replace(SIGN, " ")[1:]) if cut[1] > cut[0] else b""
            head = head + sum(self.sp.get_score(int(k)) for k in np.frombuffer(middle, "<u4"))
            start = {cut[1]: {"": head}}
        for at, ends in self.paths(text, start, hi, limit).items():
            for piece, vector in ends.items():
                if (at - hi, piece) in place:
                    out[:, place[at - hi, piece]] = vector
        return out

    def trace(self, text: str, lo: int, hi: int, begin: bool, end: bool, entry: int, exit_: int) -> list[str] | bytes:
        """Ids (uint32 bytes) of the pieces that begin in [lo, hi), between two states given by number."""
        reach, first = self.states(text, lo, False, begin)[entry]
        past, last = self.states(text, hi, end, False)[exit_]
        limit = hi if end else len(text)

        def run(start: dict, stop: int, bound: int, goal: tuple[int, str] | None) -> bytes:
            done, back = self.paths(text, start, stop, bound, True)
            at, piece = goal or (stop, max(done[stop], key=lambda p: done[stop][p][0]))
            pieces = []
            while (at, piece) in back:
                pieces.append(piece)
                at, piece = back[at, piece]
            ids = [k for p in reversed(pieces) for k in self.piece_ids(p)]
            return struct.pack(f"<{len(ids)}I", *ids)

        start = {lo + reach: {first: np.zeros(1)}}
        cut = self.cuts(text, lo, hi)
        if not cut:
            return run(start, hi, limit, (hi + past, last))
        head = run(start, cut[0], cut[0], None) if lo + reach < cut[0] else b""
        middle = self.encode(text[cut[0] : cut[1]].replace(SIGN, " ")[1:]) if cut[1] > cut[0] else b""
        return head + middle + run({cut[1]: {"": np.zeros(1)}}, hi, limit, (hi + past, last))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if b.size and a.size else np.full((a.shape[0], b.shape[1]), -np.inf)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of matrices in a row, by pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def boundary_states(matrices: list[np.ndarray], first: int | None = None, last: int | None = None) -> list[int]:
    """The best path's state at every boundary, from products up to it and from it on; first, last: the states at the ends, where known."""
    if first is not None:
        matrices = [matrices[0][first : first + 1], *matrices[1:]]
    if last is not None:
        matrices = [*matrices[:-1], matrices[-1][:, last : last + 1]]
    ahead = [np.zeros((1, matrices[0].shape[0]))]
    for m in matrices:
        ahead.append(combine(ahead[-1], m))
    behind = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        behind.append(combine(m, behind[-1]))
    out = []
    for a, b in zip(ahead, reversed(behind)):
        total = a[0] + b[:, 0]
        if not np.isfinite(total).any():
            raise ValueError("no path: a chunk's matrix is wrong")
        out.append(int(total.argmax()))
    return [out[0] if first is None else first, *out[1:-1], out[-1] if last is None else last]


def crc_product(a: int, b: int) -> int:
    """The product of two polynomials modulo CRC-32's, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """crc32(A + B) from crc32(A), crc32(B) and B's length in bytes."""
    shift, power, n = 1 << 31, 1 << 23, length  # one, and x to the 8
    while n:
        if n & 1:
            shift = crc_product(power, shift)
        power = crc_product(power, power)
        n >>= 1
    return crc_product(shift, first) ^ second


def _ordinary(path: str | None):
    def run(batches):
        codec = Codec.shared(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                same = codec.decode(ids) == (text or "").replace(SIGN, " ").encode()
                rows.append((len(ids) // 4, zlib.crc32(ids), len(text or ""), same, 1))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())))],
                names=["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip", "chunks"],
            )

    return run


def _chunks(size: int, margin: int):
    """Rows of a giant text's chunks: what lies ``margin`` characters around them comes along."""

    def run(batches):
        pid, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = SIGN + text.as_py().replace(" ", SIGN)
                k += 1
                for c, lo in enumerate(range(0, len(text), size)):
                    hi = min(lo + size, len(text))
                    at = max(0, lo - margin)
                    row = [(pid << 32) + k], [doc], [c], [lo - at], [hi - at], [lo == 0], [hi == len(text)], [text[at : hi + margin]]
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["key", "doc_id", "chunk", "lo", "hi", "begin", "end", "text"])

    return run


def _matrices(path: str | None):
    def run(batches):
        codec = Codec.shared(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [codec.matrix(r["text"], r["lo"], r["hi"], r["begin"], r["end"]) for r in rows]
            more = [pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "entries", "exits", "matrix"])

    return run


def _matrices_of(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["matrix"]).reshape(r["entries"], r["exits"]) for r in rows]


def _span_product(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    m = product(_matrices_of(rows))
    return pa.table({"key": pa.array([rows[0]["key"]]), "span": pa.array([rows[0]["span"]], pa.int32()), "entries": pa.array([m.shape[0]], pa.int32()), "exits": pa.array([m.shape[1]], pa.int32()), "matrix": pa.array([m.tobytes()], pa.binary())})


def _span_states(table: pa.Table) -> pa.Table:
    """A text's products to the states at the ends of its spans."""
    rows = sorted(table.to_pylist(), key=lambda r: r["span"])
    found = boundary_states(_matrices_of(rows))
    return pa.table({"key": pa.array([r["key"] for r in rows], pa.int64()), "span": pa.array([r["span"] for r in rows], pa.int32()), "first": pa.array(found[:-1], pa.int32()), "last": pa.array(found[1:], pa.int32())})


def _chunk_states(table: pa.Table) -> pa.Table:
    """A span's matrices and the states at its ends to those of its chunks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    found = boundary_states(_matrices_of(rows), rows[0]["first"], rows[0]["last"])
    return pa.table({"key": pa.array([r["key"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "entry": pa.array(found[:-1], pa.int32()), "exit": pa.array(found[1:], pa.int32())})


def _traced(path: str | None):
    def run(batches):
        codec = Codec.shared(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, lo, hi = r["text"], r["lo"], r["hi"]
                ids = codec.trace(text, lo, hi, r["begin"], r["end"], r["entry"], r["exit"])
                a = lo + codec.states(text, lo, False, r["begin"])[r["entry"]][0]
                b = hi + codec.states(text, hi, r["end"], False)[r["exit"]][0]
                same = codec.decode(ids, False) == text[a:b].replace(SIGN, " ").encode()
                out.append((r["key"], r["doc_id"], r["chunk"], zlib.crc32(ids), len(ids), b - a - r["begin"], same, ids))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, types)], names=["key", "doc_id", "chunk", "crc", "bytes", "chars", "same", "ids"])

    return run


def _joined(batches):
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            crc = 0
            for p in parts:
                crc = crc_joined(crc, p["crc"], p["bytes"])
            out.append((sum(p["bytes"] for p in parts) // 4, crc, sum(p["chars"] for p in parts), all(p["same"] for p in parts), len(parts)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types))], names=["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip", "chunks"])


def giant_chunks(spark: SparkSession, docs: DataFrame, kept: Stored, chunk: int = CHUNK, path: str | None = None, span: int = SPAN) -> DataFrame:
    """Ids of the chunks of giant texts: key (a text's), doc_id, chunk, crc, bytes, chars, same, ids."""
    margin = Codec.shared(path).longest
    if chunk <= 2 * margin:
        raise ValueError(f"a chunk must be longer than {2 * margin} characters")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(chunk, margin), "key long, doc_id long, chunk int, lo int, hi int, begin boolean, end boolean, text string")
    schema = "key long, doc_id long, chunk int, lo int, hi int, begin boolean, end boolean, text string, entries int, exits int, matrix binary"
    # Chunks are dealt over all tasks here, however many one text has.
    held = kept.put("sp_chunk", cut.repartition("key", "chunk").mapInArrow(_matrices(path), schema))
    spans = held.select("key", F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "entries", "exits", "matrix")
    ends = spans.groupBy("key", "span").applyInArrow(_span_product, "key long, span int, entries int, exits int, matrix binary").groupBy("key").applyInArrow(_span_states, "key long, span int, first int, last int")
    states = spans.join(ends, ["key", "span"]).groupBy("key", "span").applyInArrow(_chunk_states, "key long, chunk int, entry int, exit int")
    both = held.drop("entries", "exits", "matrix").join(states, ["key", "chunk"])
    return both.mapInArrow(_traced(path), "key long, doc_id long, chunk int, crc long, bytes long, chars long, same boolean, ids binary")


def encode_decode(spark: SparkSession, docs: DataFrame, giant: int = GIANT, chunk: int = CHUNK, path: str | None = None, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, n_chars, round_trip, chunks.

    docs: doc_id, text; other columns are ignored. ids_crc32 is of the ids as little-endian unsigned
    32-bit numbers. round_trip: decoding gives the text again, its space signs (U+2581) as spaces. A
    null or empty text has no ids. Repeated rows and null doc_ids come back once each. An empty
    table gives no rows.
    """
    kept = Stored(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_ids long, ids_crc32 long, n_chars long, round_trip boolean, chunks int"
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(_ordinary(path), schema)
    parts = giant_chunks(spark, docs.where(F.length("text") > giant), kept, chunk, path, span)
    grouped = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "crc", "bytes", "chars", "same"))).alias("parts"))
    return small.unionByName(grouped.select("doc_id", "parts").mapInArrow(_joined, schema))
