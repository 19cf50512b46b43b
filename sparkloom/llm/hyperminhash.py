"""Near-duplicate documents by HyperMinHash.

Each document's set of word shingles gets a sketch of TABLES x BUCKETS registers. In a table, its
own hash sends every shingle to a bucket and to a value; the register keeps the bucket's least
value as a count of leading zeros and MANTISSA bits behind the first one (16 bits in all). The
BUCKETS registers of a table make one band: documents that agree in any band become candidates.
At similarity 0.8 a register agrees with chance 0.8 at least, empty ones included, so a pair shares
none of 32 bands of four with chance (1 - 0.8**4)**32 = 5e-8.

Documents with equal sets form a class, and only its smallest doc_id goes on. Candidates are
estimated from all registers, with the collisions that compression causes taken off, and those more
than five standard errors below the threshold (a chance of 3e-7 at the threshold) go, as do those
whose set sizes alone rule a link out. The rest are confirmed on their full shingle sets (64-bit
hashes of shingles, so two different ones count as equal with a chance of about 5e-20 a pair).

No round's rows grow with the square of a bucket, and no bucket's pairs are all emitted.

1. Each document meets one leader: the least member that it shares most buckets with.
2. Where a bucket still holds several components, the members outside its largest one are active.
   Active members are compared with all members in sketch space, tile by tile, and each meets the
   likeliest member of another component.
3. What is still apart is compared again; tiles name their members (not pairs) that a link is still
   possible for, in groups of bounded length and bounded numbers of shingles, and every pair of two
   groups is decided on full sets. A pair belongs to the largest bucket that it shares, so members
   of a large group are sent for a few of their buckets only.

So each pair that shares a bucket has been confirmed or ruled out, or is connected already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, components, semi_filter
from .textkernel import U, blocks, mix, released, row_slices, text_shingles

TABLES, BUCKETS, MANTISSA = 32, 4, 10
EMPTY = 0xFFFF
#: Chance that two different minima of a bucket compress alike, for MANTISSA bits (a fixed value of the sketch).
COLLISION = 0.169919487159739 / 2**MANTISSA
#: Members of a tile's side in sketch space; documents, and about as many shingles, of a side where full sets are compared.
BLOCK, GROUP, SHINGLES = 512, 128, 1 << 20
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def compress(least: np.ndarray) -> np.ndarray:
    """Registers of 30-bit least values: leading zeros (high 6 bits) and the bits behind the first one."""
    bits = np.frexp(least.astype(np.float64))[1]
    zeros = 30 - bits
    behind = np.where(bits > 0, least - (np.int64(1) << np.maximum(bits - 1, 0)), 0)
    shift = (bits - 1) - MANTISSA
    mantissa = np.where(shift >= 0, behind >> np.maximum(shift, 0), behind << np.maximum(-shift, 0))
    return ((zeros << MANTISSA) | mantissa).astype(np.uint16)


def sketches(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (texts, TABLES, BUCKETS) of shingle sets; all EMPTY for an empty set."""
    out = np.full((len(at) - 1, TABLES, BUCKETS), EMPTY, np.uint16)
    for a, b in blocks(at, 1 << 17):
        rows = np.flatnonzero(at[a + 1 : b + 1] > at[a:b]) + a
        if not len(rows):
            continue
        part, cuts = shingles[at[a] : at[b]], at[rows] - at[a]
        for t in range(TABLES):
            x = part * _SEEDS[t]
            x ^= x >> U(32)
            x *= U(0xD6E8FEB86659FD93)
            high = (x >> U(32)).astype(np.uint32)
            bucket, value = high >> np.uint32(30), high & np.uint32(0x3FFFFFFF)
            for k in range(BUCKETS):
                least = np.minimum.reduceat(np.where(bucket == k, value, np.uint32(0xFFFFFFFF)), cuts)
                full = least != 0xFFFFFFFF
                out[rows[full], t, k] = compress(least[full].astype(np.int64))
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers, over buckets that either set fills."""
    both = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & both).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
    return (share - COLLISION) / (1 - COLLISION)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, (texts, TABLES)."""
    packed = np.ascontiguousarray(registers).view(U).reshape(len(registers), TABLES)
    return mix(packed + _SEEDS[None, :])


def signature_rows(k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts):
                sets, at = text_shingles(texts.slice(a, b - a), k)
                sums = np.zeros((2, len(sets) + 1), U)
                np.cumsum(mix(sets), out=sums[0, 1:])
                np.cumsum(mix(sets ^ U(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
                own = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
                regs = sketches(sets, at).reshape(b - a, -1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(at)), pa.array(own[0]), pa.array(own[1]), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch"],
                )

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _band_rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            keys = band_keys(_registers(part.column(1)))
            rep = np.repeat(part.column(0).to_numpy(), TABLES)
            band = np.tile(np.arange(TABLES, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(rep), pa.array(band)], names=["key", "rep", "band"])


def _spot_rows(batches):
    """Of each document's shared buckets: the leader met most often, bucket sizes by band (int32, 0 where it is alone), and keys."""
    for batch in batches:
        spots = batch.column(1)
        flat, lens = spots.flatten(), spots.value_lengths().to_numpy()
        row, rep = np.repeat(np.arange(len(lens)), lens), batch.column(0).to_numpy()
        band, key, size, lead = (flat.field(c).to_numpy() for c in ("band", "key", "c", "lead"))
        sizes = np.zeros((len(lens), TABLES), np.int32)
        sizes[row, band] = np.minimum(size, 2**31 - 1)
        other = np.flatnonzero(lead != rep[row])
        order = other[np.lexsort((lead[other], row[other]))]
        r, ld = row[order], lead[order]
        cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (ld[1:] != ld[:-1])))) if len(r) else np.zeros(0, np.int64)
        times = np.diff(np.append(cut, len(r)))
        best = np.lexsort((ld[cut], -times, r[cut]))
        best = best[np.flatnonzero(np.diff(r[cut][best], prepend=-1))]
        leads, known = np.zeros(len(lens), np.int64), np.zeros(len(lens), bool)
        leads[r[cut][best]], known[r[cut][best]] = ld[cut][best], True
        at = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep), pa.array(leads, mask=~known), pa.array([x.tobytes() for x in sizes], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(key))], names=["rep", "lead", "sizes", "keys"]
        )


def least_estimate(threshold: float, filled: np.ndarray) -> np.ndarray:
    """Estimates below this, five standard errors under the threshold, are given up; filled: registers compared."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1)) - 1e-9


def _filled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a != EMPTY) | (b != EMPTY)).sum(axis=1)


def _hopeful(percent: int):
    """Pairs of a, na, sa and b, nb, sb that sketches and set sizes don't rule out: a, na, b."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
                a, b = _registers(at["sa"]), _registers(at["sb"])
                na, nb = at["na"].to_numpy(), at["nb"].to_numpy()
                good = (estimate(a, b) >= least_estimate(percent / 100, _filled(a, b))) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield pa.RecordBatch.from_arrays([at["a"], at["na"], at["b"]], names=["a", "na", "b"]).filter(pa.array(good))

    return run


def _sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of a column of texts, hashed a slice at a time."""
    texts = texts.combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    parts, lens = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in row_slices(texts):
        sets, at = text_shingles(texts.slice(a, b - a), k)
        parts.append(sets)
        lens.append(np.diff(at))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(lens))))


def _confirm(k: int, percent: int):
    """Of a leader and members: the pairs (leader, member) whose full sets are alike enough."""

    def run(table: pa.Table) -> pa.Table:
        ids, leader = table.column("id").to_numpy(), table.column("leader").to_numpy(zero_copy_only=False)
        sets, at = _sets(table.column("text"), k)
        at0 = int(np.flatnonzero(leader)[0])
        own, lens = sets[at[at0] : at[at0 + 1]], np.diff(at)
        spot = np.searchsorted(own, sets)
        spot[spot == len(own)] = 0
        shared = np.diff(np.concatenate(([0], np.cumsum(own[spot] == sets)))[at]) if len(own) else np.zeros(len(ids), np.int64)
        good = ~leader & (shared > 0) & (100 * shared >= percent * (len(own) + lens - shared))
        return pa.table({"a": pa.array(np.full(int(good.sum()), ids[at0])), "b": pa.array(ids[good])})

    return run


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. pairs: a, na (its set's size), b, stored.

    A leader a and its members are dealt over tasks of about ``group`` members and SHINGLES shingles
    (members have at most 100 / percent times as many as their leader); to each its text goes once.
    """
    each = F.least(F.lit(group), F.greatest(F.lit(1), F.floor(F.lit(SHINGLES) / F.col("na"))))
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("c")), "a").withColumn("salts", F.ceil(F.col("c") / each)).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = semi_filter(docs.select("doc_id", "text"), ids, "doc_id")
    members = dealt.select("a", "salt", F.col("b").alias("doc_id"), F.lit(False).alias("leader"))
    leaders = dealt.select("a", "salt", F.col("a").alias("doc_id"), F.lit(True).alias("leader")).distinct()
    rows = members.unionByName(leaders).join(texts, "doc_id").select("a", "salt", F.col("doc_id").alias("id"), "leader", "text")
    return rows.groupBy("a", "salt").applyInArrow(_confirm(k, percent), "a long, b long")


def _possible(table: pa.Table, percent: int, best: bool):
    """For each active member of a tile: its row, and the rows of other components that may be linked with it.

    A pair counts in the largest bucket that it shares only (of equal ones, in the first band). best: in either
    direction; else once for a pair.
    """
    table = table.combine_chunks()
    rep, comp, n, active, left = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "n", "active", "left"))
    regs = _registers(table.column("sketch"))
    packed = regs.view(U).reshape(len(rep), TABLES)
    # Shared buckets in order of size; a band's place breaks ties.
    order = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.int32).reshape(-1, TABLES).astype(np.int64) * TABLES + np.arange(TABLES)[::-1]
    key = U(table.column("key")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
    band = int(np.flatnonzero(band_keys(regs[:1].reshape(1, TABLES, BUCKETS))[0] == key)[0])
    above = [t for t in range(TABLES) if t != band]
    right = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        others = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if not best:
            others = others[~active[others] | (rep[others] > rep[i])]
        more = [t for t in above if order[i, t] > order[i, band]]
        if len(others) and more:
            others = others[~(packed[others][:, more] == packed[i, more]).any(axis=1)]
        if len(others):
            mine = np.broadcast_to(regs[i], (len(others), regs.shape[1]))
            like = estimate(regs[others], mine)
            good = like >= least_estimate(percent / 100, _filled(regs[others], mine))
            if good.any():
                yield rep, comp, n, int(i), others[good], like[good]


def _likeliest(percent: int):
    """Of each active member the likeliest partner in the tile: b (the member), a, na, like."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for rep, _, n, i, others, like in _possible(table, percent, True):
            top = others[np.lexsort((rep[others], -like))[0]]
            out.append((int(rep[i]), int(rep[top]), int(n[top]), float(like.max())))
        b, a, na, like = zip(*out) if out else ((),) * 4
        return pa.table({"b": pa.array(b, pa.int64()), "a": pa.array(a, pa.int64()), "na": pa.array(na, pa.int64()), "like": pa.array(like, pa.float64())})

    return run


def _groups(rows: np.ndarray, n: np.ndarray, group: int) -> np.ndarray:
    """A group number for each of rows (ascending by n): at most ``group`` rows and about SHINGLES shingles in one."""
    out, now, many, long = np.zeros(len(rows), np.int64), 0, 0, 0
    for k, r in enumerate(rows):
        if many == group or (many and long + n[r] > SHINGLES):
            now, many, long = now + 1, 0, 0
        out[k], many, long = now, many + 1, long + int(n[r])
    return out


def _group_pairs(percent: int, group: int):
    """Pairs of groups of a tile's members between which links are possible: key, i, j, part, then ids and components of both."""

    def run(table: pa.Table) -> pa.Table:
        found = list(_possible(table, percent, False))
        out: dict[str, list] = {c: [] for c in ("part", "ids", "comps", "n_left")}
        if found:
            rep, comp, n = found[0][:3]
            lefts = np.array([i for *_, i, _, _ in found])
            lefts = lefts[np.argsort(n[lefts], kind="stable")]
            rights = np.unique(np.concatenate([o for *_, o, _ in found]))
            rights = rights[np.argsort(n[rights], kind="stable")]
            of_left = dict(zip(lefts.tolist(), _groups(lefts, n, group).tolist()))
            of_right = np.zeros(len(rep), np.int64)
            of_right[rights] = _groups(rights, n, group)
            sides: dict[tuple[int, int], tuple[set, set]] = {}
            for *_, i, others, _ in found:
                for g in np.unique(of_right[others]).tolist():
                    own = sides.setdefault((of_left[i], g), (set(), set()))
                    own[0].add(i)
                    own[1].update(others[of_right[others] == g].tolist())
            for part, (a, b) in enumerate(sides.values()):
                rows = [*sorted(a), *sorted(b)]
                out["part"].append(part)
                out["ids"].append(rep[rows].tolist())
                out["comps"].append(comp[rows].tolist())
                out["n_left"].append(len(a))
        at = {c: table.column(c).combine_chunks().take(pa.array([0] * len(out["part"]), pa.int64())) for c in ("key", "i", "j")}
        long = pa.list_(pa.int64())
        return pa.table(at | {"part": pa.array(out["part"], pa.int64()), "ids": pa.array(out["ids"], long), "comps": pa.array(out["comps"], long), "n_left": pa.array(out["n_left"], pa.int64())})

    return run


def _confirm_groups(k: int, percent: int):
    """Links between two groups, without those that earlier ones already connect. Each text comes, and is hashed, once."""

    def run(lists: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        sets, at = _sets(held.column("text"), k)
        words, sets = np.unique(sets, return_inverse=True)
        row = {x: r for r, x in enumerate(held.column("id").to_pylist())}
        for ids, comps, n_left in zip(lists.column("ids").to_pylist(), lists.column("comps").to_pylist(), lists.column("n_left").to_pylist()):
            root = {c: c for c in comps}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            b_ids, b_comps = ids[n_left:], comps[n_left:]
            spans = [(int(at[row[x]]), int(at[row[x] + 1])) for x in b_ids]
            right = np.concatenate([sets[lo:hi] for lo, hi in spans])
            lens = np.array([hi - lo for lo, hi in spans])
            cuts = np.concatenate(([0], np.cumsum(lens)))
            mark = np.zeros(len(words), bool)
            for x, c in zip(ids[:n_left], comps[:n_left]):
                if all(find(c) == find(d) for d in b_comps):
                    continue
                own = sets[at[row[x]] : at[row[x] + 1]]
                mark[own] = True
                shared = np.diff(np.concatenate(([0], np.cumsum(mark[right])))[cuts])
                mark[own] = False
                for r in np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(own) + lens - shared))).tolist():
                    if find(c) != find(b_comps[r]):
                        root[find(c)] = find(b_comps[r])
                        out.append((x, b_ids[r]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def confirm_groups(docs: DataFrame, lists: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what pairs of groups link. lists: key, i, j, part, ids (the first n_left are one group, the rest the other), comps."""
    by = ["key", "i", "j", "part"]
    need = lists.select(*by, F.explode(F.array_distinct("ids")).alias("doc_id"))
    texts = semi_filter(docs.select("doc_id", "text"), need.select("doc_id").distinct(), "doc_id")
    held = need.join(texts, "doc_id").select(*by, "doc_id", "text").toDF(*[f"of_{c}" for c in by], "id", "text")
    return lists.groupBy(*by).cogroup(held.groupBy(*[f"of_{c}" for c in by])).applyInArrow(_confirm_groups(k, percent), "a long, b long")


def tiles(reps: DataFrame, spots: DataFrame, comp: DataFrame, kept: Stored, block: int) -> DataFrame | None:
    """Members of buckets that hold several components, dealt to tiles of active members (left) and all members; None if there are none.

    A bucket of c members, A of them active, gives c * ceil(A / block) + A * ceil(c / block) rows.
    """
    kept.drop("hm_now", "hm_several")
    now = kept.put("hm_now", spots.select("rep", "keys").join(comp, spots.rep == comp.id, "left").select("rep", "keys", F.coalesce("comp", "rep").alias("comp")))
    members = now.select(F.explode("keys").alias("key"), "rep", "comp")
    largest = F.max_by("comp", F.struct("n", -F.col("comp")))
    sums = members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(largest.alias("main"), F.sum("n").alias("c"), (F.sum("n") - F.max("n")).alias("n_active"))
    several = kept.put("hm_several", sums.where("n_active > 0"))
    if several.isEmpty():
        return None
    here = members.join(several, "key").withColumn("active", F.col("comp") != F.col("main"))
    lefts, rights = F.ceil(F.col("n_active") / block), F.ceil(F.col("c") / block)
    spot = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_right = F.transform(F.sequence(F.lit(0).cast("long"), lefts - 1), lambda i: spot(i, F.pmod(F.xxhash64("rep"), rights), False))
    as_left = F.transform(F.sequence(F.lit(0).cast("long"), rights - 1), lambda j: spot(F.pmod(F.xxhash64("rep"), lefts), j, True))
    here = here.select("key", "rep", "comp", "active", F.explode(F.when(F.col("active"), F.concat(as_left, as_right)).otherwise(as_right)).alias("at"))
    wide = reps.select("rep", "n", "sketch").join(spots.select("rep", "sizes"), "rep")
    return here.join(wide, "rep").select("key", "at.i", "at.j", "at.left", "rep", "comp", "active", "n", "sketch", "sizes")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: doc_id long, text string; other columns are ignored. doc_id is a key: repeated rows come
    back once each, with equal results. A null or wordless text has an empty set: n_shingles 0,
    linked with nothing, kept. A text of fewer than k words has its whole sequence as its one
    shingle. A row of null doc_id links with nothing (component_id null) and is kept. An empty
    table gives no rows. Ties: of equal documents the smallest doc_id is kept. A pair at the
    threshold is missed with a chance of 4e-7 at most (no shared band, or an estimate five standard
    errors too low); more alike ones by less. ``block`` and ``group`` bound what a task holds and
    change no result.
    """
    kept = Stored(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_shingles long, s1 long, s2 long, sketch binary"
    sketched = kept.put("hm_sketch", docs.mapInArrow(released(signature_rows(k)), schema))
    linkable = sketched.where("doc_id is not null and n_shingles > 0")
    classes = kept.put("hm_class", linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    reps = sketched.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    reps = kept.put("hm_rep", reps)
    bands = reps.select("rep", "sketch").mapInArrow(released(_band_rows), "key long, rep long, band int")
    leaders = kept.put("hm_lead", bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("c")).where("c > 1"))
    # At most TABLES entries a document.
    spots = bands.join(leaders, "key").groupBy("rep").agg(F.collect_list(F.struct("band", "key", "c", "lead")).alias("spots"))
    spots = kept.put("hm_spot", spots.mapInArrow(released(_spot_rows), "rep long, lead long, sizes binary, keys array<long>"))

    def of(side: str) -> DataFrame:
        return reps.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))

    def hopeful(pairs: DataFrame, name: str) -> DataFrame:
        return kept.put(name, pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_hopeful(percent), "a long, na long, b long"))

    # Round 1: each document and one leader.
    links = confirm(docs, hopeful(spots.where("lead is not null").select(F.col("lead").alias("a"), F.col("rep").alias("b")), "hm_pairs"), k, percent, group)
    comp = kept.put("hm_comp", components(spark, kept.put("hm_links", links), kept))
    for last in (False, True):
        dealt = tiles(reps, spots, comp, kept, block)
        if dealt is None:
            break
        kept.drop("hm_pairs")
        if not last:  # Round 2: each active member and its likeliest partner.
            pairs = dealt.groupBy("key", "i", "j").applyInArrow(_likeliest(percent), "b long, a long, na long, like double")
            pairs = pairs.groupBy("b").agg(F.max_by(F.struct("a", "na"), F.struct("like", -F.col("a"))).alias("x")).select("x.a", "x.na", "b")
            more = confirm(docs, kept.put("hm_pairs", pairs), k, percent, group)
        else:  # Round 3: all that is still apart.
            lists = dealt.groupBy("key", "i", "j").applyInArrow(_group_pairs(percent, group), "key long, i long, j long, part long, ids array<long>, comps array<long>, n_left long")
            more = confirm_groups(docs, kept.put("hm_pairs", lists), k, percent)
        more = kept.put("hm_links", more)
        if not more.isEmpty():
            comp = kept.put("hm_comp", components(spark, comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more), kept))
    final = kept.put("hm_final", classes.join(comp, classes.rep == comp.id, "left").select("s1", "s2", F.coalesce("comp", "rep").alias("component_id")))
    kept.drop("hm_rep", "hm_lead", "hm_spot", "hm_pairs", "hm_now", "hm_several", "hm_links", "hm_comp", "components", "hm_class")

    told = sketched.select("doc_id", "n_shingles", "s1", "s2")
    joined = told.where("doc_id is not null and n_shingles > 0").join(final, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    alone = told.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
