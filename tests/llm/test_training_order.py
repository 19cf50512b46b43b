import random

import numpy as np
import pytest

from sparkloom.llm import training_order as to
from sparkloom.llm.tokens import Encoder


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    out = to.permute(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 50 or (out != to.permute(np.arange(n), n, 6)).any()


def test_round_trip(spark):
    r = random.Random(0)
    texts = [None, "", "<|endoftext|> x"] + [" ".join(r.choice(["alpha", "é", "Beta", "\n"]) for _ in range(r.choice([1, 20, 3000]))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(3)
    path, told = to.materialise(spark, df, length=64, shard_rows=50)
    back = sorted(to.read_shards(spark, path, length=64, shard_rows=50).collect())
    told = {x.slot: x for x in told.collect()}
    assert [x.slot for x in back] == list(range(len(told)))
    assert all(x.ids_crc32 == told[x.slot].ids_crc32 and x.n == told[x.slot].n for x in back)
    enc = Encoder()
    stream = {i: [*enc.ids(t).tolist(), to.END_ID] for i, t in enumerate(texts)}
    got = sum(x.n for x in back)
    assert got == sum(map(len, stream.values()))
    for x in back:  # the sequence begins with what is left of its first document
        own = stream[told[x.slot].first_doc][told[x.slot].first_at :][: x.n]
        assert np.frombuffer(x.ids, "<u2").tolist()[: len(own)] == own
    part = sorted(to.read_shards(spark, path, length=64, shard_rows=50, from_slot=70).collect())
    assert part == back[70:]


def test_empty(spark):
    assert to.written_and_read(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = to.written_and_read(spark, spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert len(rows) == 1 and rows[0].verified and rows[0].n_ids == 6


def test_slots_equal_a_plain_permutation(spark):
    """Each slot of the shards against the plain stream, dealt by a Feistel network written out with whole numbers."""
    mask64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    def slot_of(x, n, key):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        keys = [mix((k * 0x9E3779B97F4A7C15 & mask64) ^ key) for k in range(1, to.ROUNDS + 1)]
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ (mix((right + k) & mask64) & (1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    r = random.Random(5)
    texts = [" ".join(r.choice(["red", "green", "blue"]) for _ in range(r.choice([0, 3, 200]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path, _ = to.materialise(spark, df, key=77, length=32, shard_rows=16)
    enc = Encoder()
    stream = [int(i) for t in texts for i in [*enc.ids(t), to.END_ID]]
    cut = [stream[k : k + 32] for k in range(0, len(stream), 32)]
    want = {slot_of(k, len(cut), 77): own for k, own in enumerate(cut)}
    got = {x.slot: np.frombuffer(x.ids, "<u2").tolist()[: x.n] for x in to.read_shards(spark, path, length=32, shard_rows=16).collect()}
    assert got == want


def test_resumed_read_opens_the_needed_files_only(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    path, told = to.materialise(spark, df, length=16, shard_rows=10)
    files = to.shard_files(spark, path)
    assert [s for _, s in files] == list(range(len(files))) and len(files) == -(-told.count() // 10)
    rest = to.read_shards(spark, path, length=16, shard_rows=10, from_slot=95)
    assert len(rest.inputFiles()) == len(files) - 9 and rest.count() == told.count() - 95
    with pytest.raises(FileNotFoundError):
        to.read_shards(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception, match="two bytes"):
        to.materialise(spark, df, end_id=70000)
