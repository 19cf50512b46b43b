import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.packing import Plan, best_plan, pack, place


def check_plan(counts, capacity, **kw):
    plan = Plan(counts, capacity, **kw)
    used, spans = defaultdict(int), defaultdict(list)
    for n, c in counts.items():
        s, o = place(plan.table(), np.full(c, n, np.int64), np.arange(c, dtype=np.int64))
        for a, b in zip(s.tolist(), o.tolist()):
            spans[a].append((b, n))
    for own in spans.values():
        at = 0
        for b, n in sorted(own):
            assert b == at
            at += n
        assert at <= capacity
    assert len(spans) == plan.sequences
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_tight(seed):
    r = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(r.choice([1, 50, 5000])):
        counts[min(1024, 1 + int(r.expovariate(1 / r.choice([30, 300, 900]))))] += r.choice([1, 1, 1, 400])
    n = check_plan(dict(counts), 1024)
    total = sum(a * b for a, b in counts.items())
    # first-fit decreasing on the same pieces, as the yardstick
    free = []
    for a in sorted((a for a, b in counts.items() for _ in range(b)), reverse=True)[:4000]:
        k = next((k for k, f in enumerate(free) if f >= a), None)
        if k is None:
            free.append(1024 - a)
        else:
            free[k] -= a
    assert n >= -(-total // 1024)
    if sum(counts.values()) <= 4000:
        assert n <= len(free) * 1.01 + 1


def test_empty_plan():
    assert check_plan({}, 16) == 0
    assert check_plan({16: 3}, 16) == 3
    assert check_plan({9: 4, 7: 4, 1: 1}, 16, groups=2) == 5


def test_pack_equals_library(spark):
    r = random.Random(1)
    words = ["the", "Straße", "éç", "x" * 50, "12345", "\n", "don't", "<|endoftext|>", "  ", "🙂", "日本語", "a\u0085b", "　"]
    texts = [None, "", " ", "<|endoftext|>"] + [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 200, 1500]))) for _ in range(60)]
    texts += [texts[-1]] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rank string")
    got = defaultdict(list)
    rows = pack(spark, df).collect()
    for x in rows:
        got[x.doc_id].append(x)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spans = defaultdict(list)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(got[i], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(x.length == 1024 for x in own[1:])
        for x in own:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
            spans[x.sequence_id].append((x.offset, x.length))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    free = []  # first-fit decreasing
    for n in sorted((x.length for x in rows), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(1024 - n)
        else:
            free[k] -= n
    assert len(spans) <= len(free)


def test_pack_empty_and_repeated(spark):
    assert pack(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = pack(spark, df).collect()
    assert len(rows) == 3 and len({(x.sequence_id, x.offset) for x in rows}) == 3


def test_best_plan_is_near_the_bound():
    r = random.Random(6)
    for lo, hi, slack in ((1, 1024, 1.02), (1, 300, 1.001), (600, 1024, 1.0), (300, 700, 1.02)):
        counts = Counter(r.randint(lo, hi) for _ in range(20000))
        plan = best_plan(counts)
        assert plan.bound <= plan.sequences <= plan.bound * slack
        assert plan.sequences <= min(Plan(counts, groups=g, small=128).sequences for g in (32, 128))
        for n, _, _, offset, each in plan.runs:
            assert offset + n * each <= 1024
        for n in counts:
            assert plan.taken[n] == counts[n]
