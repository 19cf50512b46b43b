import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import sentencepiece_codec as sc

CODEC = sc.Codec()


def library(text):
    return np.array(CODEC.sp.encode(text), "<u4").tobytes()


def random_text(r, n):
    kind = r.randrange(4)
    if kind == 0:
        return "".join(r.choice("abcdeinorst") for _ in range(n))
    if kind == 1:
        return "".join(r.choice(["the", "ing", "tion", " ", "  ", "\n", "é", "日", "🙂", "0", "<0x0A>", "▁", "St"]) for _ in range(n // 3))
    if kind == 2:
        return r.choice([" ", "   ", "a", "ab", "é", "aaaa "]) * (n // 4)
    return " ".join(r.choice(["international", "Straße", "x", "pneumonoultra", "don't", "e.g."]) for _ in range(n // 8))


@pytest.mark.parametrize("seed", range(30))
def test_encode_decode_equals_library(seed):
    r = random.Random(seed)
    for n in (0, 1, 7, 90, 900):
        t = random_text(r, n)
        ids = CODEC.encode(t)
        assert ids == library(t)
        assert CODEC.decode(ids) == t.replace("▁", " ").encode() == CODEC.sp.decode(np.frombuffer(ids, "<u4").tolist()).encode()


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_library(seed):
    r = random.Random(100 + seed)
    text = random_text(r, 900) or "a"
    t = sc.SIGN + text.replace(" ", sc.SIGN)
    size = r.choice([40, 64, 200])
    spans = [(lo, min(lo + size, len(t))) for lo in range(0, len(t), size)]
    args = []
    for lo, hi in spans:
        at = max(0, lo - CODEC.longest)
        args.append((t[at : hi + CODEC.longest], lo - at, hi - at, lo == 0, hi == len(t)))
    states = sc.boundary_states([CODEC.matrix(*a) for a in args])
    ids = b"".join(CODEC.trace(*a, x, y) for a, x, y in zip(args, states, states[1:]))
    assert ids == library(text)


def test_product_is_associative_and_crc_joins():
    r = np.random.default_rng(0)
    a, b, c = r.normal(size=(3, 4)), r.normal(size=(4, 2)), r.normal(size=(2, 5))
    assert np.allclose(sc.combine(sc.combine(a, b), c), sc.combine(a, sc.combine(b, c)))
    x, y = b"some bytes", b"others" * 50
    assert sc.crc_joined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)
    assert sc.crc_joined(0, zlib.crc32(y), len(y)) == zlib.crc32(y)


def test_tree_of_products_gives_the_states_of_the_whole():
    r = np.random.default_rng(4)
    sizes = [1, *r.integers(1, 6, 40), 1]
    matrices = [r.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:])]
    whole = sc.boundary_states(matrices)
    for span in (1, 3, 7, 100):
        parts = [matrices[k : k + span] for k in range(0, len(matrices), span)]
        ends = sc.boundary_states([sc.product(p) for p in parts])
        got = [sc.boundary_states(p, a, b) for p, a, b in zip(parts, ends, ends[1:])]
        assert [x for g in got for x in g[:-1]] + [got[-1][-1]] == whole


def test_thousands_of_chunks_in_spark(spark):
    r = random.Random(11)
    text = "".join(random_text(r, 600) for _ in range(250))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (x,) = sc.encode_decode(spark, df, giant=1000, chunk=60, span=32).collect()
    ids = library(text)
    assert x.chunks > 2000 and (x.n_ids, x.ids_crc32, x.n_chars, x.round_trip) == (len(ids) // 4, zlib.crc32(ids), len(text), True)


def test_in_spark(spark):
    r = random.Random(9)
    texts = [None, "", " ", "a▁b", "<s> </s>"] + [random_text(r, r.choice([5, 80, 1500])) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[9], 1, "x"), (7, texts[7], 1, "x")], "doc_id long, text string, chunk int, key string")
    out = sc.encode_decode(spark, df, giant=150, chunk=70, span=4).collect()
    assert len(out) == len(texts) + 2 and any(x.chunks > 3 for x in out)
    for x in out:
        t = (texts[9 if x.doc_id is None else x.doc_id]) or ""
        ids = library(t)
        assert (x.n_ids, x.ids_crc32, x.n_chars, x.round_trip) == (len(ids) // 4, zlib.crc32(ids), len(t), True)
    assert sc.encode_decode(spark, df.limit(0)).count() == 0
