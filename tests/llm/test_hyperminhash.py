import random
import re

import pytest

from sparkloom.llm import hyperminhash as hm
from sparkloom.llm.hyperminhash import near_duplicates


def brute(rows, k):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def rows():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    out, n = [], 0
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(vocab)
            out.append((n, "\t ".join(own).upper() if r.random() < 0.3 else " ".join(own)))
            n += 1
    chain = [r.choice(vocab) for _ in range(40)]  # neighbours are alike, ends are not
    for _ in range(12):
        out.append((n, " ".join(chain)))
        chain = chain[3:] + [r.choice(vocab) for _ in range(3)]
        n += 1
    hub = [r.choice(vocab) for _ in range(120)]  # variants are like the hub, hardly like each other
    for _ in range(25):
        own = list(hub)
        for _ in range(5):
            own[r.randrange(len(own))] = r.choice(vocab)
        out.append((n, " ".join(own)))
        n += 1
    out.append((n, " ".join(hub)))
    n += 1
    return out + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "É é x y z"), (n + 4, "é é x y z"), (n + 5, "long " + "x" * 100000)]


@pytest.mark.parametrize("k", [2, 5])
def test_same_as_brute_force(spark, k):
    data = rows()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, rep string, key int")
    got = {tuple(r) for r in near_duplicates(spark, df, k).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(data, k)


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c D e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(spark, df, 2).collect()), key=str)
    assert got == sorted([(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (None, 5, None, True)], key=str)


def family(n, length, edits, seed):
    """Near copies of one text: some are alike enough, most are candidates only."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(r.choice(edits)):
            own[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("length,edits", [(40, [3]), (60, [2, 4, 6])])
def test_bucket_of_many_blocks(spark, length, edits):
    data = family(420, length, edits, length)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(spark, df, 2, block=50, group=16).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(data, 2)


def test_confirmed_pairs_grow_with_members(spark, monkeypatch):
    """A round confirms one pair a member at most, however many of a group are candidates."""
    sizes = []
    real = hm.confirm

    def counted(docs, pairs, *rest):
        sizes.append(pairs.count())
        return real(docs, pairs, *rest)

    monkeypatch.setattr(hm, "confirm", counted)
    near_duplicates(spark, spark.createDataFrame(family(300, 40, [3], 1), "doc_id long, text string"), 2, block=100).count()
    assert sizes and all(s <= 300 for s in sizes)


def test_very_long_texts(spark):
    """Megabytes each: near copies and a stranger, in groups that hold one text a side."""
    r = random.Random(21)
    base = [f"w{r.randrange(10**6)}" for _ in range(250_000)]
    near = [f"n{k}" if k % 31 == 0 else w for k, w in enumerate(base)]
    far = [f"f{k}" if k % 7 == 0 else w for k, w in enumerate(base)]
    data = [(5, " ".join(base)), (9, " ".join(near)), (7, " ".join(far)), (8, " ".join(base[:1000]))]
    got = {tuple(x) for x in near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(data, 2) and {x[2] for x in got if x[0] in (5, 9)} == {5}
