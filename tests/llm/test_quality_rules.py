import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, words int, hashes string"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    in_repeat = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(in_repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(in_repeat), failed


def texts():
    r = random.Random(2)
    out = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "é é é é", "\n\n x\n x\n\tx\n", "x y z", "<#*$%&|<>!", "a b c d\r\na b c d", "\x0ba\x0c"]
    for _ in range(150):
        vocab = [f"w{i}é" for i in range(r.choice([3, 30, 3000]))] + ["\n", "##", "x|y"]
        out.append(r.choice([" ", "  ", "\t"]).join(r.choice(vocab) for _ in range(r.choice([3, 48, 55, 400]))))
    return out + ["w " * 20000, "y" * 100000]


def test_counts_equal_brute_force(spark):
    data = texts()
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(data)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qr.judged(spark, df, labels).collect()
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rows}
    assert got == {i: counts(t) for i, t in enumerate(data)}
    assert all(x.kept == (not x.base_failed) for x in rows)


def test_binomial_tail(spark):
    def exact(k, n, p):
        return math.log(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))

    cases = [(0, 10, 0.1), (3, 50, 0.1), (7, 900, 0.01), (0, 2000, 0.004)]
    for k, n, p in cases:
        got = spark.range(1).select(qr.log_binomial_tail(F.lit(k).cast("long"), F.lit(n), p)).first()[0]
        assert abs(got - exact(k, n, p)) < 1e-8


def test_thresholds_catch_bad_and_spare_good(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(2400):
        lang = ["en", "de", None][i % 3]
        bad = i % 10 == 0
        words = [f"v{r.randrange(5000)}" + ("***" if bad else "") for _ in range(60)]
        if not bad and i % 400 == 1:
            words[0] += "*" * 30
        rows.append((i, " ".join(words), lang, 0, ""))
        if lang != "de" or i < 300:
            labels.append((i, int(not bad), 0))
    labels += [(1, None, 0), (10**9, 1, 0), (None, 1, 1), (3, 1, 0), (3, 0, 0)]
    df = spark.createDataFrame(rows + [rows[0], (None, rows[1][1], "en", 0, "")], SCHEMA)
    out = qr.judged(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha=0.02).collect()
    assert len(out) == len(rows) + 2
    for x in out:
        if x.doc_id is not None and x.doc_id % 10 == 0 and x.stratum != "de":
            assert not x.kept and x.failed_rules == ["symbols"]
        elif x.doc_id is None or x.doc_id % 10:
            assert x.kept
    assert all(x.kept for x in out if x.stratum == "de")  # too few labels there


def test_empty(spark):
    assert qr.judged(spark, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def chosen_rungs(rows, alpha, delta, cost):
    """The rung of each stratum by whole-number binomials; rows: (stratum, first rung that rejects, good)."""
    strata = {s for s, _, _ in rows}
    sure = lambda n, k: sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) <= delta / len(strata)
    goods = Counter(s for s, _, good in rows if good)
    pool_of = {s: s if sure(goods[s], 0) else "pool" for s in strata}
    out = {}
    for pool in set(pool_of.values()):
        own = [(first, good) for s, first, good in rows if pool_of[s] == pool]
        n, best = sum(g for _, g in own), None
        for rung in range(1, qr.RUNGS + 1):
            k = sum(g for f, g in own if f <= rung)
            if not sure(n, k):
                break
            gain = sum(not g for f, g in own if f <= rung) - cost * k
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, rung)
        if best:
            out |= {s: best[1] for s in strata if pool_of[s] == pool}
    return out


def test_rungs_equal_a_brute_force_clopper_pearson(spark):
    r = random.Random(8)
    for trial in range(6):
        alpha, cost = r.choice([0.02, 0.05, 0.1]), r.choice([1, 3, 10])
        rows = []
        for s, n in (("a", r.choice([30, 400])), ("b", 90), ("", r.choice([20, 700])), ("d", 45)):
            for _ in range(n):
                good = r.random() < 0.8
                rows.append((s, min(qr.RUNGS + 1, max(1, int(r.gauss(12 if good else 6, 1.5 if trial % 2 else 3)))), good))
        counts = Counter((s, f, g) for s, f, g in rows)
        table = [(s, f, counts[s, f, True], counts[s, f, False]) for s, f in {(s, f) for s, f, _ in rows}]
        df = spark.createDataFrame(table, "stratum string, first int, n_good long, n_bad long")
        assert {x.stratum: x.chosen for x in qr.thresholds(df, alpha, 0.05, cost).collect()} == chosen_rungs(rows, alpha, 0.05, cost)


def test_small_strata_are_pooled(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, " ".join(f"v{r.randrange(5000)}" + ("***" if bad else "") for _ in range(60)), ["en", "de", "fr", "es"][i % 4], 0, ""))
        if i < 200:
            labels.append((i, int(not bad)))
    rows.append((1000, rows[0][1], "unheard", 0, ""))
    out = qr.judged(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {x.doc_id for x in out if not x.kept} == {i for i in range(600) if i % 6 == 0}  # no stratum alone has labels enough, their pool has
