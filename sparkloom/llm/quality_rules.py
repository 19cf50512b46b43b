"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

A base rule rejects short and self-repeating documents. Beyond it stands a ladder of rungs, loosest
first; a rung has a cutoff for each feature of FEATURES and rejects a document if any feature is
above its cutoff, so a rung's risk is that of all its features together. For every stratum, rungs
are tested on the labelled documents of good quality that the base rule keeps: a rung passes if,
were its true rate of false rejection ALPHA, so few rejections as seen would have a binomial chance
of at most DELTA / strata - the exact one-sided Clopper-Pearson bound, with Bonferroni's correction
over strata. Along the ladder tests stop at the first failure, so no correction is needed there
and, with confidence 1 - DELTA, every passing rung of every stratum rejects at most ALPHA of its good
documents. Being safe together, any of them may be chosen: the one with the largest number of bad
documents rejected, each good one rejected counting as COST bad ones, and the loosest of such; none,
if that number isn't above 0.

A stratum with fewer good documents than even no false rejection among them could certify,
log(DELTA / strata) / log(1 - ALPHA), is pooled with all other such ones, and the bound holds for
their mixture instead. If their pool is too small as well, only the base rule judges them, as it
does strata without labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored

ALPHA, DELTA, COST = 0.05, 0.05, 10
#: Cutoffs of each feature, one a rung, loosest first; a document is rejected if its value is above.
FEATURES = {
    "symbols": [3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "shouts": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "dup_lines": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4],
    "repeats": [0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3, 0.28],
    "word_length": [60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.0],
}
RUNGS = len(FEATURES["symbols"])
#: Space as in the word pattern [^\x20\x09-\x0D]+, for a regular expression and for trimming.
_GAP, _BLANK = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def repeated_words(hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, given the array of the words' hashes.

    The windows' hashes are sorted as plain longs; only where two are equal are they sorted again
    with their places, and equal neighbours give the places whose words count.
    """
    n = F.greatest(F.size(hashes) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(hashes, 3, n), lambda a, b: F.xxhash64(a, b))


def covered(windows: Column) -> Column:
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.greatest(F.size(windows) - 1, F.lit(0))
    equal = F.zip_with(F.slice(placed, 1, n), F.slice(placed, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    return F.size(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    """Counts of each document: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_shouts."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bare", F.btrim("text", F.lit(_BLANK)))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", _GAP))
    d = d.select(
        "doc_id",
        "stratum",
        words.alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "").alias("lines"),
    )
    d = d.select(
        "doc_id",
        "stratum",
        "n_symbols",
        "n_shouts",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    d = d.withColumn("windows", repeated_words(F.col("hashes"))).drop("hashes")
    sorted_windows = F.sort_array("windows")
    d = d.withColumn("n_distinct", F.size(F.array_distinct(sorted_windows)))
    repeats = F.when(F.col("n_distinct") == F.size("windows"), F.lit(0)).otherwise(covered(F.col("windows")))
    d = d.withColumn("n_repeat_words", repeats.cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_lines", "n_shouts")


def feature_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "shouts": F.col("n_shouts") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The logarithm of P(X <= k) for X binomial with n trials of chance p, term by term in logarithms."""
    n = n.cast("double")
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(acc["total"], term) - high))).alias("total"))

    ks = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k))
    return F.aggregate(ks, start, step, lambda acc: acc["total"])


def rung(values: dict[str, Column]) -> Column:
    """The first rung that rejects a document, 1 to RUNGS; beyond it if none does."""
    firsts = [sum((F.when(values[f] > c, 0).otherwise(1) for c in cuts), F.lit(1)) for f, cuts in FEATURES.items()]
    return F.least(*firsts)


def first_rungs(labelled: DataFrame) -> DataFrame:
    """stratum, first (rung that rejects), n_good, n_bad of documents: a row a stratum and rung. labelled: the base rule's survivors with columns of measured() and good (boolean)."""
    told = labelled.select("stratum", "doc_id", rung(feature_values()).alias("first"), "good").distinct()  # repeated rows count once
    return told.groupBy("stratum", "first").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))


def thresholds(counts: DataFrame, alpha: float, delta: float, cost: float = COST) -> DataFrame:
    """stratum, chosen (a rung): one row for each stratum that has one. counts: first_rungs()'s rows."""
    goods = counts.groupBy("stratum").agg(F.sum("n_good").alias("goods"))
    strata = goods.agg(F.count("*").alias("strata"))
    least = F.log(F.lit(delta) / F.col("strata")) / F.log1p(F.lit(-alpha))
    pools = goods.join(F.broadcast(strata)).select("stratum", "strata", F.when(F.col("goods") >= least, F.struct(F.lit(False).alias("pooled"), F.col("stratum").alias("name"))).otherwise(F.struct(F.lit(True).alias("pooled"), F.lit("").alias("name"))).alias("pool"))
    # One row for each pool and rung, with what the rung rejects; a pool has RUNGS + 1 counts at most.
    per = counts.join(F.broadcast(pools), "stratum").groupBy("pool", "strata", "first").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
    along = W.partitionBy("pool").orderBy("rung").rowsBetween(W.unboundedPreceding, 0)
    rungs = per.groupBy("pool", "strata").agg(F.sum("n_good").alias("n"), F.collect_list(F.struct("first", "n_good", "n_bad")).alias("of"))
    up_to = lambda c: F.aggregate("of", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["first"] <= F.col("rung"), x[c]).otherwise(0))
    rungs = rungs.withColumn("rung", F.explode(F.sequence(F.lit(1), F.lit(RUNGS)))).select("pool", "strata", "n", "rung", up_to("n_good").alias("k"), up_to("n_bad").alias("caught"))
    # Above its mean a binomial's tail is no small chance, so such a k fails without a sum.
    tail = F.when(F.col("k") >= F.col("n") * alpha, F.lit(0.0)).otherwise(log_binomial_tail(F.col("k"), F.col("n"), alpha))
    tested = rungs.withColumn("passes", F.min(tail <= F.log(F.lit(delta) / F.col("strata"))).over(along))
    gain = F.col("caught") - cost * F.col("k")
    best = tested.where(F.col("passes") & (gain > 0)).groupBy("pool").agg(F.max_by("rung", F.struct(gain.alias("gain"), -F.col("rung"))).alias("chosen"))
    return pools.join(F.broadcast(best), "pool").select("stratum", "chosen")


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: the columns of measured(), kept, and failed_rules: the features above their cutoffs.

    docs: doc_id, text and the stratum's column; labels: doc_id, quality (1 good, 0 bad). Other
    columns are ignored. A null text has no words, so it fails the base rule. A null stratum is one
    of its own. A document with several labels is good if any says so; null labels and labels of no
    document are ignored; a row of null doc_id has no label. Repeated rows are judged alike. With
    too few labels no rung passes, and only the base rule rejects. An empty table gives no rows.
    """
    kept = Stored(spark)
    rows = kept.put("qr_rows", measured(docs, stratum))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") >= 1).alias("good"))
    labelled = rows.where("not base_failed").join(known, "doc_id")
    counts = kept.put("qr_first", first_rungs(labelled))
    chosen = kept.put("qr_rung", thresholds(counts, alpha, delta))  # a row a stratum
    out = rows.join(chosen, "stratum", "left")
    cut = lambda f: F.element_at(F.array(*[F.lit(c) for c in FEATURES[f]]), F.col("chosen"))
    fails = [F.when(v > cut(f), F.lit(f)) for f, v in feature_values().items()]
    out = out.withColumn("failed_rules", F.array_compact(F.array(*fails)))
    return out.select(*rows.columns, "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
