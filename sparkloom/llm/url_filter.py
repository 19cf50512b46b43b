"""URL verdicts from rules, and for the rest from trust and distrust carried along links between hosts.

A host whose pages the rules mostly allow is a trusted seed, one whose pages they mostly block a
blocked seed, weighted by those pages. Trust is the personalised PageRank of the trusted seeds along
links; distrust is that of the blocked seeds against the links, so it reaches those who link to bad
hosts. Both run as one table per step (partial sums before each shuffle), written to the shared
folder once, until distrust less trust of any host, as a multiple of the mean host's share, is within
TOLERANCE of its limit. A host is blocked if its distrust, so measured, exceeds its trust by MARGIN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored

DAMPING, MARGIN = 0.85, 0.05
#: In the verdict's units: a share times the number of hosts.
TOLERANCE = MARGIN / 100
MAX_RULES = 1000
#: (verdict, host, path): fixed values of the query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Of equally long ones, the longer host's, then block."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; join longer lists as a table")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    chosen = [F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for fit, (v, h, p) in zip(fits, ordered)]
    return F.coalesce(*chosen) if chosen else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: a page's links to other hosts, with or without a scheme before ``//``, counted once a page and host.

    Links are the href values of <a> and <area> tags, quoted or bare, up to the tag's first ``>``;
    <link> and <base> tags and scripts lead no reader on and don't count.
    """
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a(?:rea)?\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""), 1)
    hosts = F.array_distinct(F.transform(found, lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def host_count(links: DataFrame, seeds: DataFrame) -> int:
    return seeds.select("host").unionByName(links.select(F.col("src").alias("host"))).unionByName(links.select(F.col("dst").alias("host"))).distinct().count()


def steps_needed(hosts: int, damping: float = DAMPING) -> int:
    """Steps after which the rest is surely within TOLERANCE: the first change of both kinds sums to 4 at most, and each step shrinks it by damping."""
    return 2 + math.ceil(math.log(max(1.0, 4 * hosts * damping / (1 - damping) / TOLERANCE)) / -math.log(damping))


def propagate(kept: Stored, links: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = DAMPING, hosts: int | None = None) -> DataFrame:
    """host, trust, distrust: both personalised PageRanks, each summing to 1 where it has a seed and links lose nothing.

    It ends when what all further steps can add to a host (the summed change, times damping / (1 -
    damping), times hosts) is below TOLERANCE, and raises if ``steps`` come first. By default there
    are as many as that needs, whatever the links. hosts: their number, counted if not given.

    links: src, dst, weight; seeds: host, trusted, blocked (weights). What a host without outgoing
    links holds goes back to the seeds with what damping takes.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "weight")
    )
    out = kept.put("uf_out", both.groupBy("kind", "from").agg(F.sum("weight").alias("total")))
    both = kept.put("uf_edges", both.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("weight") / F.col("total")).alias("share")))
    long = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")))).alias("x")).select("x.kind", "host", "x.seed").where("seed > 0")
    totals = long.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = kept.put("uf_seed", long.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")))
    linked = not both.isEmpty()
    if linked and hosts is None:
        hosts = host_count(links, seeds)
    if linked and steps is None:
        steps = steps_needed(hosts, damping)
    goes_on = out.select("kind", F.col("from").alias("host"), F.lit(True).alias("goes_on"))

    def put(rows: DataFrame) -> DataFrame:
        return kept.put("uf_rank", rows.join(goes_on, ["kind", "host"], "left").select("kind", "host", "rank", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))

    rank = put(start.withColumnRenamed("seed", "rank"))
    # What the linked hosts of each kind hold, which a step moves on: one row a kind.
    held = {r.kind: r.held for r in rank.groupBy("kind").agg(F.sum(F.when(F.col("goes_on"), F.col("rank")).otherwise(0.0)).alias("held")).collect()} if linked else {}
    for _ in range(steps if linked else 0):
        moved = both.join(rank, (both["kind"] == rank["kind"]) & (both["from"] == rank["host"])).select(both["kind"], F.col("to").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        given = F.when(F.col("kind") == "trust", damping * held.get("trust", 0.0)).otherwise(damping * held.get("distrust", 0.0))
        back = start.select("kind", "host", (F.col("seed") * (1 - given)).alias("rank"))
        new = put(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        moved_by = F.abs(F.col("n.rank") - F.coalesce("o.rank", F.lit(0.0)))
        sums = new.alias("n").join(rank.alias("o"), ["kind", "host"], "left").groupBy("kind").agg(F.sum(moved_by).alias("change"), F.sum(F.when(F.col("n.goes_on"), F.col("n.rank")).otherwise(0.0)).alias("held")).collect()
        change, held = sum(r.change for r in sums), {r.kind: r.held for r in sums}
        for path in kept.paths["uf_rank"][:-1]:
            kept.paths["uf_rank"].remove(path)
            kept.paths.setdefault("uf_old", []).append(path)
        kept.drop("uf_old")
        rank = new
        if change * damping / (1 - damping) * hosts < TOLERANCE:
            break
    else:
        if linked:
            raise RuntimeError(f"shares of {hosts} hosts did not settle in {steps} steps")
    kept.drop("uf_out", "uf_edges")
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(value("trust"), value("distrust"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, margin: float = MARGIN) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of the host, as multiples of the mean host's share).

    pages: page_id, url, html; other columns are ignored. A url that is null or has no ``://`` has
    an empty host and path: no rule fits it, no link counts, and it is allowed. A null html has no
    links. Repeated pages count and come back once each. An empty table gives no rows.
    """
    kept = Stored(spark)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = urls.withColumn("by", matched(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "by.rule", F.col("by.verdict").alias("told"))
    links = kept.put("uf_link", host_links(pages))
    counts = told.where("host <> ''").groupBy("host").agg(F.count_if(F.col("told") == "allow").alias("a"), F.count_if(F.col("told") == "block").alias("b"), F.count("*").alias("n"))
    counts = kept.put("uf_host", counts)
    seeds = counts.select("host", F.when(2 * F.col("a") > F.col("n"), F.col("a")).otherwise(0).cast("double").alias("trusted"), F.when(2 * F.col("b") > F.col("n"), F.col("b")).otherwise(0).cast("double").alias("blocked"))
    hosts = host_count(links, seeds)
    ranks = kept.put("uf_ranks", propagate(kept, links, seeds, hosts=hosts))
    scores = ranks.select("host", (F.col("trust") * F.lit(hosts)).alias("trust"), (F.col("distrust") * F.lit(hosts)).alias("distrust"))
    scores = kept.put("uf_score", scores.withColumn("bad", F.col("distrust") > F.col("trust") + margin))
    kept.drop("uf_rank", "uf_seed", "uf_link", "uf_ranks", "uf_host")
    verdict = F.coalesce("told", F.when(F.coalesce("bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return told.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), zero("trust"), zero("distrust"))
