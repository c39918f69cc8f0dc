"""URL filters: rules on host and path, and trust that spreads over the links between hosts.

A rule decides the pages it fits. For the others a host's standing decides: trust starts at
hosts with allowed pages and follows their links (personalised PageRank), distrust starts at
hosts with blocked pages and follows links backwards, as who links to a blocked host
shares its blame. A host is blocked when its distrust is more than ``ratio`` times its trust;
hosts that neither reaches are allowed.

How it scales: links are counted per pair of hosts before the first shuffle ends, so the
graph has a row per linked pair however many pages there are. Each round of the propagation is one join
of edges with scores and one map-side combined sum, checkpointed in the shared folder. A host that a third of the links lead to is one key of a
sum, which is combined before the shuffle; one that links to very many hosts is one
skewed side of a join, which adaptive execution splits. The pages meet their host's verdict in a
join on the host, whose other side has one row per host.

Defined results: a url that is null or has no ``://`` has an empty host and path and is
allowed; repeated rows are judged alike and all returned; a null html has no links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.operators.staging import stage
from shelfprice.session import enable_checkpoints

HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, _lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and number of links between different hosts; relative links stay on their host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(
        F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        links.where(F.col("link").contains("//"))
        .select("src", host_of(absolute).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank: ``host`` and ``score``, with restarts at ``seeds`` (``host``, ``seed``).

    Edges have ``src``, ``dst`` and ``links``; what reaches hosts without outgoing edges restarts too.
    Scores add up to the sum of the seeds.
    """
    spark = seeds.sparkSession
    enable_checkpoints(spark)
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    if edges.isEmpty():  # scores without edges are the seeds
        return seeds.select("host", F.col("seed").cast("double").alias("score"))
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    weighted = edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("share"))
    start = seeds.select("host", (F.col("seed") / (total or 1.0)).alias("score"))
    scores = start
    for _ in range(rounds):
        moved = (
            scores.join(weighted, F.col("host") == F.col("src"))
            .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
            .checkpoint())
        arrived = moved.agg(F.sum("score")).first()[0] or 0.0  # one number
        restarts = start.select("host", (F.col("score") * (1 - arrived)).alias("score"))
        scores = moved.unionByName(restarts).groupBy("host").agg(F.sum("score").alias("score"))
        scores = scores.checkpoint()
    return scores.select("host", (F.col("score") * total).alias("score"))


def standings(ruled: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``host``, ``trust`` and ``distrust``; ``ruled`` has ``host`` and the rule's verdict of each page, or null."""
    shares = ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.col("rule_verdict") == "allow").cast("double")).alias("good"),
        F.avg((F.col("rule_verdict") == "block").cast("double")).alias("bad"))
    seeds = stage(shares.where("good > 0 OR bad > 0"))
    trust = propagated(seeds.where("good > 0").select("host", F.col("good").alias("seed")), edges, rounds, damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagated(seeds.where("bad > 0").select("host", F.col("bad").alias("seed")), back, rounds, damping)
    return (
        trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
        .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = 3.0, rounds: int = 20,
           damping: float = 0.85) -> DataFrame:
    """Host, path, rule and verdict of every page, with the host's ``trust`` and ``distrust``."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "*", matched_rule(F.col("host"), F.col("path"), rules).alias("match_")).select(
        "page_id", "host", "path", F.col("match_.rule").alias("rule"), F.col("match_.verdict").alias("rule_verdict"))
    edges = stage(host_edges(pages))
    found = standings(rows, edges, rounds, damping).withColumnRenamed("host", "of_host")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return rows.join(found, F.col("host") == F.col("of_host"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
