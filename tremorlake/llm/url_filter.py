"""URL filters: rules on host and path, and link-graph propagation for what no rule fits.

Personalised PageRank spreads trust from hosts with allowed pages along host edges, and
distrust from hosts with blocked pages along reversed edges; a host with more distrust
than trust is blocked. Edges come from links in the pages (absolute ones; counted by
page), and join a host with its parent domain, both ways. The graph is aggregated to host
pairs before each shuffle, and ranks are cut from their lineage every few rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict on pages of host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The given rules (fixed values).
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
DAMPING, ROUNDS = 0.85, 15


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): pages of src that link to dst; and a host and its parent domain (two labels at least), with weight 1."""
    host = host_of(F.col("url"))
    refs = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)), lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("x:"), x)).otherwise(x))))
    links = pages.select(host.alias("src"), F.explode(refs).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select(host.alias("h")).union(links.select("dst")).distinct().where("h <> ''")
    labels = F.split("h", r"\.", -1)
    # every ancestor joins the chain, so siblings meet in their parent
    chain = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))).alias("h")).distinct()
    up = chain.select(F.col("h").alias("child"), F.array_join(F.slice(F.split("h", r"\.", -1), 2, 2**31 - 1), ".").alias("parent")).where("parent like '%.%'")
    kin = up.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(up.select("parent", "child")).withColumn("w", F.lit(1.0))
    return links.unionByName(kin).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of hosts that seeds (host, kind 0 trusted or 1 blocked, w) reach.

    Kind 0 goes along edges, kind 1 against them; each kind's seeds sum to 1; the mass of
    hosts without a way on returns to the seeds.
    """
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").union(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    step = scratch.save(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("p")))
    total = seeds.groupBy("kind").agg(F.sum("w").alias("total"))
    start = scratch.save(seeds.groupBy("kind", "host").agg(F.sum("w").alias("w")).join(total, "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("s")))
    rank, old = start.select("kind", "host", F.col("s").alias("r")), []
    for i in range(rounds):
        moved = rank.join(step.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("p")).alias("r"))
        sums = moved.groupBy("kind").agg(F.sum("r").alias("kept"))
        base = start.join(sums, "kind", "left").select("kind", "host", (F.col("s") * (1 - damping * F.coalesce("kept", F.lit(0.0)))).alias("r"))
        rank = moved.select("kind", "host", (damping * F.col("r")).alias("r")).union(base).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % 3 == 2 or i == rounds - 1:
            rank = scratch.save(rank)
            old.append(rank)
    scratch.drop(step, start, *old[:-1])
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages (page_id, url, html).

    A host is blocked where distrust > ratio * trust; pages without a host, and hosts that
    nothing reaches, are allowed. Null urls have an empty host and path. Repeated rows stay.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"))
    seeds = ruled.where("ruled is not null and host <> ''").groupBy("host", F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("kind")).agg(F.count("*").cast("double").alias("w"))
    edges = scratch.save(host_edges(pages))
    scores = propagate(edges, seeds, scratch)
    scratch.drop(edges)
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")).alias("verdict"), score("trust"), score("distrust"))
