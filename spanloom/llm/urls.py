"""URL verdicts: rules first, then trust and distrust that spread over the links between hosts. Built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, checkpoint, hot_rows, join_group, small

#: (verdict, host, path): fits the host and its subdomains, where the url's path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Share of a host's rank that its links pass on.
DAMPING = 0.85
#: A host is blocked when its distrust is above its trust, and at least this share of what all hosts have on average.
FLOOR = 0.5
#: All ranks together are settled to within this share of what FLOOR asks of one host.
SETTLED = 0.01


def steps(within: float) -> int:
    """Steps after which the walk has settled to ``within``: each leaves DAMPING of what the ranks change by, 2 at most in each of two walks."""
    return math.ceil(math.log(within * (1 - DAMPING) / 4) / math.log(DAMPING)) + 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def host_links(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(src, dst, n, blocked): links from pages of one host to another host, and how many of their urls a rule blocks.

    Links without a host stay on theirs and are none.
    """
    url = F.col("link")
    target = F.when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(url)
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: x.startswith("//") | x.contains("://"))).alias("link"))
    placed = links.select("src", host_of(target).alias("dst"), path_of(target).alias("path")).where("dst <> '' and dst <> src")
    return placed.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(rule_of(F.col("dst"), F.col("path"), rules)["verdict"] == "block").alias("blocked"))


def propagate(edges: DataFrame, seeds: DataFrame, within: float = 1e-4) -> DataFrame:
    """(walk, host, rank, own): personalised PageRank per walk over edges (walk, src, share, dst), from seeds (walk, host, seed).

    ``own`` is the part of ``rank`` that a host has as a seed, the rest came over links. Rank that hosts without links
    would pass on goes back to the seeds. Each step is a join and a sum on the host, and is checkpointed. A hub's links
    are dealt to salts, and its rank is copied to each. A change c leaves at most c * DAMPING / (1 - DAMPING) of a walk to come, so the walk ends where
    that is ``within`` or less, for all hosts together. It is an error if it does not.
    """
    seeds = checkpoint(seeds)
    ranks = seeds.select("walk", "host", F.col("seed").alias("rank"), F.col("seed").alias("own"))
    edges = checkpoint(edges)
    if edges.isEmpty() or seeds.isEmpty():
        return ranks
    each = hot_rows(edges.count())
    hubs = checkpoint(edges.groupBy("walk", "src").agg(F.count("*").alias("n")).where(F.col("n") > each).select("walk", "src", F.ceil(F.col("n") / each).cast("int").alias("salts")))  # HOT_GROUPS, at most
    salted = not hubs.isEmpty()
    if salted:
        edges = checkpoint(edges.join(F.broadcast(hubs), ["walk", "src"], "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"))
    for _ in range(steps(within)):
        sent = ranks.select("walk", F.col("host").alias("src"), "rank")
        if salted:
            sent = sent.join(F.broadcast(hubs), ["walk", "src"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        flow = edges.join(sent, ["walk", "src", "salt"] if salted else ["walk", "src"]).groupBy("walk", F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * DAMPING).alias("flow"))
        flow = checkpoint(flow)
        passed = {r[0]: r[1] for r in flow.groupBy("walk").agg(F.sum("flow")).collect()}  # two rows
        back = F.when(F.col("walk") == "trust", F.lit(1 - passed.get("trust", 0.0))).otherwise(F.lit(1 - passed.get("distrust", 0.0)))
        given = seeds.select("walk", "host", (F.col("seed") * back).alias("flow")).withColumn("own", F.col("flow"))
        new = checkpoint(flow.withColumn("own", F.lit(0.0)).unionByName(given).groupBy("walk", "host").agg(F.sum("flow").alias("rank"), F.sum("own").alias("own")))
        change = new.select("walk", "host", "rank").unionByName(ranks.select("walk", "host", -F.col("rank")).toDF("walk", "host", "rank")).groupBy("walk", "host").agg(F.abs(F.sum("rank")).alias("d")).agg(F.sum("d")).first()[0]
        ranks = new
        if change * DAMPING <= within * (1 - DAMPING):
            return ranks
    raise RuntimeError(f"propagate: ranks not settled to {within} after {steps(within)} steps")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A page that a rule fits has the rule's verdict. Trust spreads along links from the hosts more than half of whose
    pages a rule allows, by the number of those. Distrust spreads against links from every host with pages that rules
    block, by their share of its pages; a host that is only linked to has the urls of these links for pages. So whom a
    trusted host links to is trusted, and who links to a blocked host is distrusted. A host's own blocked pages count
    against it where they are more than half; else only what reached it over links does. A host whose distrust passes
    FLOOR and its trust is blocked, and so are its pages that no rule fits; all other pages are allowed. A null url, and
    one without ``://``, has an empty host and path and is allowed; a null html has no links. Repeated pages count each. Other columns are not read; an empty table gives
    an empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("by"))
    hosts = checkpoint(placed.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("by.verdict") == "allow").alias("allowed"), F.count_if(F.col("by.verdict") == "block").alias("blocked")).where("host <> ''"))
    links = checkpoint(host_links(pages.select(host.alias("host"), "html"), rules))
    linked = links.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("n_pages"), F.sum("blocked").alias("blocked")).join(hosts, "host", "left_anti")
    known = checkpoint(hosts.select("host", "n_pages", "blocked").unionByName(linked))
    trusted = hosts.where("2 * allowed > n_pages").select(F.lit("trust").alias("walk"), "host", F.col("allowed").cast("double").alias("n"))
    blocked = known.where("blocked > 0").select(F.lit("distrust").alias("walk"), "host", (F.col("blocked") / F.col("n_pages")).alias("n"))
    seeds = trusted.unionByName(blocked)
    totals = {r[0]: r[1] for r in seeds.groupBy("walk").agg(F.sum("n")).collect()}  # two rows
    seeds = seeds.select("walk", "host", (F.col("n") / F.when(F.col("walk") == "trust", F.lit(totals.get("trust", 1.0))).otherwise(F.lit(totals.get("distrust", 1.0)))).alias("seed"))
    both = links.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = checkpoint(both.groupBy("walk", "src").agg(F.sum("n").alias("all"), F.count("*").alias("n_out")))
    n_hosts = known.count()
    ranks = propagate(join_group(both, out, ["walk", "src"], "n_out", "dst", "inner").select("walk", "src", "dst", (F.col("n") / F.col("all")).alias("share")), seeds, SETTLED * FLOOR / max(1, n_hosts))
    mostly = known.where("2 * blocked > n_pages").select("host", F.lit(True).alias("mostly"))
    counted = F.when(F.col("mostly"), F.col("rank")).otherwise(F.col("rank") - F.col("own"))
    each = ranks.join(mostly, "host", "left").groupBy("host").agg(F.sum(F.when(F.col("walk") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("walk") == "distrust", counted).otherwise(0.0)).alias("distrust"))
    bad = checkpoint(each.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * n_hosts >= FLOOR)).select("host", F.lit("block").alias("spread")))
    if small(bad):
        told = placed.join(F.broadcast(bad), "host", "left")
    else:
        told = join_group(placed, checkpoint(hosts.select("host", "n_pages").join(bad, "host")), ["host"], "n_pages", "page_id")
    return told.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", "spread", F.lit("allow")).alias("verdict"))
