"""URL filter: rules first, then trust and distrust that run along host links.

Rules name a host with its subdomains and a path; the longest that fits an url
decides.  The other urls are judged by their host: trust is a personalised
PageRank that starts at hosts whose urls the rules allow and follows links,
distrust starts at hosts whose urls they block and follows links backwards (who
links to a blocked host is suspect).  Both are summed as a series: the mass of
a round moves on, damped, until next to nothing moves.  Mass is counted in
whole units, so sums are the same in every order.

Nothing here grows with the pages and is held in one place: urls, hosts, links
and masses stay tables, links are summed before they are shuffled, and every
table that a join meets at a hot key has been written first, so the adaptive
planner can split it.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.session import materialise

UNIT = 1_000_000_000  # units of mass of a host whose urls the rules all allow, or all block
#: Links with a host of their own, up to the end of that host; possessive, so a text is read once.
LINK = r"""(?i)\bhref\s*+=\s*+["']?+\s*+(?:https?:)?//([^/?#"'\s<>]++)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty."""
    return F.coalesce(lowered(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, ``host/path``) pairs as a table: host, path, rule, verdict."""
    rows = [(lowered_rule.partition("/")[0], "/" + lowered_rule.partition("/")[2], lowered_rule, verdict) for verdict, lowered_rule in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule of each url that one fits: host, path, rule, verdict.

    ``urls``: distinct (host, path).  A host is split into its last labels, as
    many as the rule with most labels has; the lengths of the rule paths of
    these are the only prefixes of a path that are looked up, by equality."""
    rules = materialise(rules.where("host is not null and path is not null").dropDuplicates(["host", "path"]))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    lengths = materialise(rules.groupBy(F.col("host").alias("r_host")).agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths")))
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, deepest or 1)
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.reverse(F.slice("labels", F.lit(1), k)), "."))
    hosts = urls.select("host").distinct().where("host != ''").select("host", labels.alias("labels")).select("host", F.explode(tails).alias("r_host"))
    tries = materialise(hosts.join(lengths, "r_host").select("host", "r_host", F.explode("lengths").alias("size")))
    heads = urls.join(tries, "host").where(F.length("path") >= F.col("size")).select("host", "path", "r_host", F.expr("left(path, size)").alias("r_path"))
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "rule", "verdict")
    found = heads.join(known, ["r_host", "r_path"])
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """Edges between different hosts: src, dst and n, the number of pages of src that link to dst."""
    found = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), 1))).alias("to"))
    ends = found.select("src", lowered(F.col("to")).alias("dst")).where("src != '' and dst != '' and src != dst")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Trust and distrust of every host that has any: host, trust, distrust.

    ``seeds``: host, trust, distrust in units.  A host hands its mass on in
    proportion to the links: trust to the hosts it links to, distrust to those
    that link to it.  Ends when the mass on its way is at most ``tolerance`` of
    the seeds, after log(tolerance) / log(damping) rounds at most."""
    out_of = links.groupBy("src").agg(F.sum("n").alias("all"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all"))
    share = (F.col("n") / F.col("all") * damping).alias("share")
    forth = links.join(materialise(out_of), "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), share)
    back = links.join(materialise(into), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), share)
    steps = materialise(forth.union(back))
    moving = materialise(seeds.selectExpr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, mass)", "host").where("mass > 0").select("kind", "host", "mass"))
    total = moving.agg(F.sum("mass")).first()[0] or 0
    seen, left = moving, total
    while left > tolerance * total:
        handed = moving.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        moving = materialise(handed.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"))
        left = moving.agg(F.sum("mass")).first()[0] or 0
        if left:
            seen = seen.union(moving)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    return seen.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html",
    damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    A rule that fits decides.  Else the host is blocked if distrust makes up
    more than ``threshold`` of its trust and distrust together; a host that
    neither reaches is allowed, as are rows whose url is null or has no host.
    A host is a seed by the share of its distinct urls that rules allow or
    block.  Repeated rows stay, an empty table gives an empty result, a null
    html has no links; other columns pass through, but those called host, path,
    rule or verdict are replaced."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"p{k}") for k, c in enumerate(own)], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    urls = materialise(rows.select("host", "path").distinct())
    ruled = materialise(fitting_rules(urls, rules))
    known = materialise(urls.join(ruled, ["host", "path"], "left"))
    of = lambda v: F.floor(F.count(F.when(F.col("verdict") == v, 1)) / F.count(F.lit(1)) * UNIT)
    seeds = known.where("host != ''").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    links = materialise(host_links(pages, host_of(F.col(f"`{url}`")), html))
    ranks = propagate(seeds, links, damping, tolerance)
    suspect = materialise(ranks.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_host")))
    verdict = F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict")
    judged = materialise(known.join(suspect, "host", "left").select("host", "path", "rule", verdict))
    return rows.join(judged, ["host", "path"]).select(*[F.col(f"p{k}").alias(c) for k, c in enumerate(own)], "host", "path", "rule", "verdict")
