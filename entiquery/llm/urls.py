"""URL filter: rules on hosts and paths, and trust propagated over the host graph.

Host graph: an edge from a page's host to each host that its html links to (absolute and
scheme-relative ``href``), weighted by the number of such links, and a light edge between a host and its
parent domain in both directions. Pages are reduced to weighted host edges before anything iterates.

Trust is personalised PageRank from trusted seeds along the edges; distrust is the same from blocked seeds
along the *reversed* edges (who links to the blocked shares the blame). Seeds are hosts with pages that an
allow or block rule decides, by their numbers, and blocked hosts with a label of SPAM. A host is
blocked if its distrust exceeds RATIO times its trust; each page follows its longest rule, else its host.

Rounds go on until no host's score moves by more than a share of SETTLED, MOST rounds at the most: so far does blame
travel. Scores are compared as they are, by their ratio (a difference of 1e-9 counts as none), so that a verdict does not
depend on how many hosts share the seeds' weight. Both directions are one table of edges: a round is one join, which Spark can split
where one host has very many links, and one partial aggregate; every TOGETHER rounds end in a table in the shared scratch folder.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict
"allow"; null html has no links; repeated pages count again; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DAMPING, SETTLED, MOST, TOGETHER, RATIO, PARENT_WEIGHT = 0.85, 0.01, 120, 4, 1.0, 0.5
#: Two sums of the same numbers in another order may differ by this share.
SAME = 1e-9
#: Parts of host labels that mark a blocked seed.
SPAM = ["casino", "bets", "pills", "viagra", "porn", "xxx", "payday", "warez"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, as in ``example.com/en/``; it fits the host, its subdomains and longer paths."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, action) of the longest rule that fits, as one expression; for lists of up to some hundred rules."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # longer ones wrap shorter ones
        text, action = F.when(r.fits(host, path), F.lit(r.text)).otherwise(text), F.when(r.fits(host, path), F.lit(r.action)).otherwise(action)
    return text, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts of (host, html) rows, and hosts with their parent domains."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = links.select(F.col("dst").alias("host")).union(pages.select("host")).where("host <> ''").distinct()
    parents = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.([^.]+\..+|[^.]+\.[^.]+)$", 1).alias("parent")).where("parent <> ''")
    up = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(PARENT_WEIGHT).alias("w"))
    down = parents.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(PARENT_WEIGHT).alias("w"))
    return links.where("src <> dst").union(up).union(down).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _shares(edges: DataFrame, start: str, end: str, kind: int) -> DataFrame:
    total = edges.groupBy(start).agg(F.sum("w").alias("total"))
    return edges.join(total, start).select(F.lit(kind).alias("kind"), F.col(start).alias("from"), F.col(end).alias("to"), (F.col("w") / F.col("total")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, settled: float = SETTLED, most: int = MOST) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches, for ``edges`` (src, dst, w) and ``seeds`` (host, good, bad: weights).

    x' = (1 - d) * seed + d * sum(share * x) in each direction; seeds are brought to sum 1.
    """
    edges = shared.materialise(edges)
    shares = shared.materialise(_shares(edges, "src", "dst", 0).union(_shares(edges, "dst", "src", 1)))  # 0: trust, 1: distrust
    sums = seeds.agg(F.sum("good"), F.sum("bad")).first()
    parts = [seeds.where(F.col(c) > 0).select("host", F.lit(k).alias("kind"), (F.col(c) / F.lit(float(total))).alias("x")) for k, (c, total) in enumerate(zip(("good", "bad"), sums)) if total]
    if not parts:
        return seeds.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    base = shared.materialise(reduce(DataFrame.union, parts).groupBy("host", "kind").agg(F.sum("x").alias("x")))
    always = base.select("host", "kind", (F.col("x") * (1 - DAMPING)).alias("x"))
    now = base
    for _ in range(0, most, TOGETHER):
        after = now
        for _ in range(TOGETHER):
            known = after.withColumnsRenamed({"host": "at", "kind": "of"})
            moved = shares.join(known, (F.col("from") == F.col("at")) & (F.col("kind") == F.col("of")))
            moved = moved.select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("x") * DAMPING).alias("x"))
            after = always.union(moved).groupBy("host", "kind").agg(F.sum("x").alias("x"))
        after = shared.materialise(after)
        before = now.withColumnRenamed("x", "before")
        change = after.join(before, ["host", "kind"], "left").agg(F.max(F.abs(1 - F.coalesce("before", F.lit(0.0)) / F.col("x")))).first()[0]
        if now is not base:
            shared.remove(now)
        now = after
        if change is None or change <= settled:
            break
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("x")).otherwise(0.0))
    return now.groupBy("host").agg(score(0).alias("trust"), score(1).alias("distrust"))


def _digits(x: Column) -> Column:
    """Nine significant digits, for display."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.round(x / unit, 8) * unit).otherwise(F.lit(0.0))


def judge(pages: DataFrame, rules: list[Rule], ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    text, action = longest_rule(rules, F.col("host"), F.col("path"))
    judged = rows.select("page_id", "host", "path", text.alias("rule"), action.alias("action"))
    spam = F.col("host").rlike("(^|[.-])(" + "|".join(SPAM) + ")([.-]|$)")
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(count(F.col("action") == "allow").alias("good"), count((F.col("action") == "block") | (F.col("action").isNull() & spam)).alias("bad"))
    score = propagate(host_edges(rows.select("host", "html")), shared.materialise(seeds))
    out = judged.join(score, "host", "left")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("distrust") > ratio * (1 + SAME) * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), _digits(F.col("trust")).alias("trust"), _digits(F.col("distrust")).alias("distrust"))
