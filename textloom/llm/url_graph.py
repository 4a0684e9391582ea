"""URL filters: host rules first, then trust and distrust propagated over the link graph between hosts.

Trust is a personalised PageRank from the hosts whose pages the rules allow, along links. Distrust is one
from the hosts whose pages the rules block, against the links: who links to a bad host is suspect. A host's
seed is the share of its pages that an allow (block) rule decides. A page that no rule fits is blocked if
its host's distrust less its trust exceeds a threshold. DataFrame functions only.

A walk goes on from what the last step brought, until that is a small share of its seeds. A host with very
many links has them cut into pieces, so no task holds them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, materialize, small_or_shuffled

#: The rules of the query: (verdict, host/path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
DAMPING = 0.85
#: A walk ends when a step carries no more than this share of the seeds. With 0.85 that takes 86 steps at most.
TOLERANCE = 1e-6
#: Of (distrust - trust) / (1 - damping). A host all of whose pages are blocked by rules has 1, and one that
#: alone links to it 0.85.
THRESHOLD = 0.5
#: Steps whose results are kept side by side before they are added up.
KEPT_STEPS = 8
#: Links of a host in a piece.
PIECE = 1_000_000
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; empty without."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does. Of equally long ones the
    first. For lists of up to some hundred rules: each is a branch of one expression."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain if chain is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, counted before they are shuffled. Relative links stay on
    their host and make no edge."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, piece: int = PIECE) -> DataFrame:
    """host, trust, distrust. ``seeds``: host, allowed, blocked (shares from 0 to 1).

    Both walks run in one frame, told apart by ``walk``: x = (1 - d) seed + d sum(share of the neighbour's
    edges * x of the neighbour), as the sum of what each step brings. A walk at a host without edges ends
    there. What is left out is at most ``tolerance`` / (1 - d) of a walk's seeds."""
    edges = links.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "n"), F.struct(F.lit("distrust").alias("walk"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))).alias("x")).select("x.*")
    edges = materialize(edges, "host-edges")
    degrees = materialize(edges.groupBy("walk", "a").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / piece).alias("pieces")), "host-degrees")
    hubs = small_or_shuffled(materialize(degrees.where("pieces > 1").select("walk", "a", "pieces"), "hubs"))
    edges = materialize(edges.join(hubs, ["walk", "a"], "left").select("walk", "a", "b", "n", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).alias("piece")), "host-edges")
    base = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("walk"), "host", F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("walk"), "host", F.col("blocked").alias("seed")))).alias("x")).select("x.*").where("seed > 0")
    step = materialize(base.select("walk", "host", ((1 - damping) * F.col("seed")).alias("x")), "host-seeds")

    def masses(rows: DataFrame) -> dict[str, float]:
        return {r.walk: r.x for r in rows.groupBy("walk").agg(F.sum("x").alias("x")).collect()}

    start, steps = masses(step), [step]
    while not edges.isEmpty():
        sent = step.withColumnRenamed("host", "a").join(degrees, ["walk", "a"]).select("walk", "a", (damping * F.col("x") / F.col("all")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        step = sent.join(edges, ["walk", "a", "piece"]).groupBy("walk", F.col("b").alias("host")).agg(F.sum(F.col("x") * F.col("n")).alias("x"))
        step = materialize(step, "host-step")
        steps.append(step)
        moved = masses(step)
        if all(moved.get(w, 0.0) <= tolerance * x for w, x in start.items()):
            break
        if len(steps) > KEPT_STEPS:
            steps = [materialize(_summed(steps), "host-ranks")]  # the last step is still to be sent on
    one = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("x")).otherwise(0.0))
    return _summed(steps).groupBy("host").agg(one("trust").alias("trust"), one("distrust").alias("distrust"))


def _summed(steps: list[DataFrame]) -> DataFrame:
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("walk", "host").agg(F.sum("x").alias("x"))


def steps_at_most(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Steps after which no walk can carry more than ``tolerance``."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of ``pages``: the id, host, path, rule, verdict, and ``host_mass``, its host's distrust less
    trust over 1 - damping (null for hosts that nothing reaches). A url that is null or without ``://`` has
    an empty host, which no rule and no link reaches: allowed. A null html has no links. Repeated rows stay, and their links count again; other columns are
    ignored."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    ranks = propagate(seeds, host_links(pages.select(url.alias("url"), F.col(html_col).cast("string").alias("html")), "url", "html"), damping, tolerance)
    mass = small_or_shuffled(materialize(ranks.select("host", ((F.col("distrust") - F.col("trust")) / (1 - damping)).alias("host_mass")), "host-mass"))
    out = rows.join(mass, "host", "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("host_mass") > threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.round("host_mass", 6).alias("host_mass"))
