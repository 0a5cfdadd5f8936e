"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule decides. Pages without a rule take the verdict of their host. Edges between hosts are the
links of their pages that name a host (with a scheme or from ``//`` on), and a site's own structure: a host and its parent domain link to each other.
Distrust and trust are personalised PageRank, with the restart at the host itself: of the pages that a walk along
the links (distrust) or against them (trust) comes upon, the share that is blocked or allowed. Pages without a rule
count as neither, and the walk goes on from a host as far as no rule decides its pages, so a host that links to many
and to one blocked host has little distrust; a host or parent domain without pages counts as one, judged by its root. A
host's own shares of blocked and allowed pages are the least that its distrust and trust can be. Rounds go on until every
score is within ``tolerance`` of its limit; a round leaves at most ``damping`` of the error, so they end. A host is blocked if its distrust reaches ``threshold`` and exceeds its trust.

A null url, or one without ``://``, has empty host and path, no edges, and the verdict ``allow``. Null html
has no links. Repeated pages count as often as they stand. Hosts keep their user part and port, if any.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.session import materialize

# The rules of the filter.
BLOCK = (("net", "/"), ("example.com", "/de/"))
ALLOW = (("example.net", "/en/"), ("org", "/fr/"))

DAMPING = 0.85
TOLERANCE = 1e-3
THRESHOLD = 0.5
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s{0,8}=\s{0,8}["']?\s{0,8}(?:[a-z][a-z0-9+.-]{0,15}:)?//([^/?#"'\s<>]++)"""


def host_of(url):
    """Host and path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, SMALL)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, block=BLOCK, allow=ALLOW):
    """(rule, verdict) struct of the longest fitting rule, null if none fits."""
    rules = [(h, p, "block") for h, p in block] + [(h, p, "allow") for h, p in allow]
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n, linked): how often pages of src link to dst, and the links of hosts with their parent domains;
    linked is false for those that no page has."""
    linked = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1)))
    links = pages.where(F.contains("html", F.lit("//"))).select(F.col("host").alias("src"), linked.alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, SMALL).alias("dst")).where("src <> '' and dst <> src")
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    parts = F.split("host", r"\.")
    chain = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("x"),
            F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("y"),
        ),
    )
    hosts = pages.select("host").distinct().where("host like '%_._%'")
    pairs = hosts.select(F.explode(chain).alias("e")).select("e.x", "e.y").distinct()
    site = pairs.select(F.col("x").alias("src"), F.col("y").alias("dst")).union(pairs.select("y", "x"))
    site = site.select("src", "dst", F.lit(1).cast("long").alias("n"), F.lit(False).alias("linked"))
    both = links.withColumn("linked", F.lit(True)).union(site)
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.max("linked").alias("linked"))


def propagate(
    edges: DataFrame, seeds: DataFrame, damping=DAMPING, rounds: int | None = None, by: str = "src", tolerance=TOLERANCE
) -> DataFrame:
    """(kind, host, score): PageRank with restart at seeds (kind, host, mass) along edges (kind, src, dst, n).

    The shares of the edges of one ``by`` make 1: with "src" a host deals out its score, with "dst" a host's
    score is the mean of what it gets, which is what a walk from it against the edges finds. Runs ``rounds`` rounds, or,
    if None, until two rounds in a row show that no score is further than ``tolerance`` from its limit.
    """
    out = edges.groupBy("kind", by).agg(F.sum("n").alias("all"))
    steps = materialize(
        edges.join(materialize(out, "out"), ["kind", by]).select(
            "kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")
        ),
        "steps",
    )
    seeds = materialize(seeds, "seeds")
    start = seeds.select("kind", "host", F.col("mass").alias("score"))
    # from scores of 0 to 1 this many rounds always do; the change over two rounds mostly says so sooner
    most = rounds if rounds is not None else 2 * math.ceil(math.log(tolerance) / math.log(damping) / 2)
    enough = tolerance * (1 - damping**2) / damping**2
    scores = kept = start
    for turn in range(most):
        moved = steps.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        restart = start.withColumn("score", F.col("score") * (1 - damping))
        parts = restart.union(moved).withColumn("old", F.lit(0.0))
        store = turn % 2 or turn == most - 1
        if store:  # the scores of two rounds ago come along, so the change needs no join
            parts = parts.union(kept.select("kind", "host", F.lit(0.0), F.col("score")))
        scores = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
        if store:
            scores = materialize(scores, "scores")
            moves = scores.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] if rounds is None else None
            kept = scores = scores.drop("old")
            if moves is not None and moves <= enough:
                break
        else:
            scores = scores.drop("old")
    return scores


def judge(pages: DataFrame, block=BLOCK, allow=ALLOW, damping=DAMPING, threshold=THRESHOLD, tolerance=TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html)."""
    host, path = host_of(F.col("url"))
    read = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = read.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), block, allow).alias("found"))
    rows = materialize(ruled.select("page_id", "host", "path", "found.rule", "found.verdict"), "pages")
    shares = materialize(rows.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("double")).alias("good"),
        F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("double")).alias("bad"),
    ), "shares")
    links = materialize(host_edges(read), "links")
    unseen = links.select(F.col("dst").alias("host")).distinct().join(shares, "host", "left_anti")
    root = F.coalesce(rule_of(F.col("host"), F.lit("/"), block, allow)["verdict"], F.lit(""))
    known = materialize(
        shares.union(unseen.select("host", (root == "allow").cast("double"), (root == "block").cast("double"))), "known"
    )
    kinds = (("trust", "good", "in"), ("trust_all", None, "in"), ("distrust", "bad", "out"), ("distrust_all", None, "out"))
    mass = F.array(*[
        F.struct(F.lit(k).alias("kind"), (F.col(c) if c else F.lit(1.0)).alias("mass")) for k, c, _ in kinds
    ])
    seeds = known.select("host", F.explode(mass).alias("m")).select("m.kind", "host", "m.mass").where("mass > 0")
    # a domain does not answer for its subdomains unless it links to them
    down = links.where(F.col("linked") | F.col("src").endswith(F.concat(F.lit("."), F.col("dst"))))
    along = {"in": links.select("src", "dst", "n"), "out": down.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")}
    both = None
    for way, flow in along.items():
        # a walk stays in a host as far as rules decide its pages, and where it leads nowhere
        all_ = flow.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("all"))
        ruled = F.col("good") + F.col("bad")
        ends = known.join(all_, "host", "left").select(
            F.col("host").alias("src"), F.col("host").alias("dst"),
            F.when(F.col("all").isNull() | (ruled > 1 - 1e-9), 1.0).otherwise(ruled / (1 - ruled) * F.col("all")).alias("n"),
        ).where("n > 0")
        decided = known.where(ruled > 1 - 1e-9).select(F.col("host").alias("dst"))
        flow = flow.join(decided, "dst", "left_anti").select("src", "dst", F.col("n").cast("double").alias("n")).union(ends)
        names = F.explode(F.array(*[F.lit(k) for k, _, w in kinds if w == way])).alias("kind")
        flow = flow.select(names, "src", "dst", "n")
        both = flow if both is None else both.union(flow)
    scores = propagate(materialize(both, "edges"), seeds, damping, by="dst", tolerance=tolerance)
    sums = scores.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k, _, _ in kinds
    ])
    verdicts = shares.join(sums, "host").select(
        "host", F.greatest("good", F.col("trust") / F.col("trust_all")).alias("trust"),
        F.greatest("bad", F.col("distrust") / F.col("distrust_all")).alias("distrust"),
    )
    verdicts = materialize(verdicts, "verdicts")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    own = F.when(bad, "block").otherwise("allow")
    return rows.join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust"
    )
