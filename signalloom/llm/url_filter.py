"""URL filter: rules first, link-graph propagation for what no rule fits.

Trust walks along host edges from the hosts of allowed pages (personalised
PageRank); distrust walks against them from the hosts of blocked pages: who
links to a blocked host is suspect. A host is blocked where distrust exceeds
trust. Host edges are the hyperlinks of pages and, both ways, the step between
a host and its parent domain.

Only DataFrame operations: both walks are one table of (host, walk, score) and
one join and one aggregation a round. Every STAGE_EVERY rounds the
host table is written to the shared folder, so lineage stays short and the
planner knows its size, and compared with the one before: rounds go on until
they differ by less than RESIDUAL in all. A round moves at most DAMPING of what
the one before moved, so what is still to come is then less than RESIDUAL / 9.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage

#: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Sum of changes between written tables at which a walk ends (all scores sum to 2 at most), and rounds after which one that goes on is an error.
RESIDUAL, MOST_ROUNDS = 0.05, 120
DAMPING, STAGE_EVERY = 0.75, 8
#: Times its trust that a host's distrust must exceed to be blocked.
TOLERANCE = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])\s*=\s*["']?\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host; empty for a null or a url without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty likewise."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, f"{name}{prefix}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, and steps between a host and its parents."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"))
    weighed = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("child"))
    steps = chain.distinct().select("child", F.regexp_replace("child", r"^[^.]*\.", "").alias("parent")).where(r"parent like '%.%' and parent <> child")
    both = steps.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(steps.select("parent", "child"))
    return weighed.unionByName(both.withColumn("weight", F.lit(1.0)))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds, or as many as leave less than ``residual`` to move. ``seeds``: (host, walk, seed), walk being trust or distrust."""
    ways = edges.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    out = ways.groupBy("walk", "host").agg(F.sum("weight").alias("out"))
    ways = stage(ways.join(out, ["walk", "host"]).select("walk", "host", "to", (F.col("weight") / F.col("out")).alias("share")), "host-ways")
    own = seeds.select("walk", "host", (F.col("seed") * (1 - damping)).alias("score"))
    state, held = seeds.select("walk", "host", F.col("seed").alias("score")), None
    for i in range(1, (rounds or MOST_ROUNDS) + 1):
        moved = state.join(ways, ["walk", "host"]).select("walk", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        state = moved.unionByName(own).groupBy("walk", "host").agg(F.sum("score").alias("score"))
        if i % STAGE_EVERY == 0 or i == rounds:
            state = stage(state, f"host-scores-{i}")
            before, held = held, state
            if before is not None:
                both = state.unionByName(before.withColumn("score", -F.col("score"))).groupBy("walk", "host").agg(F.sum("score").alias("change"))
                moved_since = both.agg(F.sum(F.abs("change"))).first()[0] or 0.0
                drop(before)
                if not rounds and moved_since <= residual:
                    break
    else:
        if not rounds:
            raise RuntimeError(f"trust still moves after {MOST_ROUNDS} rounds")
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0)).alias(walk)
    return state.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    A null url or one without ``://`` has empty host and path, fits no rule and
    is allowed. Equal rows are judged each; a null page_id stays null; an empty
    table gives no rows; a null html has no links; other columns are ignored. A
    host that neither walk reaches, or both equally, is allowed.
    """
    placed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "ruled": verdict})
    judged = ruled.where("ruled is not null and host <> ''")
    counts = judged.groupBy("host", F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("walk")).agg(F.count("*").cast("double").alias("n"))
    totals = counts.groupBy("walk").agg(F.sum("n").alias("total"))
    seeds = stage(counts.join(F.broadcast(totals), "walk").select("host", "walk", (F.col("n") / F.col("total")).alias("seed")), "host-seeds")
    scores = propagate(stage(host_edges(ruled), "host-edges"), seeds)
    doubt = F.col("distrust") > F.col("trust") * TOLERANCE
    out = ruled.drop("html").join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(doubt, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
