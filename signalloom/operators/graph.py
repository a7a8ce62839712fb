"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage

#: Passes after which a graph that still changes is an error; a pass about halves every path.
PASSES = 64


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (u, v): the least node reachable.

    Large-star and small-star passes until only stars remain; rows never exceed
    the number of links. Each pass is written to the shared folder, so lineage
    doesn't grow. Self-links and repeated links don't matter; no links give no
    rows. A graph that still changes after PASSES passes raises.
    """
    star = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(PASSES):
        sums = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sums[0] or sums == seen:
            break
        seen = sums
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        before, star = star, stage(small, "star")
        drop(before)
    else:
        raise RuntimeError(f"components still change after {PASSES} passes")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
