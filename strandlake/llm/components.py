"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut


def _with_least(links: DataFrame) -> DataFrame:
    """Directed links (u, v) with ``m``, the least of u and its neighbours v."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    kept = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        starred.select("u", F.col("m").alias("v"))
    )
    return kept.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (u long, v long).

    ``component`` is the least node reachable. Self links and repeats are
    ignored; an empty input gives no rows. A hub's neighbours are only ever
    summed with a partial aggregate and joined, never gathered. Every round is
    cut to the shared folder, so lineage stays short; ``nodes``, if known, is about
    how many nodes there are and sets the number of files.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), nodes)
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)), nodes)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("connected_components did not settle")
    starred = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return starred.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
