"""Connected components of a link table by alternating large-star and small-star rounds.

Large-star links each larger neighbour of a node to the smallest id around it; small-star links a node and its smaller
neighbours to that smallest id. Links stay links, no round emits more of them than it read, and the alternation ends when
every node of a component hangs on its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.session import cut


def large_star(links: DataFrame) -> DataFrame:
    """``links`` are (u, v) with u > v. The result may repeat links."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, cut, and what changes as long as they move: their number and an order-free hash of them."""
    done = cut(links, "links")
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return done, tuple(done.agg(F.count(F.lit(1)), hashed).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links (a, b)``; the component is its smallest id.

    Null ends and links of an id with itself are ignored; repeated links count once; an empty table gives no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = written(links)
    while before[0]:
        links, after = written(small_star(large_star(links)))
        if after == before:
            break
        before = after
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
