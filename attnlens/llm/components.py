"""Connected components of a link table, by rounds of star contraction.

Each round points every node at the smallest label around it (large star), then every node and its
neighbours at the smallest of those (small star); the links shrink to stars in about log(diameter)
rounds.  Links live in the shared folder between rounds; the driver sees whether all are stars, and the hubs: nodes with
so large a share of the links that fewer than HOT_KEYS can be.  Hubs are joined by broadcast, so their links stay spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import HOT_KEYS, cut

#: A node of fewer links is no hub.
LEAST_HUB = 1000
#: Links of a partition: tables of a round are gathered into as few, so that small ones do not leave a file for every shuffle partition in every round.
PART_LINKS = 20_000


def _gathered(df: DataFrame, links: int) -> DataFrame:
    return df.coalesce(max(1, -(-links // PART_LINKS)))


def _around(links: DataFrame) -> DataFrame:
    """``a, low, degree``: the smallest of each node and its neighbours, and how many those are."""
    return _both(links).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("degree"))


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, around: DataFrame) -> DataFrame:
    n = (around.agg(F.sum("degree")).first()[0] or 0) // 2
    hubs = around.where(F.col("degree") > max(LEAST_HUB, 2 * n // HOT_KEYS)).select("a", "low").collect()
    both, low = _both(links).where("b > a"), around.select("a", "low")
    if hubs:
        hot = F.broadcast(links.sparkSession.createDataFrame(hubs, low.schema))
        joined = both.join(hot, "a").unionByName(both.join(hot, "a", "left_anti").join(low, "a"))
    else:
        joined = both.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` has a > b: after a large star a node has few links down."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    joined = links.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (a, b) that is not its component's smallest node.

    Self links and repeated links do not matter; null ends are left out; no links give no rows.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    most = now.count()  # no round has more
    now = _gathered(now, most)
    while True:
        around = cut(_gathered(_around(now), 2 * most))
        # stars: every node is the smallest around it or has one link
        if not around.where("low < a and degree > 1").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = cut(_gathered(_small_star(_large_star(now, around).where("a > b")).where("a > b").distinct(), most))
