"""Connected components of a link table by alternating star contraction.

Every round turns each vertex's neighbourhood into a star around its smallest member. Rounds are
written to the shared checkpoint folder; only the number of links and a checksum of them reach the
driver. Neighbourhoods are never collected: their minimum is a map-side combined aggregate that
is joined back, and adaptive execution splits the join where one vertex has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.session import stage


def _minimum(pairs: DataFrame) -> DataFrame:
    """The smallest of a vertex ``a`` and its neighbours ``b``."""
    return pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.where("b > a")
        .join(_minimum(both), "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a > b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` have a > b: a's smaller neighbours and a itself move to the smallest one."""
    low = _minimum(links)
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of one orderable type -> (a, root) for every vertex that has a link.

    ``root`` is the smallest vertex reachable from ``a``. Self links and repeats are allowed; null
    ends are ignored; no links give no rows.
    """
    current = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")
        ).first()
        if mark.n == 0 or mark == seen:
            break
        seen = mark
        current = stage(_small_star(_large_star(current)), "links")
    roots = current.select("b").distinct()
    return current.select("a", F.col("b").alias("root")).union(
        roots.select(F.col("b").alias("a"), F.col("b").alias("root"))
    )
