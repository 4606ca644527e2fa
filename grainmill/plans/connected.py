"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregation and a join, so a node with very many links is pre-aggregated and its join
partition can be split; nothing is gathered per node and nothing goes to the driver but a count and a
checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.stored import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("low", "high")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("high"), "low").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low") % 1_000_003)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for every id that has a link; component is the least id reachable.

    Links from a node to itself and null ends are left out; an empty table gives an empty result.
    """
    ends = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND high <> low").distinct()
    now = stored(ends)
    state = _state(now)
    while state[0]:
        new = stored(_small_star(_large_star(now)))
        new_state = _state(new)
        discard(now)
        now = new
        if new_state == state:
            break
        state = new_state
    return now.select(F.col("high").alias("id"), F.col("low").alias("component")).union(now.select("low", "low").distinct())
