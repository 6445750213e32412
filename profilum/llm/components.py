"""Connected components of a table of links by alternating large and small stars.

Every round rewrites the links with one least neighbour per vertex, found by a map-side combined
minimum and joined back, so that a vertex with a third of all links is split like any skewed join.
Rounds are written to the shared folder, which cuts their lineage, and end as soon as all components
are stars, which takes one count of ends per vertex and no further round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.sources.store import write_version


def _towards(links: DataFrame) -> DataFrame:
    """Distinct links with the larger end first."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    # The link to the least neighbour stays, the others lead there.
    return links.join(least, "u").select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))


def _unfinished(links: DataFrame) -> bool:
    """Whether a vertex has a smaller neighbour and another one; if none has, each component is a star around its least vertex."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("ends")).where("least < u and ends > 1").count() > 0


def components(links: DataFrame) -> DataFrame:
    """``vertex, root`` for every end of a link ``u, v``; the root is the least vertex reachable.

    Links with a null end or two equal ends say nothing. No links: no rows.
    """
    current = write_version(_towards(links), "links")
    while _unfinished(current):
        current = write_version(_towards(_small_star(_large_star(current))), "links")
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
