"""Connected components of a table of links, by alternating star contractions.

Each round connects the larger neighbours of every node to its least neighbour, then the smaller ones;
the rounds grow with the logarithm of the longest path. It ends when the links are stars: every node that
has a smaller neighbour has that one neighbour only, and that neighbour has no smaller one. A round counts
the links of its input that break this, so the test is exact and needs no job of its own. Links stay
distributed; the driver sees two counts a round. Joins on a node are salted, so a node with very many links
is spread over several tasks.

Defined results: links from a node to itself and repeated links change nothing; links with a null end are
left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut_counted

SALTS = 8


def _with_least(links: DataFrame) -> DataFrame:
    """u, v and m: the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"])


def _round(links: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The links after one round, their number (n), and odd: the ends of links that kept the input from being stars."""
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    seen = _with_least(links.select(ends).select("x.*"))
    breaks = F.when(F.col("v") < F.col("u"), F.col("v") != F.col("m")).otherwise(F.col("m") != F.col("u"))
    odd = Observation()
    large = seen.observe(odd, F.sum(breaks.cast("long")).alias("odd")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
    following, counted = cut_counted(_with_least(large).select(both).select("x.*").where("u <> v").distinct())
    return following, counted | {"odd": int(odd.get["odd"] or 0)}


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for each node of links(u, v) that isn't the least of its own."""
    now, seen = cut_counted(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while seen["n"]:
        following, seen = _round(now)
        if not seen["odd"]:
            break
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
