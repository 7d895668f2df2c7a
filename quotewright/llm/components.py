"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.store import stored


SALTS = 8  # tasks that the links of one node are dealt to


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the least neighbour ``m`` of ``u``; a node may have a large part of all links."""
    salts = F.array(*[F.lit(i).cast("long") for i in range(SALTS)])
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(least.withColumn("salt", F.explode(salts)), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (u, v: long) reaches.

    Nodes that are the smallest of their component are left out. A round needs two shuffles of the
    remaining links and the number of rounds grows with the logarithm of the links; every round is
    written to the shared folder. Links with a NULL end are ignored.
    """
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
