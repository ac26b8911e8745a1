"""Connected components of links between ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b long), ``root`` the smallest id reachable.

    Alternating star contraction: larger neighbours, then smaller ones, are hung on the
    smallest id in sight until only stars remain.  Each round is two aggregates with
    map-side combine and two joins that adaptive execution may split, so an id with very
    many links is no bottleneck.  Every round is written to the shared folder.  Null ids
    and self links are ignored.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "links")
    state = _state(edges)
    while state[0]:
        # Larger neighbours of each id move to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # An id and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u != v").distinct())
        edges = saved(small, "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links: equal twice running means that only stars are left."""
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]
