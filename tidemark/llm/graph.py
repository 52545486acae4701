"""Connected components of an edge table, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of each end of ``edges(a, b)``; the component is its smallest id.

    Alternates large-star and small-star rounds until the edges are stars around the
    smallest ids. No neighbour list is ever collected: a round takes minima (partial
    aggregation) and joins, which AQE may split on hot vertices. Edges with a null end
    and loops are ignored.
    """
    e = stored(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now.n, now.x) == state or now.n == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v")).groupBy("id").agg(F.min("component").alias("component"))
        state = (now.n, now.x)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = stored(small.distinct(), "edges")
