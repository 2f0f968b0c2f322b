"""Connected components of an edge table, by alternating large-star and small-star
rounds (Kiveris et al., 2014). Every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _measure(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in ``edges`` (a bigint, b bigint); the component
    is its smallest node. Loops and repeated edges do no harm; edges with nulls are left out."""
    e = edges.selectExpr("greatest(a, b) u", "least(a, b) v").where("a is not null and b is not null").distinct()
    e = written(e, "edges")
    before = None
    while True:
        both = e.where("u <> v").union(e.where("u <> v").selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(small, "edges")
        now = _measure(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
