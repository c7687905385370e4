"""Connected components of an edge table by large-star and small-star steps.

Every step is joins and aggregations by node; edges and labels stay distributed.
A step's result is written to the shared folder, so lineage stays short.  Minima
by node are combined before they are shuffled; they meet the edges by broadcast
while there are at most BROADCAST_EDGES edges (16 bytes for each), beyond that by a
join whose skewed partitions (the centre of a star) Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


BROADCAST_EDGES = 500_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, root: every node that has an edge to another node, with the smallest node of its component.

    Null ends, loops and repeated edges are ignored; no edges give an empty table."""
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = None, None
    while True:
        now = materialise(pairs)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        few = (lambda t: F.broadcast(t)) if mark[0] <= BROADCAST_EDGES else (lambda t: t)
        large = both.join(few(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(few(first), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
