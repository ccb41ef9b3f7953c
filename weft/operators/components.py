"""Connected components by alternating large-star and small-star rounds, each written to the shared folder.

A round moves every edge towards the smallest neighbour of its end; after O(log n) rounds all that is left are stars whose
centres are the smallest nodes. Rounds use minimum aggregates (combined before the shuffle) and equi-joins whose skewed
partitions Spark can split, so a node with very many neighbours is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize


def _toward(pairs: DataFrame) -> DataFrame:
    """(v, m) for every (u, v): m is the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (two columns of one ordered type); root is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are ignored; without edges the result is empty.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u", "v").distinct()
    pairs = materialize(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _toward(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = materialize(small, "edges")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    own = loops.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(centres).unionByName(own).groupBy("node").agg(F.min("root").alias("root"))
