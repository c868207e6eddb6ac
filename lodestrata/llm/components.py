"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id that occurs in links: root is the smallest id reachable, itself included.

    Alternating large-star and small-star steps: each keeps the components as they are and lowers every id's smallest
    neighbour, until each component is a star around its smallest id; that takes a logarithmic number of steps. Loops
    and repeated links change nothing; links with a null end are left out; an empty table gives an empty table.
    """
    edges = links.where(f"{a} < {b} or {a} > {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join's sides are exchanges: adaptive execution can split an id with very many links
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # larger neighbours of u go to u's smallest neighbour
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then u itself and its smaller neighbours go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        # a star: each id has one link, to an id that has none downwards
        ends = after.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        open_ = ends.where("up > 1 or (up > 0 and down > 0)").limit(1).count()
        drop_stored(edges)
        drop_stored(low)
        edges = after
        if not open_:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
