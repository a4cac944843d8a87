"""Connected components by repeated contraction, in DataFrame operations alone.

Each round every vertex points to the neighbour (or itself) of least hash, which is one combining aggregate, so a hub
with any number of neighbours costs its task a constant. Edges are then drawn between the pointed-to vertices and
repeated ones are dropped. Hash order makes long chains shrink by a constant factor a round. Tables of each round go to
the shared folder, so that a lost executor is served from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every vertex of ``edges(src, dst)``; equal roots mean connected.

    Loops and repeated edges do no harm; an empty edge table gives an empty result. Vertices with a null are dropped.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    maps: list[DataFrame] = []
    for turn in range(most_rounds):
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("dst", "src"))
        parent = both.groupBy("id").agg(F.min(order(F.col("to"))).alias("low")).select(
            "id", F.least(F.col("low"), order(F.col("id"))).getField("v").alias("root")
        )
        parent = settle(parent, f"{name}-map")
        maps.append(parent)
        left = parent.select(F.col("id").alias("src"), F.col("root").alias("a"))
        right = parent.select(F.col("id").alias("dst"), F.col("root").alias("b"))
        joined = edges.join(left, "src").join(right, "dst").where("a <> b")
        edges = settle(joined.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), f"{name}-edges")
        if not edges.take(1):
            break
    else:
        raise RuntimeError("components: no end within the rounds allowed")
    result = maps.pop()
    while maps:
        later = result.select(F.col("id").alias("root"), F.col("root").alias("top"))
        result = maps.pop().join(later, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return result
