"""Connected components of an edge table, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None, *, max_rounds: int = 60) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b); comp is the smallest vertex reachable.

    In each round vertices are ordered by a hash with the round as salt; every vertex
    points at the first of itself and its neighbours, pointers are followed once more, and
    the edges are contracted.  A random order leaves a fraction of the vertices of any
    graph, of chains too, so rounds grow with the logarithm of the size; stars vanish in
    one.  Minima combine before they are shuffled, and a hub's edges may be split over
    tasks.  Rounds are cut by tables written to the shared folder, which go when the result
    is written (to ``scratch``, where given).  Loops and repeated edges are allowed; null
    ends are dropped.
    """
    rounds = Scratch(edges.sparkSession, "components")
    scratch = scratch or Scratch(edges.sparkSession, "components")
    cut = rounds.table
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(edges.distinct())
    labels = None
    for i in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(rank("a"), F.col("m")).getField("v").alias("p"))
        point = cut(point)
        up = point.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = cut(point.join(up, "p").select("v", F.col("pp").alias("p")))
        pa = parent.select(F.col("v").alias("a"), F.col("p").alias("x"))
        pb = parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        shrunk = edges.join(pa, "a").join(pb, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if labels is None:
            labels = parent.select("v", F.col("p").alias("comp"))
        else:
            step = parent.select(F.col("v").alias("comp"), F.col("p").alias("to"))
            labels = labels.join(step, "comp", "left").select("v", F.coalesce("to", "comp").alias("comp"))
        labels = cut(labels)
        edges = cut(shrunk)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        out = edges.select(F.col("a").alias("v"), F.col("a").alias("comp"))
    else:
        least = labels.groupBy("comp").agg(F.min("v").alias("least"))
        out = labels.join(least, "comp").select("v", F.col("least").alias("comp"))
    out = scratch.table(out, "components")
    rounds.drop()
    return out
