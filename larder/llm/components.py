"""Connected components of an edge table, by contraction.

Every round, a vertex goes over to the smallest of itself and its neighbours; edges are carried over, and what has become one
edge or a loop goes. So each round joins fewer edges than the one before, and a star needs one. The last vertex left of a
component is its smallest. The way back gives every vertex its label, round by round. Vertices are digests, whose order has
nothing to do with the edges: a share of the vertices goes each round, whatever the graph's shape (a path too). A vertex of
very many edges makes a large partition of the merge join, which Spark splits. Rounds are written to the shared folder; only
whether edges are left goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of edges (a, b); the label is the component's smallest vertex."""
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        ends = left.select(F.col("a").alias("v"), F.col("a").alias("m")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("m")))
        to = materialize(ends.groupBy("v").agg(F.min("m").alias("m")), "contracted")
        rounds.append(to)
        one, two = to.select(F.col("v").alias("a"), F.col("m").alias("x")), to.select(F.col("v").alias("b"), F.col("m").alias("y"))
        moved = left.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter("x <> y")
        after = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = after
    labels = rounds.pop().select("v", F.col("m").alias("label"))
    while rounds:
        to = rounds.pop()
        labels = materialize(to.join(labels.withColumnRenamed("v", "m"), "m", "left").select("v", F.coalesce("label", "m").alias("label")), "labels")
    return labels
