"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.store import stored

MAX_ROUNDS = 60  # the steps end after some log^2 of the nodes; more is an error


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them.
    Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return (
        tied.select(F.col("m").alias("x"), F.col("a").alias("y"))
        .unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node of an
    edge (a, b).  Loops and repeated edges do no harm; no edges, no rows."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = edges.agg(*print_of).first()
    for _ in range(MAX_ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = edges.agg(*print_of).first()
        if now == seen:  # stars whose centres are the least nodes
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
