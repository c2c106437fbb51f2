"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm.common import stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b. (id, component) for every id in a link: the smallest id reachable.

    Each round points every label to the first among itself and its neighbours, follows the pointers twice and merges labels of one end; edges within a label go. The first
    round takes the order of the ids, which settles stars around least ids at once. Each later one orders the labels by a hash of its own; where an
    order is random, a part of the labels that doesn't depend on the graph is left (less than a half on a chain), so that rounds grow with the logarithm of the number
    of ids whatever the links look like, and each round's tables are a part of the last one's. A round writes one table. The
    labels of all rounds are joined at the end, the smallest table first.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = stage(both.select("e.*").distinct(), f"{name}-edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        first = _first(edges, len(rounds))
        labels = _followed(first, first)
        of = lambda x: labels.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: B023, E731
        # Edges between old labels, with the new ones
        merged = stage(edges.join(of("a"), "a").join(of("b"), "b"), f"{name}-merged")
        rounds.append(merged.select(F.col("a").alias("id"), F.col("to_a").alias("to")).distinct())
        edges = merged.filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ends = rounds.pop()
    while rounds:
        ends = _followed(rounds.pop(), ends, "left")
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    return stage(ends.join(least, "to").select("id", "component"), name)


def _first(edges: DataFrame, k: int) -> DataFrame:
    """(id, to): the first of every id and its neighbours in the order of round k."""
    place = lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("h"), F.col(x).alias("to")) if k else F.struct(F.col(x).alias("to"))
    found = edges.groupBy("a").agg(F.min(F.least(place("a"), place("b"))).alias("first"))
    return found.select(F.col("a").alias("id"), F.col("first.to").alias("to"))


def _followed(pointers: DataFrame, further: DataFrame, how: str = "inner") -> DataFrame:
    """pointers (id, to) with their ends moved on along further; ends without one stay with how = left."""
    return pointers.join(further.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", how).select("id", F.coalesce("end", "to").alias("to"))
