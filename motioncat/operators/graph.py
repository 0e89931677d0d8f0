"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.session import forget, materialize


def _contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(id, to) of every node of ``edges`` (u, v), and the edges between those: a node goes to the least of itself
    and its neighbours, in an order drawn anew each turn, so that a turn leaves two thirds of the nodes or fewer."""
    place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
    both = edges.select(F.col("u").alias("id"), place("v").alias("p")).unionByName(edges.select(F.col("v").alias("id"), place("u").alias("p")))
    least = both.groupBy("id").agg(F.min("p").alias("p")).select("id", F.least("p", place("id"))["id"].alias("to"))
    least = materialize(least, "targets")
    moved = edges.join(least.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").select("a", "v")
    moved = moved.join(least.select(F.col("id").alias("v"), F.col("to").alias("b")), "v").select("a", "b")
    return least, _proper(moved)


def _proper(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return materialize(ends.filter("u <> v").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for nodes with an edge; the component is its smallest id.

    ``edges`` has (a, b). Each turn moves every node to a neighbour and keeps the edges between the
    places reached, which shrink turn by turn, whatever the order of the ids; then the places are
    handed back down the turns.
    """
    state, targets = _proper(edges), []
    while not state.isEmpty():
        before = state
        least, state = _contracted(before, len(targets))
        targets.append(least)
        forget(before)
    if not targets:
        return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    forget(state)
    places = targets.pop()
    while targets:
        above, below = places, targets.pop()
        on = above.select(F.col("id").alias("to"), F.col("to").alias("_end"))
        places = materialize(below.join(on, "to", "left").select("id", F.coalesce("_end", "to").alias("to")), "places")
        forget(above)
        forget(below)
    least = places.groupBy("to").agg(F.min("id").alias("component"))
    return places.join(least, "to").select("id", "component")
