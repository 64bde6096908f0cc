"""Connected components of a graph given as edges, by rounds of large and small stars.

A large star hangs every larger neighbour of a node on the smallest one; a small star does the same with the
node and its smaller neighbours. Rounds of both keep the components, and end in stars around their smallest nodes after a number of rounds
that grows with the logarithm of the size. Each round is written to the shared folder, which cuts
the lineage; nothing but counts comes to the driver. A node's smallest neighbour is joined back by broadcast while
there are at most ``BROADCAST_ROWS`` nodes, and beyond that as a table of its own, so that Spark can split a hub.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undulo.llm.common import BROADCAST_ROWS, Tables


def _state(df: DataFrame) -> tuple[int, int]:
    mark = F.bit_xor(F.xxhash64("u", "v"))
    n, x = df.agg(F.count("*"), mark).first()
    return n, x or 0


def components(edges: DataFrame, left: str, right: str, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node and root, the smallest node of its component, for every node that an edge names; ids are longs. store: writes the result
    and reads it back, after which the tables of the rounds are deleted."""
    tables = Tables(edges.sparkSession, "components")

    def with_smallest(arcs: DataFrame, few: bool) -> DataFrame:
        least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return arcs.join(F.broadcast(least) if few else tables.stored(least, "smallest").hint("merge"), "u")

    arcs = edges.filter(F.col(left) != F.col(right))
    arcs = arcs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    turn, name = 0, "arcs"
    arcs = tables.stored(arcs, name)
    state = _state(arcs)
    while state[0]:
        few = 2 * state[0] <= BROADCAST_ROWS
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_smallest(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        if not few:
            large = tables.stored(large, "large")
        hung = with_smallest(large, few)
        small = hung.select("u", F.col("m").alias("v")).unionByName(hung.select(F.col("v").alias("u"), F.col("m").alias("v")))
        turn += 1
        name = f"arcs-after-{turn}"
        arcs = tables.stored(small.filter("u != v").distinct(), name)
        tables.keep(name)
        before, state = state, _state(arcs)
        if state == before:
            break
    roots = arcs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    found = arcs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    if store:
        found = store(found)
        tables.keep()
    return found
