"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


#: A key with more than 1 / HEAVY of all rows is joined by broadcast; there are at most HEAVY of them.
HEAVY = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Rows joined with the facts of their key, one row each, whose n counts the rows of the key (it is left out); total: all rows.

    The counts of all keys add up to the rows, so at most HEAVY keys hold more than 1 / HEAVY of them: their facts are
    broadcast and their rows stay where they are. All other rows meet their facts by a shuffle.
    """
    is_heavy = F.col("n") * HEAVY > total
    found = facts.filter(is_heavy).drop("n").collect()  # HEAVY rows at most
    heavy = F.broadcast(rows.sparkSession.createDataFrame(found, facts.drop("n").schema))
    if total < HEAVY:  # then every key is heavy
        return rows.join(heavy, key)
    light = facts.filter(~is_heavy).drop("n")
    if not found:
        return rows.join(light, key)
    return rows.join(heavy, key).union(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def least_neighbour(edges: DataFrame, total: int) -> DataFrame:
    """a, b and the least of a's neighbours, for directed edges."""
    return with_facts(edges, edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", total)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b), which need not be distinct: root is the component's least node.

    Every round replaces each node's edges by edges to its least neighbour, first towards larger and then towards
    smaller nodes; a path of n nodes needs about log n rounds. Each round is written to the checkpoint folder. Edges
    with a null end and edges from a node to itself are left out.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    measured = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    while (now := measured(edges)) != state:
        state = now
        both_ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least_neighbour(both_ways, 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).union(edges.groupBy("a").agg(F.min("b").alias("b")))
        large = cut(large.filter("a <> b").distinct())
        small = least_neighbour(large, large.count())
        edges = cut(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
