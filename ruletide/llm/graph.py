"""Connected components of a link table, entirely on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, largest: bool) -> DataFrame:
    """One star step: link each node's larger (or smaller) neighbours to the least node around it.

    The least neighbour comes from an aggregate that combines before the shuffle and is joined back, so that a hub with
    most of the links is split like any skewed join.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if largest else edges
    # edges hold a > b, so b are a's smaller neighbours
    least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    joined = both.join(least, both["a"] == least["k"])
    if largest:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the least node of its component.

    edges: columns a, b of one comparable type, in any order, repeats allowed. Alternates large and small star steps until
    the links are stars; each round's links are written to the checkpoint folder, so a lost executor costs one round.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(now)
    while before[0]:  # each round but the last joins stars, so their number of rounds is logarithmic
        now = _star(_star(now, True).checkpoint(), False).checkpoint()  # the small star reads the large one twice
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
