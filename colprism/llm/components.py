"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.llm.shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every linked node and one common node of its component.

    In each round every node moves to the neighbour (or itself) that comes first in an
    order shuffled anew for the round, links follow their ends, and links that became
    loops go.  A shuffled order shrinks chains by a constant factor a round, whatever the
    names of their nodes, and a star of any size is gone after two or three rounds; no
    group is ever collected, since minima are combined before the shuffle.  What each
    round moved is stored, and the moves are composed in the end.

    Null ends and loops are ignored.  No links: no rows.
    """
    left = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(left.distinct())
    moves: list[DataFrame] = []
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("to"))).alias("best")
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("to"))
        move = both.groupBy("a").agg(first).select(F.col("a").alias("node"), F.least("best", own)["to"].alias("to"))
        move = stored(move)
        moves.append(move)
        edges = stored(
            edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = moves[0].withColumnRenamed("to", "root")
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "to")
        result = result.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return result
