"""Consolidating pairwise matches into groups by low-diameter decomposition.

In each round every vertex draws an exponential shift; clusters start to grow earlier the larger the
shift of their centre is, one edge a step, and a vertex belongs to whichever cluster reaches it first. A
vertex' label (arrival, centre) after `steps` steps is the least of its own and its neighbours' labels, each
a step later. Clusters contract to super-vertices, the edges between different ones are the next round's
graph, and the rounds' assignments are composed from the last to the first.

Only joins and pre-aggregated minima: nothing is collected, and vertices of very many edges are salted.
Shifts come from a hash of the vertex and the round, so tasks that run again draw the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.scratch import Scratch
from knotwork.skew import hot_values, salted, spread

#: Rate of the exponential shifts, and the steps a cluster may grow in a round.
BETA, STEPS = 0.1, 3


def _shift(v: str, level: int) -> F.Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.col(v), F.lit(level)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.log(u) / BETA  # minus the shift: the time at which the vertex' own cluster starts


def _grow(both: DataFrame, level: int, steps: int, hot: list) -> DataFrame:
    """v, c: the centre of each vertex of the edges both (a, b), which are there in both directions."""
    labels = both.select(F.col("a").alias("v")).distinct().select("v", F.struct(_shift("v", level).alias("t"), F.col("v").alias("c")).alias("l"))
    edges = salted(both, "a", hot, "b")
    for _ in range(steps):
        sent = edges.join(spread(labels.withColumnRenamed("v", "a"), "a", hot), ["a", "__salt"])
        sent = sent.select(F.col("b").alias("v"), F.struct((F.col("l.t") + 1).alias("t"), F.col("l.c").alias("c")).alias("l"))
        labels = labels.unionByName(sent).groupBy("v").agg(F.min("l").alias("l"))
    return labels.select("v", F.col("l.c").alias("c"))


def connected_groups(spark: SparkSession, pairs: DataFrame, a: str = "a", b: str = "b", steps: int = STEPS, tmp: Scratch | None = None) -> DataFrame:
    """node, root: every node named in a pair, and one node that stands for all nodes linked to it, directly or over others.

    Null ends and pairs of a node with itself link nothing; the latter's node is in no result unless another
    pair names it. Repeated and reversed pairs, circles and ties change nothing; other columns are ignored;
    without pairs there are no rows. The root is one of the group's nodes, not its smallest.
    """
    tmp = tmp or Scratch(spark)
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = tmp.cut(edges.distinct())
    rounds: list[tuple[DataFrame, list]] = []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hot = hot_values(both, "a")
        grown = tmp.cut(_grow(both, len(rounds), steps, hot))
        rounds.append((grown, hot_values(grown, "c")))
        left = grown.select(F.col("v").alias("a"), F.col("c").alias("ca"))
        right = grown.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        crossed = salted(edges, "a", hot, "b").join(spread(left, "a", hot), ["a", "__salt"]).select("ca", "b")
        crossed = salted(crossed, "b", hot, "ca").join(spread(right, "b", hot), ["b", "__salt"]).where("ca <> cb")
        new = tmp.cut(crossed.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        tmp.release(edges)
        edges = new
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    done = rounds[-1][0].select(F.col("v").alias("node"), F.col("c").alias("root"))
    for grown, hot in reversed(rounds[:-1]):
        upper = done.select(F.col("node").alias("c"), "root")
        done = salted(grown, "c", hot, "v").join(spread(upper, "c", hot), ["c", "__salt"], "left").select(F.col("v").alias("node"), F.coalesce("root", "c").alias("root"))
        done = tmp.cut(done)
    return done


def named_groups(spark: SparkSession, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, group_id, n_members of every member (column id; null and repeated ones don't count) of pairs (a, b).

    Ids that are named in pairs but are no members link others and are left out themselves. group_id is the
    smallest id among the members; groups of one member are left out.
    """
    tmp = Scratch(spark)
    roots = connected_groups(spark, pairs, tmp=tmp)
    mine = tmp.cut(members.where("id is not null").select(F.col("id").alias("node")).distinct().join(roots, "node"))
    names = mine.groupBy("root").agg(F.min("node").alias("group_id"), F.count("*").alias("n_members")).where("n_members > 1")
    hot = hot_values(names, "root", "n_members")
    return salted(mine, "root", hot, "node").join(spread(names, "root", hot), ["root", "__salt"]).select(F.col("node").alias("id"), "group_id", "n_members")
