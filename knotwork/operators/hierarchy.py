"""Parent-child links to full hierarchies, by contraction.

Each partition follows its own links as far as they stay inside: a node's chain ends at a root, in a
circle, or at a gate, the first node that lies in another partition. The distinct gates form the quotient
forest, which is solved in the same way until it fits one partition; then the gates' answers are put in
front of the fragments.

First nodes are placed by ranges of ids, for ids that carry their time of birth are often near those of
their parents. A quotient is placed by stars: a coin is thrown for each node, and where the parent's shows
heads and the node's own tails, the node goes to its parent's partition. So a quarter of all links, however
scattered, is contracted at each level, and the levels' sizes fall like a geometric series.

Gates are looked up once each, answers are brought back per (partition, gate), and nodes whose parent is
that of very many stay where they are, so a parent with a third of all nodes below it is nowhere one
task's group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.scratch import Scratch
from knotwork.skew import hot_values

LINK, ROOT, CIRCLE = 0, 1, 2
#: Nodes that one task contracts; about 100 bytes each, and their paths.
FRAGMENT_ROWS = 100_000
_FRAGMENT = "id string, pid int, kind int, gate string, last string, dist long, root string, path array<string>"


def _contract(paths: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        n, ids = len(rows), pd.Index(rows["id"])
        parent = ids.get_indexer(rows["parent"].where(rows["parent"].notna(), ""))
        ends = rows["kind"].to_numpy() != LINK
        inside = (parent >= 0) & ~ends
        to, dist = np.where(inside, parent, np.arange(n)), np.where(inside, rows["w"].to_numpy(), 0)
        for _ in range(math.ceil(math.log2(n + 1)) + 1):
            dist, to = dist + dist[to], to[to]
        circle = inside[to]  # after so many steps only circles are still inside
        kind = rows["kind"].to_numpy()[to]
        kind = np.where(circle, CIRCLE, kind)
        w_end, is_link = rows["w"].to_numpy()[to], kind == LINK
        out = pd.DataFrame({"id": rows["id"], "pid": rows["pid"], "kind": kind.astype("int32")})
        pick = lambda name, where: pd.Series(np.where(where, rows[name].to_numpy(dtype=object)[to], None))
        out["gate"], out["last"] = pick("parent", is_link), pick("last", is_link)
        out["dist"] = np.where(kind == CIRCLE, 0, dist + w_end)  # to the gate, or the depth
        out["root"] = pick("root", kind == ROOT)
        out["path"] = None
        if paths:
            own, done = rows["path"].to_numpy(), np.empty(n, object)
            for i in np.lexsort((dist,)):
                done[i] = [] if circle[i] or kind[i] == CIRCLE else [*done[parent[i]], *own[i]] if inside[i] else list(own[i])
            out["path"] = done
        yield out

    return run


def _placed(nodes: DataFrame, count: int, rows: int, level: int) -> DataFrame:
    """nodes in partitions of about rows, and the number of each one's partition, pid."""
    parts = max(1, math.ceil(count / rows))
    if parts == 1:
        placed = nodes.coalesce(1)
    elif level == 0:
        placed = nodes.repartitionByRange(parts, "id")
    else:
        hot = hot_values(nodes.where(F.col("kind") == LINK), "parent")
        heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 0
        joins = (F.col("kind") == LINK) & heads("parent") & ~heads("id") & (~F.col("parent").isin(hot) if hot else F.lit(True))
        placed = nodes.withColumn("star", F.when(joins, F.col("parent")).otherwise(F.col("id"))).repartition(parts, "star").drop("star")
    return placed.withColumn("pid", F.spark_partition_id())


def _solve(nodes: DataFrame, tmp: Scratch, rows: int, paths: bool, level: int = 0) -> DataFrame:
    """id, kind, root, depth, path of nodes (id, kind, parent, last, w, root, path)."""
    count = nodes.count()
    frag = tmp.cut(_placed(nodes, count, rows, level).mapInPandas(_contract(paths), _FRAGMENT))
    gates = frag.where(F.col("kind") == LINK).select(F.col("gate").alias("g")).distinct()
    looked = tmp.cut(gates.join(frag, F.col("g") == F.col("id"), "left").select("g", "id", "kind", "gate", "last", "dist", "root", "path"))
    absent = looked.where("id is null").select(F.col("g").alias("absent"))
    q = looked.where("id is not null").join(absent, F.col("gate") == F.col("absent"), "left")
    lost = F.col("absent").isNotNull()  # the chain ends at a parent that is no node: the node before it is the root
    q = tmp.cut(
        q.select(
            F.col("g").alias("id"),
            F.when(lost, ROOT).otherwise(F.col("kind")).cast("int").alias("kind"),
            F.when(~lost, F.col("gate")).alias("parent"),
            F.when(~lost, F.col("last")).alias("last"),
            (F.col("dist") - lost.cast("long")).alias("w"),
            F.when(lost, F.col("last")).otherwise(F.col("root")).alias("root"),
            "path",
        )
    )
    size = q.count()
    if size and q.where(F.col("kind") == LINK).limit(1).count():
        solved = _solve(q, tmp, rows, paths, level + 1)
    else:
        solved = q.select("id", "kind", "root", F.col("w").alias("depth"), "path")
    answer = looked.where("id is null").select(F.col("g").alias("a"), F.lit(None).cast("int").alias("a_kind"), F.lit(None).cast("string").alias("a_root"), F.lit(-1).cast("long").alias("a_depth"), F.lit(None).cast("array<string>").alias("a_path"))
    answer = answer.union(solved.select("id", "kind", "root", "depth", "path"))
    pairs = frag.where(F.col("kind") == LINK).select("pid", "gate").distinct().join(answer, F.col("gate") == F.col("a")).withColumnRenamed("pid", "a_pid").drop("gate")
    full = frag.join(pairs, (F.col("pid") == F.col("a_pid")) & (F.col("gate") == F.col("a")), "left")
    kind = F.when(F.col("kind") != LINK, F.col("kind")).otherwise(F.coalesce("a_kind", F.lit(ROOT)))
    full = full.select(
        "id",
        kind.cast("int").alias("kind"),
        F.when(F.col("kind") != LINK, F.col("root")).otherwise(F.coalesce("a_root", "last")).alias("root"),
        F.when(F.col("kind") != LINK, F.col("dist")).otherwise(F.col("dist") + F.col("a_depth")).alias("depth"),
        (F.when((F.col("kind") != LINK) | F.col("a_path").isNull(), F.col("path")).otherwise(F.concat("a_path", "path")) if paths else F.col("path")).alias("path"),
    )
    return full.select("id", "kind", F.when(F.col("kind") == ROOT, F.col("root")).alias("root"), F.when(F.col("kind") == ROOT, F.col("depth")).alias("depth"), F.when(F.col("kind") == ROOT, F.col("path")).alias("path"))


def hierarchy(spark: SparkSession, nodes: DataFrame, paths: bool = False, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """id, root_id, depth, path of every node. nodes: id (unique), parent.

    A node without parent, or with one that is no node, is a root: it is its own root at depth 0. path runs
    from the root to the node (null unless paths). A node on a circle or below one, a node that is its own
    parent included, has root_id '', depth -1 and an empty path. Rows without id are left out; of repeated
    ids one row must have been chosen before. An empty table gives no rows; other columns are ignored.
    """
    tmp = Scratch(spark)
    start = nodes.where(F.col("id").isNotNull()).select(
        "id",
        F.when(F.col("parent").isNull(), ROOT).otherwise(LINK).cast("int").alias("kind"),
        "parent",
        F.col("id").alias("last"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("w"),
        F.when(F.col("parent").isNull(), F.col("id")).alias("root"),
        (F.array("id") if paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    start = tmp.cut(start)
    done = _solve(start, tmp, fragment_rows, paths)
    return done.select("id", F.coalesce("root", F.lit("")).alias("root_id"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"), *([F.coalesce("path", F.array().cast("array<string>")).alias("path")] if paths else []))


def descendants(solved: DataFrame) -> DataFrame:
    """ancestor, descendant, distance for each node and each node above it; solved: hierarchy() with paths."""
    up = solved.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("pos", "ancestor"))
    return up.select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def described(solved: DataFrame) -> DataFrame:
    """solved and n_descendants. Counting is pre-aggregated, so a root of very many nodes is no hot group."""
    below = descendants(solved).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_descendants"))
    return solved.join(below, "id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
