"""Concept and call graphs: neighbours, bounded expansion, personalised PageRank, spectra (GR1-GR13).

Edges stay DataFrames. Only matrices under MATRIX_ROWS nodes, whose size is checked, become one array.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

# Restart probability, iterations, calls kept per direction, weight of a reverse edge, share of relations in a blend.
ALPHA, ITERATIONS, SITES, REVERSE, RELATION_SHARE = 0.15, 10, 20, 0.5, 0.2
MATRIX_ROWS = 2_000


def both_ways(relations: DataFrame) -> DataFrame:
    """GR1: node, other, weight of active relations (from_id, to_id, weight, active), seen from both ends."""
    r = relations.where("active = 1")
    return r.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "weight").unionAll(r.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "weight"))


def two_hop(relations: DataFrame) -> DataFrame:
    """GR2: node, target, via, weight: what is two steps away and not one, over the neighbour of the heaviest product."""
    near = both_ways(relations).where("node <> other").groupBy("node", "other").agg(F.max("weight").alias("w"))
    a, b = near.select("node", F.col("other").alias("via"), F.col("w").alias("w1")), near.select(F.col("node").alias("via"), F.col("other").alias("target"), F.col("w").alias("w2"))
    far = a.join(b, "via").where("node <> target").join(near.select("node", F.col("other").alias("target")), ["node", "target"], "left_anti")
    best = far.groupBy("node", "target").agg(F.min(F.struct((-F.col("w1") * F.col("w2")).alias("minus"), "via")).alias("m"))
    return best.select("node", "target", "m.via", (-F.col("m.minus")).alias("weight"))


def call_edges(sites: DataFrame, sites_each: int = SITES) -> DataFrame:
    """GR4: source, target, weight from call sites (caller, callee, place): 1 along a call, REVERSE against it.

    Of each symbol the first calls in either direction count; an edge that is there both ways keeps the
    greater weight, so the result does not depend on the order of discovery.
    """
    out = Window.partitionBy("caller").orderBy("place", "callee")
    into = Window.partitionBy("callee").orderBy("place", "caller")
    s = sites.where("caller is not null and callee is not null and caller <> callee").groupBy("caller", "callee").agg(F.min("place").alias("place"))
    kept = s.withColumn("o", F.row_number().over(out)).withColumn("i", F.row_number().over(into)).where((F.col("o") <= sites_each) | (F.col("i") <= sites_each))
    e = kept.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit(1.0).alias("weight")).unionAll(kept.select(F.col("callee").alias("source"), F.col("caller").alias("target"), F.lit(REVERSE).alias("weight")))
    return e.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """GR3: node, hop of everything within hops steps of the seeds (node); a frontier never comes back to what was seen."""
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for h in range(1, hops + 1):
        step = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen


def call_graph(sites: DataFrame, seeds: DataFrame, degrees: int = 2, each: int = 5) -> DataFrame:
    """GR3: direction ('up', 'down'), depth, name, other, file, line, snippet of the calls around the seeds (name).

    In each direction the first `each` sites of every symbol of the frontier, by file and line, are results; what they lead to is the
    next frontier unless it was visited, so visits limit the way on but not the results. Snippets stay at depth 0 only.
    """
    parts = []
    for direction, key, to in (("up", "callee", "caller"), ("down", "caller", "callee")):
        seen = frontier = seeds.select("name").distinct()
        w = Window.partitionBy("name").orderBy("file", "line", to)
        for depth in range(degrees):
            hits = sites.where(F.col(to).isNotNull()).join(frontier, F.col(key) == F.col("name")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)
            snippet = F.col("snippet") if depth == 0 else F.lit(None).cast("string")
            parts.append(hits.select(F.lit(direction).alias("direction"), F.lit(depth).alias("depth"), "name", F.col(to).alias("other"), "file", "line", snippet.alias("snippet")))
            frontier = hits.select(F.col(to).alias("name")).distinct().join(seen, "name", "left_anti")
            seen = seen.unionByName(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def personalized_pagerank(spark: SparkSession, edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS) -> DataFrame:
    """GR5: node, score. Seeds (node; repeats count) share the restart; what stands on a node without edges is lost.

    edges: source, target, weight. Each iteration is one join and one pre-aggregated sum; every fourth and the
    last are written, so plans stay short.
    """
    tmp = Scratch(spark)
    n = seeds.count()
    if not n:
        return seeds.select("node", F.lit(0.0).alias("score"))
    start = tmp.cut(seeds.groupBy("node").agg((F.count("*") / n).alias("score")))
    edges = tmp.cut(edges.select("source", "target", "weight"))
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = edges.join(out, "source").select(F.col("source").alias("node"), "target", (F.col("weight") / F.col("total")).alias("share"))
    # kept in the memory or on the disk of the executors as it was divided, so no step shuffles it again; a lost part is made again
    shares = shares.repartition("node").persist(StorageLevel.MEMORY_AND_DISK)
    scores = start
    for i in range(iterations):
        walked = scores.join(shares, "node").select(F.col("target").alias("node"), ((1 - alpha) * F.col("score") * F.col("share")).alias("score"))
        scores = walked.unionByName(start.select("node", (alpha * F.col("score")).alias("score"))).groupBy("node").agg(F.sum("score").alias("score"))
        if i % 4 == 3 or i + 1 == iterations:
            scores = tmp.cut(scores)
    shares.unpersist()
    tmp.release(edges)
    return scores


def relation_matrix(relations: DataFrame) -> DataFrame:
    """GR7: a < b and the greatest weight between them; a node's relation with itself is left out."""
    return relations.where("from_id <> to_id").groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.max("weight").alias("weight"))


def blended(similarity: DataFrame, relations: DataFrame, share: float = RELATION_SHARE) -> DataFrame:
    """GR7: (1 - share) of the similarity (a, b, weight) and share of the relation."""
    r = relation_matrix(relations).withColumnRenamed("weight", "relation")
    j = similarity.join(r, ["a", "b"], "full_outer")
    return j.select("a", "b", ((1 - share) * F.coalesce("weight", F.lit(0.0)) + share * F.coalesce("relation", F.lit(0.0))).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """GR8: the Laplacian's diagonal: the sum of the positive weights of each node's edges (a, b, weight)."""
    w = F.greatest(F.lit(0.0), F.col("weight"))
    return edges.select(F.col("a").alias("node"), w.alias("w")).unionAll(edges.select(F.col("b").alias("node"), w.alias("w"))).groupBy("node").agg(F.sum("w").alias("degree"))


def _matrix(edges: DataFrame) -> tuple[list, np.ndarray]:
    nodes = [r[0] for r in edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().orderBy("n").limit(MATRIX_ROWS + 1).collect()]
    if len(nodes) > MATRIX_ROWS:
        raise ValueError(f"more than {MATRIX_ROWS} nodes: take communities of the graph instead")
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges.select("a", "b", "weight").collect():  # at most MATRIX_ROWS squared
        if a != b:
            m[at[a], at[b]] = m[at[b], at[a]] = max(m[at[a], at[b]], max(0.0, w))
    return nodes, m


def laplacian(matrix: np.ndarray) -> np.ndarray:
    w = np.maximum(0, matrix) * (1 - np.eye(len(matrix)))
    return np.diag(w.sum(1)) - w


def fiedler(matrix: np.ndarray) -> float:
    """GR9: the second smallest eigenvalue of the Laplacian; 0 for fewer than two nodes."""
    return float(np.linalg.eigvalsh(laplacian(matrix))[1]) if len(matrix) > 1 else 0.0


def kmeans(x: np.ndarray, k: int, seed: int = 11, rounds: int = 50) -> np.ndarray:
    """GR10: labels; as many clusters as rows or more: each its own."""
    n = len(x)
    if k >= n:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(n)]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(n, p=d / d.sum())] if d.sum() > 0 else x[rng.integers(n)])
    c, labels = np.array(centres), np.full(n, -1)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(k)])
    return labels


def spectral_labels(matrix: np.ndarray, most: int | None = None, seed: int = 11) -> np.ndarray:
    """GR11: clusters by the largest gap of the Laplacian's eigenvalues; under .1 of a gap two clusters. Labels are those of the smallest member."""
    n = len(matrix)
    if n < 2:
        return np.zeros(n, int)
    values, vectors = np.linalg.eigh(laplacian(matrix))
    limit = min(most or max(2, n // 2), n)
    gaps = [values[i + 1] - values[i] for i in range(1, min(limit, n - 1))]
    k = int(np.argmax(gaps)) + 2 if gaps and max(gaps) >= 0.1 else 2
    x = vectors[:, :k]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    labels = kmeans(np.divide(x, length, out=np.zeros_like(x), where=length > 0), k, seed)
    return np.array([np.flatnonzero(labels == label)[0] for label in labels])


def spectral_clusters(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, cluster (the smallest node of it) of a graph (a, b, weight) of at most MATRIX_ROWS nodes; more is an error."""
    nodes, m = _matrix(edges)
    labels = spectral_labels(m)
    kind = edges.schema["a"].dataType.simpleString()
    return spark.createDataFrame([(nodes[i], nodes[labels[i]]) for i in range(len(nodes))], f"node {kind}, cluster {kind}")


def fiedler_value(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return spark.createDataFrame([(round(fiedler(_matrix(edges)[1]), 6),)], "fiedler double")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """AG12: the mean vector of each group, component by component; partial sums keep hot groups small."""
    e = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def medoids(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """GR13: the member of each group that is nearest to its centroid by squared distance, ties by key."""
    c = centroids(vectors, group, vector)
    d = F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(c, group).withColumn("d", d).groupBy(group).agg(F.min(F.struct(F.round("d", 9).alias("d"), F.col(key).alias("k"))).alias("m")).select(group, F.col("m.k").alias("medoid"), F.round("m.d", 6).alias("distance"))


def lore_residuals(similarities: DataFrame, labels: DataFrame) -> DataFrame:
    """GR12: 1 minus the mean blended similarity of each node to the others of its cluster; without any, 0.

    similarities: a, b, weight; labels: node, cluster. Pairs across clusters don't count.
    """
    la, lb = labels.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    same = similarities.join(la, "a").join(lb, "b").where("ca = cb")
    mean = same.select(F.col("a").alias("node"), "weight").unionAll(same.select(F.col("b").alias("node"), "weight")).groupBy("node").agg(F.avg("weight").alias("mean"))
    return labels.join(mean, "node", "left").select("node", "cluster", F.coalesce(1 - F.col("mean"), F.lit(0.0)).alias("lore_residual"))


def disconnected_clusters(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """HS18: a, b: clusters between which no edge (a, b) runs; all pairs are written, so the result grows with the square of the clusters."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    linked = edges.join(la, "a").join(lb, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    c = labels.select("cluster").distinct()
    pairs = c.select(F.col("cluster").alias("a")).join(c.select(F.col("cluster").alias("b")), F.col("a") < F.col("b"))  # not broadcast if there are many
    return pairs.join(linked, ["a", "b"], "left_anti")
