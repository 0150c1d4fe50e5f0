"""The most similar vectors of every vector, by a forest of random-projection trees.

Every vector lies in its home cell and in further cells in the order of one priority queue that all trees
share. Cells are divided into leaves by forests of their own, in the same way. In a leaf all that lie there
are each other's candidates; they are compared in single precision, and those that may be among the nearest
again in double precision from the stored values; the leaves' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.vectors import COPIES, Vectors, by_cell, to_cells, unit, usable
from knotwork.scratch import Scratch

_BLOCK = 512
#: Rows of a leaf that are compared with each other.
LEAF_MOST = 16_000
#: More than single precision can be wrong by in a cosine.
_SLACK = 2e-6


def nearest_in_leaf(names: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine), sorted by query: the k rows of cosine least or more nearest to each row, rounded to 9 decimals, ties by name."""
    u = unit(x)
    f = u.astype(np.float32)
    _, rank = np.unique(names, return_inverse=True)
    repeats = rank.max(initial=-1) + 1 < len(names)
    out = []
    for i in range(0, len(x), _BLOCK):
        s = f[i : i + _BLOCK] @ f.T
        rows = np.arange(len(s))
        s[rows, rows + i] = -2
        if repeats:
            s[rank[i : i + _BLOCK][:, None] == rank[None, :]] = -2
        some = np.flatnonzero(s.max(1, initial=-2) >= least - _SLACK)
        s = s[some]
        floor = np.full(len(some), least - _SLACK, np.float32)
        many = np.flatnonzero((s >= floor[:, None]).sum(1) > k)
        if len(many):
            floor[many] = np.maximum(floor[many], np.partition(s[many], -k, axis=1)[:, -k] - _SLACK)
        a, b = np.nonzero(s >= floor[:, None])
        a = some[a] + i
        c = np.round(np.einsum("ij,ij->i", u[a], u[b]), 9)
        ok = c >= least
        a, b, c = a[ok], b[ok], c[ok]
        by = np.lexsort((rank[b], -c, a))
        a, b, c = a[by], b[by], c[by]
        starts = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, np.int64)
        pos = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        out.append((a[pos < k], b[pos < k], c[pos < k]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(spark: SparkSession, embeddings: DataFrame, models: DataFrame, k: int = 5, least: float = 0.8, leaf_most: int = LEAF_MOST, **index: int) -> DataFrame:
    """model, chunk, near: array of at most k (minus cosine, chunk), the nearest first, for chunks that have any.

    Rows that are not usable, or not the latest of their chunk and model, count for nothing; so do chunks
    without an id and models that models doesn't name. Cosines are rounded to 9 decimals; at equal ones the
    smaller chunk goes first. Of more than k + 1 copies of one direction, in all the table, only those of the
    smallest chunks are searched; the others' nearest are these copies. An empty table gives no rows; other
    columns are ignored. index: sample, cell_rows, cell_most, trees, places of to_cells.
    """
    tmp = Scratch(spark)
    vectors = Vectors(tmp, usable(embeddings, models), max(COPIES, k + 1))
    placed = to_cells(spark, vectors.rows, vectors.counts, least, **index)

    def work(names: pa.Array, x: np.ndarray) -> pa.Table:
        own = np.array(names.to_pylist(), dtype=object)
        a, b, c = nearest_in_leaf(own, x, k, least)
        starts = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[starts, len(a)].astype(np.int32))
        minus = pa.ListArray.from_arrays(offsets, pa.array(-np.round(c * 1e9).astype(np.int64), pa.int64()).cast(pa.int32()))
        return pa.table({"chunk": names.take(pa.array(a[starts])), "minus": minus, "near": pa.ListArray.from_arrays(offsets, names.take(pa.array(b)))})

    # cosines as billionths: whole numbers of four bytes, for these lists are shuffled
    found = by_cell(placed, work, "chunk string, minus array<int>, near array<string>", leaf_most, least)
    pairs = F.arrays_zip(F.flatten(F.collect_list("minus")).alias("minus"), F.flatten(F.collect_list("near")).alias("chunk"))  # a few lists of k a chunk
    found = found.groupBy("model", "chunk").agg(F.slice(F.array_sort(F.array_distinct(pairs)), 1, k).alias("near"))
    found = found.withColumn("near", F.transform("near", lambda n: F.struct((n["minus"] / 1e9).alias("minus"), n["chunk"].alias("chunk"))))
    if not vectors.held.limit(1).count():
        return found
    # a copy that was left out has the nearest of its first copy, all at cosine 1, and that one itself
    found = tmp.cut(found)
    first = found.join(vectors.held.select("model", F.col("first").alias("chunk")).distinct(), ["model", "chunk"])
    first = first.select("model", F.col("chunk").alias("first"), F.array_sort(F.concat(F.array(F.struct(F.lit(-1.0).alias("minus"), "chunk")), "near")).alias("near"))
    others = vectors.held.select("model", "chunk", "first").join(first, ["model", "first"])  # a row of first a copied direction
    near = F.slice(F.filter("near", lambda n: n["chunk"] != F.col("chunk")), 1, k)
    return found.unionByName(others.select("model", "chunk", near.alias("near")))
