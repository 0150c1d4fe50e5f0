"""Forests of random-projection trees over unit vectors, searched through one shared priority queue.

A tree is fitted on a bounded sample. A node tries several random directions and thresholds near the middle
and keeps the split that parts the fewest near pairs of its sample; a node with fewer than twice LEAST sample
rows is a leaf, so no leaf rests on fewer than about LEAST of them and a leaf's share of all rows is known
to within chance.

A row is placed by one queue for all trees. It holds the roots, that of the first tree at distance 0 and
the others at ROOT. The nearest entry is taken out and descended to a leaf; at each node on the way the far
child enters the queue with its distance: the summed squares of the margins that must be crossed to get
there. A row near few borders soon comes to the other trees, one near many looks across them first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TRIES, LEAST = 32, 16
#: The distance at which the roots of all trees but the first enter the queue.
ROOT = 0.004


@dataclass
class Tree:
    """Inner nodes as arrays; a child below 0 is the leaf -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int
    depth: int


def near_pairs(sample: np.ndarray, cosine: float) -> np.ndarray:
    out = []
    for i in range(0, len(sample), 1024):
        a, b = np.nonzero(sample[i : i + 1024] @ sample.T >= cosine)
        keep = a + i < b
        out.append(np.column_stack([a[keep] + i, b[keep]])[:: max(1, keep.sum() // 200_000)])
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def fit(sample: np.ndarray, cells: float, cosine: float, seed: int, pairs: np.ndarray | None = None) -> Tree:
    """One tree of about cells leaves, fewer where the sample is too small for as many."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    pairs = near_pairs(sample, cosine) if pairs is None else pairs
    normals, offsets, children, leaves, deepest = [], [], [], 0, 0
    enough = max(2 * LEAST, 1.4 * len(sample) / max(cells, 1))
    where = np.full(len(sample), -1)

    def grow(idx: np.ndarray, mine: np.ndarray, level: int) -> int:
        nonlocal leaves, deepest
        deepest = max(deepest, level)
        if len(idx) < enough:
            leaves += 1
            return -leaves
        x = sample[idx]
        ends = x[rng.integers(0, len(idx), (2, TRIES))]
        d = ends[0] - ends[1] + 1e-3 * rng.standard_normal((TRIES, dim))
        d = (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)
        proj = x @ d.T
        cut = np.quantile(proj, [0.38, 0.42, 0.46, 0.5, 0.54, 0.58, 0.62], axis=0)
        where[idx] = np.arange(len(idx))
        pa, pb = proj[where[mine[:, 0]]], proj[where[mine[:, 1]]]
        lost = np.array([((pa < c) != (pb < c)).sum(0) for c in cut]).astype(float)
        # among equals the thinnest slab around the cut
        lost += np.array([(np.abs(proj - c) < 0.04).mean(0) for c in cut])
        share = np.array([(proj < c).mean(0) for c in cut])
        lost[(share < 0.25) | (share > 0.75)] += 1e12  # rows alike, that no threshold divides well
        q, k = np.unravel_index(np.argmin(lost), lost.shape)
        left = proj[:, k] < cut[q, k]
        if left.all() or not left.any():
            leaves += 1
            return -leaves
        at = len(normals)
        normals.append(d[k])
        offsets.append(cut[q, k])
        children.append([0, 0])
        sides = left[where[mine[:, 0]]], left[where[mine[:, 1]]]
        children[at][0] = grow(idx[left], mine[sides[0] & sides[1]], level + 1)
        children[at][1] = grow(idx[~left], mine[~sides[0] & ~sides[1]], level + 1)
        return at

    root = grow(np.arange(len(sample)), pairs, 0)
    if root < 0:
        return Tree(np.zeros((0, dim), np.float32), np.zeros(0, np.float32), np.zeros((0, 2), np.int64), 1, 0)
    return Tree(np.array(normals, np.float32), np.array(offsets, np.float32), np.array(children), leaves, deepest)


def fit_forest(sample: np.ndarray, cells: float, cosine: float, trees: int, seed: int = 7) -> list[Tree]:
    pairs = near_pairs(sample, cosine) if cells > 1 else np.empty((0, 2), np.int64)
    return [fit(sample, cells, cosine, seed * 1000 + t, pairs) for t in range(trees)]


def place(forest: list[Tree], x: np.ndarray, places: int, root: float = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """(n, places) tree and leaf of each row of unit vectors in the order of the shared queue, the first being its home; -1 where there are no more leaves."""
    n, trees, rows = len(x), len(forest), np.arange(len(x))
    room = trees + places * max((t.depth for t in forest), default=0)
    distance, node, owner = np.full((n, room), np.inf, np.float32), np.zeros((n, room), np.int32), np.zeros((n, room), np.int8)
    distance[:, :trees], owner[:, :trees] = [0.0] + [root] * (trees - 1), np.arange(trees)
    used = np.full(n, trees)
    to_tree, to_leaf = np.zeros((n, places), np.int64), np.full((n, places), -1, np.int64)
    for p in range(places):
        first = distance.argmin(1)
        far, at, whose = distance[rows, first].copy(), node[rows, first].astype(np.int64), owner[rows, first].copy()
        distance[rows, first] = np.inf
        to_tree[:, p] = whose
        for t, tree in enumerate(forest):
            who = np.flatnonzero((whose == t) & np.isfinite(far))
            k, f = (at[who] if tree.depth else np.full(len(who), -1)), far[who]
            live = np.flatnonzero(k >= 0)
            while len(live):
                r, inner = who[live], k[live]
                m = np.einsum("ij,ij->i", x[r], tree.normals[inner]) - tree.offsets[inner]
                right = (m >= 0).astype(np.int64)
                slot = used[r]
                distance[r, slot], node[r, slot], owner[r, slot] = f[live] + m * m, tree.children[inner, 1 - right], t
                used[r] += 1
                k[live] = tree.children[inner, right]
                live = live[k[live] >= 0]
            to_leaf[who, p] = -1 - k
    return to_tree, to_leaf
