"""Blocks of nearby points: a k-d tree over a sample deals points into parts of
bounded size, which tasks compare as arrays. The tree has no bearing on results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sampled points that stand for a leaf of a tree.
SAMPLED = 64


@dataclass(frozen=True)
class Tree:
    """Splits in heap order: node i has the children 2 i and 2 i + 1."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    @staticmethod
    def of(sample: np.ndarray, leaves: int) -> Tree:
        """At least ``leaves`` leaves; each cuts the widest axis at its median."""
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        dims, cuts = np.zeros(1 << depth, int), np.zeros(1 << depth)
        rows = {1: np.asarray(sample, float)}
        for node in range(1, 1 << depth):
            v = rows.pop(node)
            if len(v):
                dims[node] = int((v.max(axis=0) - v.min(axis=0)).argmax())
                cuts[node] = np.median(v[:, dims[node]])
            right = v[:, dims[node]] >= cuts[node]
            rows[2 * node], rows[2 * node + 1] = v[~right], v[right]
        return Tree(dims, cuts, depth)

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """The leaf, from 0, of each row."""
        node, every = np.ones(len(v), int), np.arange(len(v))
        for _ in range(self.depth):
            node = 2 * node + (v[every, self.dims[node]] >= self.cuts[node])
        return node - (1 << self.depth)


def box_distance2(lo: np.ndarray, hi: np.ndarray, from_lo: np.ndarray, from_hi: np.ndarray) -> np.ndarray:
    """Squared distances between boxes (rows against rows, by broadcasting)."""
    gap = np.maximum(0.0, np.maximum(lo - from_hi, from_lo - hi))
    return (gap * gap).sum(axis=-1)


class Forest:
    """Union of nodes 0 .. n - 1; keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            ri, rj = self.root[i], self.root[j]
            new = ri != rj
            if not new.any():
                return
            i, j, ri, rj = i[new], j[new], ri[new], rj[new]
            high, at = np.unique(np.maximum(ri, rj), return_index=True)
            self.edges.append(np.stack([i[at], j[at]], axis=1))
            self.root[high] = np.minimum(ri, rj)[at]
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def links(self) -> np.ndarray:
        return np.concatenate(self.edges) if self.edges else np.empty((0, 2), int)
