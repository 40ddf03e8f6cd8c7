"""A byte trie as arrays, stepped for many positions at once."""

from __future__ import annotations

import numpy as np


class Trie:
    #: Nodes whose children are held in a dense table; the others are searched.
    DENSE = 2048

    def __init__(self, tokens: dict[bytes, int]):
        nodes = {b"": 0}
        for t in tokens:
            for i in range(1, len(t) + 1):
                nodes.setdefault(t[:i], len(nodes))
        edges = np.array([(nodes[p[:-1]] << 8) | p[-1] for p in nodes if p], np.int64)
        child = np.array([n for p, n in nodes.items() if p], np.int32)
        order = np.argsort(edges)
        self.edges, self.child = edges[order], child[order]
        #: The token that ends at each node, or -1.
        self.ends = np.full(len(nodes), -1, np.int32)
        for t, i in tokens.items():
            self.ends[nodes[t]] = i
        self.dense = np.full((self.DENSE, 256), -1, np.int32)
        top = self.edges < self.DENSE << 8
        self.dense.reshape(-1)[self.edges[top]] = self.child[top]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, or -1."""
        out = self.dense[np.minimum(node, self.DENSE - 1), byte]
        deep = np.nonzero(node >= self.DENSE)[0]
        if len(deep):
            key = (node[deep].astype(np.int64) << 8) | byte[deep]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            out[deep] = np.where(self.edges[at] == key, self.child[at], -1)
        return out
