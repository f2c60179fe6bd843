"""Approximate nearest neighbours by a robust-pruned directed graph, one a shard.

A node's neighbours are proposed by a greedy search for it from the shard's medoid; robust pruning keeps
the nearest, drops what is closer, by the relaxed factor alpha, to a kept one than to the node, and goes
on: edges stay few and diverse. Nodes come in batches of growing size; their reverse edges are pruned the
same way. A query runs a beam search in every shard.

Nearness is the largest inner product: vectors get one more coordinate that makes their norms equal, so
that the inner product with a query orders as the distance does. All queries of a block, and all nodes of
a batch, take their steps together as matrix operations. Scores are exact double-precision inner products.

Every row is indexed, ids of equal vectors under one node. Null, zero and non-finite vectors take no part.
Building a shard of n rows takes n searches of some log n steps, a query one such search a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.vectors import SHARD_VALUES, Distinct, sharded_top_k, usable

DEGREE, BEAM, QUERY_BEAM, ALPHA = 40, 64, 128, 1.2


class PrunedGraph:
    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5):
        norms = (points**2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.x = np.concatenate([points, lift[:, None]], axis=1).astype(np.float32)
        self.sq = (self.x**2).sum(axis=1)
        self.degree, self.alpha = degree, np.float32(alpha**2)
        n = len(points)
        self.links = np.full((n, degree), -1, np.int32)
        self.start = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1)))
        order = np.random.default_rng(seed).permutation(n)
        order = order[order != self.start]
        at, size = 0, 1
        while at < len(order):
            batch = order[at : at + size]
            beams, _, seen = self.search(self.x[batch], beam)
            proposed = np.concatenate([beams, seen], axis=1)
            for cut in range(0, len(batch), 256):
                some = batch[cut : cut + 256]
                self.links[some] = self._pruned(some, proposed[cut : cut + 256])
            self._reverse(batch)
            at += len(batch)
            size = min(max(size * 2, 1), 256)

    def _distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, up to a constant of each query, of rows of node numbers; -1 is infinitely far."""
        near = self.sq[nodes] - 2 * np.matmul(self.x[nodes], q[:, :, None])[:, :, 0]
        return np.where(nodes < 0, np.float32(np.inf), near)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-first walks of all rows of q at once: the beams' nodes, their distances, and the nodes that were expanded."""
        n = len(q)
        nodes = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        nodes[:, 0], open_[:, 0] = self.start, True
        far[:, :1] = self._distances(q, nodes[:, :1])
        expanded = []
        walking = np.arange(n)
        while len(walking):
            first = np.argmax(open_[walking], axis=1)  # beams are sorted: the nearest open node
            of = nodes[walking, first]
            open_[walking, first] = False
            step = np.full(n, -1, np.int64)
            step[walking] = of
            expanded.append(step)
            new = self.links[of]
            known = (new[:, :, None] == nodes[walking][:, None, :]).any(axis=2)
            new = np.where(known, -1, new)
            dist = self._distances(q[walking], new)
            all_nodes = np.concatenate([nodes[walking], new], axis=1)
            all_far = np.concatenate([far[walking], dist], axis=1)
            all_open = np.concatenate([open_[walking], new >= 0], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            row = np.arange(len(walking))[:, None]
            nodes[walking], far[walking] = all_nodes[row, best], all_far[row, best]
            open_[walking] = all_open[row, best] & (nodes[walking] >= 0)
            walking = walking[open_[walking].any(axis=1)]
        return nodes, far, np.array(expanded).T

    def _pruned(self, of: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Robust pruning of each row of proposed nodes (-1 for none) for the node `of` it."""
        proposed = np.sort(np.where(proposed == of[:, None], -1, proposed), axis=1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        far = self._distances(self.x[of], proposed) + self.sq[of][:, None]
        order = np.argsort(far, axis=1, kind="stable")
        row = np.arange(len(of))[:, None]
        nodes, far = proposed[row, order], far[row, order]
        width = max(1, int((nodes >= 0).sum(axis=1).max()))
        nodes, far = nodes[:, :width], far[:, :width]
        x = self.x[nodes]
        between = self.sq[nodes][:, :, None] + self.sq[nodes][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive = nodes >= 0
        kept = np.full((len(of), self.degree), -1, np.int64)
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(alive, axis=1)
            kept[some, k] = nodes[some, pick[some]]
            alive &= ~(some[:, None] & (self.alpha * between[np.arange(len(of)), pick] <= far))
            alive[np.arange(len(of)), pick] = False
        return kept

    def _reverse(self, batch: np.ndarray) -> None:
        """Edges back to the nodes of a batch; full nodes are pruned anew."""
        of = np.repeat(batch, self.degree)
        to = self.links[batch].ravel()
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        of, to = of[order], to[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        extra = np.full((len(targets), int(count.max()) if len(count) else 0), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), count), place] = of
        for cut in range(0, len(targets), 256):
            some = targets[cut : cut + 256]
            both = np.concatenate([self.links[some], extra[cut : cut + 256]], axis=1)
            both = np.where(both == some[:, None], -1, both)
            ranked = np.sort(both, axis=1)[:, ::-1]
            ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
            size = (ranked >= 0).sum(axis=1)
            fits = size <= self.degree
            packed = np.sort(ranked, axis=1)[:, ::-1][:, : self.degree]
            if packed.shape[1] < self.degree:
                packed = np.pad(packed, ((0, 0), (0, self.degree - packed.shape[1])), constant_values=-1)
            self.links[some[fits]] = packed[fits]
            if (~fits).any():
                self.links[some[~fits]] = self._pruned(some[~fits], ranked[~fits])


def _index(k: int, query_beam: int):
    def build(ids: np.ndarray, matrix: np.ndarray):
        kept = Distinct(ids, matrix)
        graph = PrunedGraph(kept.rows)

        def ask(own: np.ndarray, q: np.ndarray):
            nodes, _, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), max(query_beam, k + 1))
            for i in range(len(q)):
                rows = nodes[i][nodes[i] >= 0]
                yield kept.best(int(own[i]), rows, (kept.rows[rows] * q[i]).sum(axis=1), k)

        return ask

    return build


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_values: int = SHARD_VALUES, query_beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose vec_id `every` divides."""
    return sharded_top_k(usable(vectors, nonzero=True), F.col("vec_id") % every == 0, k, shard_values, _index(k, query_beam), "double")
