"""Exact top-k by an M-tree, one a shard, searched best-first.

Nodes are pages of entries. An entry stores its object, the covering radius of what lies below and its
distance to the page's routing object. A query keeps nodes in a queue by the least distance they can
hold; the stored parent distances rule entries out by the triangle inequality before their distance is
computed. Vectors are integers; one more coordinate makes their norms equal, so that the largest inner
product is the nearest Euclidean neighbour. Bounds carry a slack far above rounding, and what is ranked
are exact integer products, so results are exact, ties included.

Inner products must fit 64 bits. Null and non-finite vectors take no part, zero vectors do. Equal vectors are one object
with all their ids.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.vectors import SHARD_VALUES, Distinct, sharded_top_k, usable

PAGE = 32


class MetricTree:
    """Bulk-loaded from below: objects are grouped to pages, the pages' routing objects again, up to one root."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points = points.astype(np.int64)
        real = points.astype(np.float64)
        norms = (real**2).sum(axis=1)
        self.norm = float(norms.max())
        self.x = np.concatenate([real, np.sqrt(np.maximum(self.norm - norms, 0))[:, None]], axis=1)
        self.slack = 1e-6 * (1 + np.sqrt(self.norm))
        # a node: (object numbers, child nodes or -1, covering radii, distances to the node's routing object)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        objects, children, radii = np.arange(len(points)), np.full(len(points), -1), np.zeros(len(points))
        while True:
            groups = self._grouped(objects, page)
            up = [self._node(objects[g], children[g], radii[g]) for g in groups]
            objects, children, radii = (np.array(c) for c in zip(*up, strict=True))
            if len(groups) == 1:
                break
        self.root, self.root_object = int(children[0]), int(objects[0])

    def _grouped(self, objects: np.ndarray, page: int) -> list[np.ndarray]:
        """Halves around two far objects, until a group fits a page."""
        done, open_ = [], [np.arange(len(objects))]
        while open_:
            g = open_.pop()
            if len(g) <= page:
                done.append(g)
                continue
            x = self.x[objects[g]]
            a = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
            b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
            order = np.argsort(x @ (b - a), kind="stable")
            half = -(-len(g) // page) // 2 * page
            open_ += [g[order[:half]], g[order[half:]]]
        return done

    def _node(self, objects: np.ndarray, children: np.ndarray, radii: np.ndarray) -> tuple[int, int, float]:
        x = self.x[objects]
        routing = int(objects[np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))])
        to_parent = np.sqrt(((x - self.x[routing]) ** 2).sum(axis=1))
        self.nodes.append((objects, children, radii, to_parent))
        return routing, len(self.nodes) - 1, float((to_parent + radii).max())

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Objects, and their products with q, that hold the k highest products of distinct objects and all ties with the last."""
        real = np.append(q.astype(np.float64), 0.0)
        near: list[float] = []  # the k least distances, negated
        found: list[np.ndarray] = []
        ahead = [(0.0, self.root, float(np.sqrt(((self.x[self.root_object] - real) ** 2).sum())))]
        self.computed = 1
        while ahead:
            least, node, to_routing = heapq.heappop(ahead)
            limit = (-near[0] if len(near) == k else np.inf) + self.slack
            if least > limit:
                break
            objects, children, radii, to_parent = self.nodes[node]
            able = np.abs(to_routing - to_parent) - radii <= limit
            objects, children, radii = objects[able], children[able], radii[able]
            self.computed += len(objects)
            far = np.sqrt(((self.x[objects] - real) ** 2).sum(axis=1))
            if len(children) and children[0] < 0:
                inside = far <= limit
                found.append(objects[inside])
                for d in far[inside]:
                    if len(near) < k:
                        heapq.heappush(near, -d)
                    elif d < -near[0]:
                        heapq.heapreplace(near, -d)
            else:
                for c, d, r in zip(children.tolist(), far.tolist(), radii.tolist(), strict=True):
                    if d - r <= limit:
                        heapq.heappush(ahead, (max(d - r, 0.0), c, d))
        objects = np.concatenate(found) if found else np.empty(0, np.int64)
        products = self.points[objects] @ q.astype(np.int64)
        if len(products) > k:
            keep = products >= np.partition(products, len(products) - k)[len(products) - k]
            objects, products = objects[keep], products[keep]
        return objects, products


def _index(k: int):
    def build(ids: np.ndarray, matrix: np.ndarray):
        kept = Distinct(ids, matrix.astype(np.int64))
        tree = MetricTree(kept.rows)

        def ask(own: np.ndarray, q: np.ndarray):
            for i in range(len(q)):
                rows, scores = tree.search(q[i].astype(np.int64), k + 1)  # one more: the query's own row may be among them
                yield kept.best(int(own[i]), rows, scores, k)

        return ask

    return build


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard_values: int = SHARD_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose vec_id `every` divides; components are floor(scale * x)."""
    whole = usable(vectors, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    return sharded_top_k(whole, F.col("vec_id") % every == 0, k, shard_values, _index(k), "long")
