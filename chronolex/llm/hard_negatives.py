"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Vectors are integers; one more coordinate makes the norms of all candidates equal, so that an anchor (which gets 0
there) has its highest inner products with its nearest candidates. Rows are assigned to the cells of pivots. Anchors
of a cell form a group (large ones are split by a hash); what is known of a cell bounds how far from its pivot a
candidate may lie and still serve an anchor of the group, by the triangle inequality:

* positives: the k + 1 rows of a label nearest to the pivot are so near that each anchor of that label has its k
  positives within its own distance to the pivot plus theirs;
* negatives: the positives' scores, known by then, give each anchor a band of distances.

A candidate goes to the groups whose bounds it meets, within a group to a slice by a hash of its id. A task gets the
anchors of a group and then streams its slice in blocks, so it holds one group and one block, whatever the corpus;
what it sends on are the first k of an anchor (or positive) in its slice. Bounds carry a slack far above rounding,
and what is ranked are exact integer products. The driver holds the pivots and two bounds a pivot, PIVOTS at most.

Rows with a null id, label or vector or any null or non-finite component take no part. Shorter vectors count as
padded with zeros. Products times 100 must fit 64 bits. Repeated rows of an id are candidates each, but never of that id
as an anchor; equal anchor rows are one anchor, unequal ones of an id each have rows of their own. Without anchors,
positives or negatives in the band the result has no rows. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import forget, staged

GROUP, MOST = 128, 512  # anchors of a group: about, and at most
PIVOTS, DRAWN = 1024, 8  # pivots at most; rows drawn for each of them
SLICE_ROWS = 16384
BLOCK = 1024
MOST_TASKS = 20_000
_EXACT = 2.0**53


def integer_rows(vectors: DataFrame, scale: int, relabel) -> DataFrame:
    """(vec_id, label, v array<double> of whole numbers) of the rows that take part."""
    kept = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), relabel(F.col("vec_id"), F.col("label").cast("long")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    kept = kept.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


class Cells:
    """Distances to pivots. norm: the largest squared norm of a candidate."""

    def __init__(self, pivots: np.ndarray, norm: float):
        self.norm, self.pivots = norm, pivots
        self.lift = np.sqrt(np.maximum(norm - (pivots**2).sum(axis=1), 0))
        self.slack = 1e-6 * (1 + np.sqrt(norm))

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.norm - 2 * (x @ self.pivots.T + np.outer(lift, self.lift)), 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + self.norm - 2 * x @ self.pivots.T, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows of x, each the furthest from those before it."""
    picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


class First:
    """The first k of each key by score, ties to the smaller id; what cannot be among them is dropped as rows come."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, np.iinfo(np.int64).min)
        self._held, self._size = [], 0

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self._held.append((keys, scores, ids))
        self._size += len(keys)
        if self._size > 1 << 18:
            self._shrink()

    def _shrink(self) -> None:
        keys, scores, ids = (np.concatenate(c) for c in zip(*self._held, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        last = place == self.k - 1
        self.least[keys[last]] = scores[last]
        kept = place < self.k
        self._held, self._size = [(keys[kept], scores[kept], ids[kept])], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self._held:
            return (np.empty(0, np.int64),) * 3
        self._shrink()
        return self._held[0]


def _routed(rows: DataFrame, cells: Cells, width: int, reaches: Callable, extra: tuple[str, ...] = ()) -> DataFrame:
    """rows with `cell`, one row for each cell that they may serve. reaches(distances, batch) -> which cells those are."""
    sent, schema = rows.sparkSession.sparkContext.broadcast(cells), "vec_id long, label long, v array<double>, cells array<int>"  # PIVOTS bound it

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = some["v"].flatten().to_numpy().reshape(some.num_rows, width)
                serves = reaches(sent.value.of_candidates(x), some)
                row, cell = np.nonzero(serves)
                if len(row):
                    cuts = np.searchsorted(row, np.arange(some.num_rows + 1))
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cell, pa.int32()))
                    yield pa.record_batch([some["vec_id"], some["label"], some["v"], lists], ["vec_id", "label", "v", "cells"])

    return rows.select("vec_id", "label", "v", *extra).mapInArrow(run, schema).select("vec_id", "label", "v", F.explode("cells").alias("cell"))


def _joined(anchors: DataFrame, candidates: DataFrame, splits: dict[int, int], slices: int, width: int, local: Callable, schema: str) -> DataFrame:
    """anchors (cell, vec_id, label, v, akey, p) and routed candidates (cell, vec_id, label, v) by group and slice.

    local(anchor batch, exact) -> (add(ids, labels, products), batches of results). splits: groups of a cell."""
    cells = sorted(splits)
    base = {c: b for c, b in zip(cells, np.cumsum([0, *(splits[c] for c in cells)]).tolist(), strict=False)}
    table = F.create_map(*[F.lit(x) for c in cells for x in (c, base[c])])
    many = F.create_map(*[F.lit(x) for c in cells for x in (c, splits[c])])
    groups = sum(splits.values())
    tasks = min(groups * slices, MOST_TASKS)
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    asked = anchors.select((table[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "akey"), many[F.col("cell")])).cast("int").alias("group"), each.alias("slice"), F.lit(0).alias("kind"), "vec_id", "label", "v", "akey", "p")
    given = candidates.withColumn("sub", F.explode(F.sequence(F.lit(0), (many[F.col("cell")] - 1).cast("int"))))
    given = given.select((table[F.col("cell")] + F.col("sub")).cast("int").alias("group"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "vec_id", "label", "v")
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("key", F.col("group").cast("long") * slices + F.col("slice"))
    dealt = both.repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int")).sortWithinPartitions("key", "kind", "vec_id")

    def run(batches):
        forget()
        key, held, add, rest = None, [], None, None
        for batch in batches:
            keys = batch["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo and keys[lo] != key:
                    if add:
                        yield from rest()
                    key, held, add, rest = keys[lo], [], None, None
                some = batch.slice(lo, hi - lo)
                cut = int(np.searchsorted(some["kind"].to_numpy(), 1))
                if cut:
                    held.append(some.slice(0, cut))
                if cut < some.num_rows and held and add is None:
                    add, rest = local(pa.Table.from_batches(held).combine_chunks())
                for at in range(cut, some.num_rows if held else 0, BLOCK):
                    block = some.slice(at, BLOCK)
                    add(block["vec_id"].to_numpy(), block["label"].to_numpy(), block["v"].flatten().to_numpy().reshape(block.num_rows, width))
        if add:
            yield from rest()

    return dealt.select("key", "kind", "vec_id", "label", "v", "akey", "p").mapInArrow(run, schema)


def _products(q: np.ndarray, exact: bool) -> Callable:
    """x -> integer inner products with the rows of q: in floating point where no sum can round."""
    if exact:
        return lambda x: (q @ x.T).astype(np.int64)
    whole = q.astype(np.int64)
    return lambda x: whole @ x.astype(np.int64).T


def _positives(width: int, k: int, exact: bool) -> Callable:
    def local(anchors: pa.Table):
        own, label, key = (anchors[c].to_numpy() for c in ("vec_id", "label", "akey"))
        products, best = _products(anchors["v"].combine_chunks().flatten().to_numpy().reshape(len(own), width), exact), First(len(own), k)

        def add(ids, labels, x):
            scores = products(x)
            of, at = np.nonzero((labels == label[:, None]) & (ids != own[:, None]) & (scores >= best.least[:, None]))
            best.add(of, scores[of, at], ids[at])

        def rows():
            of, scores, ids = best.rows()
            yield pa.record_batch([pa.array(own[of]), pa.array(key[of]), pa.array(ids), pa.array(scores)], ["anchor_id", "akey", "positive_id", "positive_score"])

        return add, rows

    return local


def _negatives(width: int, k: int, low: int, exact: bool) -> Callable:
    def local(anchors: pa.Table):
        own, label, key = (anchors[c].to_numpy() for c in ("vec_id", "label", "akey"))
        products = _products(anchors["v"].combine_chunks().flatten().to_numpy().reshape(len(own), width), exact)
        positives = [(i, p["positive_id"], p["positive_score"]) for i, ps in enumerate(anchors["p"].to_pylist()) for p in ps]
        anchor, positive, bound = (np.array(c, np.int64) for c in zip(*positives, strict=True))
        best = First(len(anchor), k)

        def add(ids, labels, x):
            scores = products(x)[anchor]
            able = (labels != label[anchor][:, None]) & (scores <= bound[:, None]) & (100 * scores >= low * bound[:, None]) & (scores >= best.least[:, None])
            of, at = np.nonzero(able)
            best.add(of, scores[of, at], ids[at])

        def rows():
            of, scores, ids = best.rows()
            columns = (own[anchor[of]], key[anchor[of]], positive[of], bound[of], ids, scores)
            yield pa.record_batch([pa.array(c) for c in columns], ["anchor_id", "akey", "positive_id", "positive_score", "negative_id", "negative_score"])

        return add, rows

    return local


def _first(found: DataFrame, keys: list[str], score: str, of: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), of)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, relabel: Callable, every: int = 100, k: int = 5, scale: int = 256, low: int = 80, group: int = GROUP, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, label, embedding).

    relabel(vec_id, label): the label that counts. Components are floor(scale * x). Anchors are the rows whose vec_id
    `every` divides. A negative of a positive has low hundredths of its score at least and its score at most."""
    whole = integer_rows(vectors, scale, relabel)
    anchored = F.col("vec_id") % every == 0
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    seen = whole.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(anchored, 1)).alias("anchors"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width"), F.max(squares).alias("norm")).first()
    width, schema = max(seen["width"] or 0, 1), "anchor_id long, akey long, positive_id long, positive_score long"
    if not seen["anchors"]:
        return whole.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if seen["least"] != width:
        whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    wanted = min(PIVOTS, -(-seen["anchors"] // group))
    drawn = whole.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted * DRAWN).collect()
    cells = Cells(far_apart(np.array([r["v"] for r in drawn], np.float64), wanted), float(seen["norm"]))
    exact, slices = seen["norm"] < _EXACT, max(1, -(-seen["n"] // slice_rows))
    sent = whole.sparkSession.sparkContext.broadcast(cells)  # PIVOTS vectors at most

    def place(batches):
        for batch in batches:
            x = batch["v"].flatten().to_numpy().reshape(batch.num_rows, width)
            out = []
            for at in range(0, len(x), BLOCK):
                for far in (sent.value.of_candidates(x[at : at + BLOCK]), sent.value.of_anchors(x[at : at + BLOCK])):
                    out.append((far.argmin(axis=1), far.min(axis=1)))
            near, own = (tuple(np.concatenate(c) for c in zip(*out[s::2], strict=True)) for s in (0, 1))
            yield pa.record_batch([*batch.columns, pa.array(near[0], pa.int32()), pa.array(near[1]), pa.array(own[0], pa.int32()), pa.array(own[1])], [*batch.schema.names, "cell", "far", "own_cell", "own_far"])

    placed = staged(whole.mapInArrow(place, "vec_id long, label long, v array<double>, cell int, far double, own_cell int, own_far double"), "voronoi")
    anchors = placed.filter(anchored).select(F.col("own_cell").alias("cell"), F.col("own_far").alias("own"), "vec_id", "label", "v", F.xxhash64("label", "v").alias("akey")).distinct()
    splits = {r["cell"]: -(-r["n"] // MOST) for r in anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # PIVOTS rows at most

    # positives
    nearest = Window.partitionBy("cell", "label").orderBy("far")
    within = placed.select("cell", "label", "far").withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
    within = within.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("far")).filter(F.col("c") == k + 1).drop("c")
    reach = anchors.select("cell", "label", "own").join(within, ["cell", "label"], "left")
    reach = reach.groupBy("label", "cell").agg(F.max(F.coalesce(2 * F.col("own") + F.col("far"), F.lit(float("inf")))).alias("reach"))
    reach = reach.groupBy("label").agg(F.collect_list(F.struct("cell", "reach")).alias("reach"))  # PIVOTS entries a label at most

    def in_reach(far, batch):
        most, known, labels = np.full(far.shape, -np.inf), {}, batch["label"].to_numpy()
        for i, (one, listed) in enumerate(zip(labels.tolist(), batch["reach"], strict=True)):
            if one not in known:
                known[one] = np.full(far.shape[1], -np.inf)
                for x in listed.as_py():
                    known[one][x["cell"]] = x["reach"]
            most[i] = known[one]
        return far <= most + cells.slack

    routed = _routed(placed.join(reach, "label"), cells, width, in_reach, ("reach",))
    asked = anchors.withColumn("p", F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>"))
    found = _joined(asked, routed, splits, slices, width, _positives(width, k, exact), schema)
    positives = staged(_first(found, ["anchor_id", "akey"], "positive_score", "positive_id", k).drop("rank"), "positives")

    # negatives: only scores of 0 and more have a band
    own = positives.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), "akey").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))  # k at most
    asked = staged(anchors.join(own, ["vec_id", "akey"]), "anchors")
    square = F.aggregate("v", F.lit(float(seen["norm"])), lambda s, x: s + x * x)  # of an anchor's distance to a candidate with product 0
    least, most = F.array_min(F.col("p.positive_score")), F.array_max(F.col("p.positive_score"))
    furthest, closest = F.sqrt(F.greatest(square - 2 * low / 100 * least, F.lit(0.0))), F.sqrt(F.greatest(square - 2 * most, F.lit(0.0)))
    bands = asked.groupBy("cell").agg(F.max(F.col("own") + furthest).alias("to"), F.min(closest - F.col("own")).alias("at")).collect()  # PIVOTS rows at most
    to, at = np.full(len(cells.pivots), -np.inf), np.full(len(cells.pivots), np.inf)
    for r in bands:
        to[r["cell"]], at[r["cell"]] = r["to"] + cells.slack, r["at"] - cells.slack
    routed = _routed(placed, cells, width, lambda far, batch: (far <= to) & (far >= at))
    found = _joined(asked, routed, splits, slices, width, _negatives(width, k, low, exact), schema + ", negative_id long, negative_score long")
    ranked = _first(found, ["anchor_id", "akey", "positive_id", "positive_score"], "negative_score", "negative_id", k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
