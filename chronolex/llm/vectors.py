"""Searches of a stated query set over sharded vectors.

Rows are dealt to shards by a hash of their id: shards of a bounded number of components, LEAST_SHARDS of them
from a few thousand rows on, so that a cluster is kept busy. Every query visits every shard, once: what a query
costs grows with the number of shards, and within one as its index grows, so shards are as large as a task's
memory allows. One task gets a shard's rows, builds its index and then streams the queries through it in
blocks, so that it holds one shard and one block whatever the corpus. Each shard answers with its own nearest;
a top-k by query joins the answers. A lost executor costs its shards only. Equal vectors of a shard are indexed
once with their ids, however many.

Shorter vectors count as padded with zeros to the longest; rows without vec_id take no part. Rows of one
vec_id are candidates each. Other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import forget

BLOCK = 1024
SHARD_VALUES = 1 << 22  # components of a shard's vectors: 65,536 rows of 64
LEAST_SHARDS, LEAST_ROWS = 8, 1024


def shard_count(rows: int, width: int, shard_values: int = SHARD_VALUES) -> int:
    """Shards of at most shard_values components; LEAST_SHARDS at least, unless they had fewer than LEAST_ROWS rows."""
    return max(1, -(-rows * max(width, 1) // shard_values), min(LEAST_SHARDS, rows // LEAST_ROWS))


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: finite, without null parts, and if asked not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    kept = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), v.alias("v"))
    kept = kept.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return kept.filter(F.exists("v", lambda x: x != 0)) if nonzero else kept


class Distinct:
    """Distinct rows of a matrix, each with its sorted ids; only the first `most` ids of a row can ever be asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        rows = np.ascontiguousarray(rows)
        _, first, of = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.rows = rows[first]
        order = np.lexsort((ids, of))
        self._ids, self._cuts = ids[order], np.searchsorted(of[order], np.arange(len(first) + 1))

    def ids(self, row: int, most: int) -> np.ndarray:
        return self._ids[self._cuts[row] : min(self._cuts[row + 1], self._cuts[row] + most)]

    def best(self, own: int, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) among the given rows but `own`, ties to smaller ids."""
        ids = [self.ids(r, k + 1) for r in rows]
        scores = np.repeat(scores, [len(x) for x in ids])
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        keep = ids != own
        ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def sharded_top_k(vectors: DataFrame, queries, k: int, shard_values: int, build: Callable, score_type: str) -> DataFrame:
    """vectors (vec_id, v); queries: the condition that marks query rows. build(ids, matrix) gives a function
    (query ids, query matrix) -> iterator of (ids, scores) per query: the shard's k nearest but the query's own row.

    query_id, rank, vec_id, score: nearest first, ties to the smaller vec_id."""
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width")).first()
    width = max(counted["width"] or 0, 1)
    if counted["least"] != width:
        vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    shards = shard_count(counted["n"], width, shard_values)
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("ask", F.lit(0))
    asked = vectors.filter(queries).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("ask", F.lit(1))
    # shard s is partition s: a hash of so few numbers would leave tasks empty and give others two shards
    dealt = rows.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("ask", "vec_id")
    arrow = pa.int64() if score_type == "long" else pa.float64()

    def run(batches):
        forget()
        held, index = [], None
        for batch in batches:
            ids, matrix = batch["vec_id"].to_numpy(), batch["v"].flatten().to_numpy().reshape(batch.num_rows, width)
            cut = int(np.searchsorted(batch["ask"].to_numpy(), 1))
            if cut:
                held.append((ids[:cut], matrix[:cut].astype(np.float64)))
            ids, matrix = ids[cut:], matrix[cut:]
            if not len(ids) or not held and index is None:  # no queries here, or a shard without rows
                continue
            if index is None:
                index = build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held = []
            for at in range(0, len(ids), BLOCK):
                asked_ids = ids[at : at + BLOCK]
                found = list(index(asked_ids, matrix[at : at + BLOCK]))
                of = np.repeat(asked_ids, [len(f[0]) for f in found])
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]), arrow)], ["query_id", "vec_id", "score"])

    answers = dealt.select("ask", "vec_id", "v").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
