"""Dense index of coarse cells: unit vectors by cell with residual codes, probed by query, re-ranked exactly.

The centroids are spherical k-means over a bounded sample; every row is indexed in the cell of its nearest centroid as
one signed byte a component of what is left of it there, with a scale of its own. A query looks into its `probes` nearest
cells; large cells are split into parts by a hash of chunk_id, so neither a crowded cell nor a frequent one meets in one
task: a task holds one part's codes and streams the queries that probe it. The best candidates by code are re-ranked with
their vectors. The cost of a query is its probes' rows instead of all. `probes` is a number of the caller's or
calibrated: the least that finds a share of the true neighbours of a bounded sample of rows.

Vectors are those of index.unit_vectors, all of one length. No rows or no queries give no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from chronolex.operators.retrieve import dense, top_by_query
from chronolex.staging import staged

CELLS, SAMPLE, PART_ROWS, BLOCK = 4096, 65_536, 65_536, 512
DEEP = 5  # candidates by code for each hit wanted
CALIBRATION, NEAREST = 256, 10


@dataclass(frozen=True)
class DenseIndex:
    """rows: (cell, part, chunk_id, code binary, scale, v); centroids: a row a cell; parts: of each cell."""

    rows: DataFrame
    centroids: np.ndarray
    parts: int


def k_means(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows; a cell that loses its rows gets the row that is worst off."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([x[at : at + 4096] @ c.T for at in range(0, len(x), 4096)])
        of, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, int8 residual code and scale of each row."""
    cell = (x @ centroids.T).argmax(axis=1)
    rest = x - centroids[cell]
    scale = np.abs(rest).max(axis=1) / 127
    code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return cell, code, scale


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DenseIndex | None:
    """An index of vectors (chunk_id, v), unit vectors of one length; None without rows. cells: about two for each root of the rows, CELLS at most."""
    n = vectors.count()
    if not n:
        return None
    cells = cells or min(CELLS, max(1, int(2 * n**0.5)))
    drawn = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("v").limit(sample).toArrow()["v"]  # bounded
    centroids = k_means(np.array(drawn.combine_chunks().flatten()).reshape(len(drawn), -1), cells)
    sent, kind = vectors.sparkSession.sparkContext.broadcast(centroids), vectors.schema["chunk_id"].dataType  # CELLS rows at most

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, code, scale = encode(batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1), sent.value)
                yield pa.record_batch([pa.array(cell, pa.int32()), batch["chunk_id"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float64()), batch["v"]], ["cell", "chunk_id", "code", "scale", "v"])

    schema = StructType([StructField("cell", IntegerType()), StructField("chunk_id", kind)]).add("code", "binary").add("scale", "double").add("v", ArrayType(DoubleType()))
    rows = vectors.select("chunk_id", "v").mapInArrow(run, schema)
    parts = max(1, -(-n // (part_rows * max(1, len(centroids) // 4))))  # a cell with four times its share keeps to part_rows
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
    return DenseIndex(staged(rows.withColumn("part", part), "cells"), centroids, parts)


def probed(queries: DataFrame, index: DenseIndex, probes: int) -> DataFrame:
    """queries (query_id, q) with a row for each of their nearest cells: cell, base (what the centroid adds to a score)."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                near = some["q"].flatten().to_numpy().reshape(some.num_rows, -1) @ sent.value.T
                most = min(probes, near.shape[1])
                cell = np.argsort(-near, axis=1, kind="stable")[:, :most]
                of = pa.array(np.repeat(np.arange(some.num_rows), most))
                yield pa.record_batch([some["query_id"].take(of), some["q"].take(of), pa.array(cell.ravel(), pa.int32()), pa.array(np.take_along_axis(near, cell, axis=1).ravel())], ["query_id", "q", "cell", "base"])

    schema = StructType([queries.schema["query_id"], StructField("q", ArrayType(DoubleType())), StructField("cell", IntegerType()), StructField("base", DoubleType())])
    return queries.select("query_id", "q").mapInArrow(run, schema)


def write(index: DenseIndex, path: str) -> None:
    """The index as tables below path, a folder a cell: a search reads the folders that its queries probe."""
    spark = index.rows.sparkSession
    index.rows.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    cells = [(i, c.tolist(), index.parts) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(cells, "cell int, centroid array<double>, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str) -> DenseIndex:
    """What write() left below path."""
    cells = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS rows at most
    return DenseIndex(spark.read.parquet(f"{path}/cells"), np.array([r["centroid"] for r in cells], np.float64), cells[0]["parts"])


def _by_code(asked: DataFrame, index: DenseIndex, k: int) -> DataFrame:
    """(query_id, chunk_id, near): the k best by code of each query and part that it probes."""
    asked = staged(asked, "probes")
    seen = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # CELLS at most
    tasks = max(1, min(index.parts * len(index.centroids), asked.sparkSession.sparkContext.defaultParallelism * 8))
    rows = index.rows.filter(F.col("cell").isin(seen)).select("cell", "part", F.lit(0).alias("kind"), "chunk_id", "code", "scale")
    looked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1)))).withColumn("kind", F.lit(1))
    both = rows.unionByName(looked, allowMissingColumns=True).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "kind")
    width, id_type = index.centroids.shape[1], asked.schema["query_id"].dataType

    def run(batches):
        key, held, codes = None, [], None
        for batch in batches:
            keys = np.stack([batch["cell"].to_numpy(), batch["part"].to_numpy(), batch["kind"].to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                cell, part, kind = keys[lo].tolist()
                if (cell, part) != key:
                    key, held, codes = (cell, part), [], None
                some = batch.slice(lo, hi - lo)
                if not kind:
                    held.append((some["chunk_id"], np.frombuffer(b"".join(some["code"].to_pylist()), np.int8).reshape(-1, width), some["scale"].to_numpy()))
                    continue
                if not held:
                    continue
                if codes is None:
                    codes = (pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]).astype(np.float32), np.concatenate([h[2] for h in held]))
                for at in range(0, some.num_rows, BLOCK):
                    block = some.slice(at, BLOCK)
                    q = block["q"].flatten().to_numpy().reshape(block.num_rows, width).astype(np.float32)
                    near = block["base"].to_numpy()[:, None] + (q @ codes[1].T) * codes[2][None, :]
                    most = min(k, near.shape[1])
                    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    of = pa.array(np.repeat(np.arange(block.num_rows), most))
                    yield pa.record_batch([block["query_id"].take(of), codes[0].take(pa.array(best.ravel())), pa.array(np.take_along_axis(near, best, axis=1).ravel(), pa.float64())], ["query_id", "chunk_id", "near"])

    columns = ["cell", "part", "kind", "chunk_id", "code", "scale", "query_id", "q", "base"]
    schema = StructType([StructField("query_id", id_type), index.rows.schema["chunk_id"], StructField("near", DoubleType())])
    return both.select(columns).mapInArrow(run, schema)


def search(queries: DataFrame, index: DenseIndex | None, k: int, probes: int) -> DataFrame:
    """queries (query_id, q of unit length) -> (query_id, chunk_id, score, rank): the k best by cosine among the rows of the probed cells' best by code."""
    if index is None:
        empty = StructType([queries.schema["query_id"], StructField("chunk_id", queries.schema["query_id"].dataType), StructField("score", DoubleType()), StructField("rank", IntegerType(), False)])
        return queries.sparkSession.createDataFrame([], empty)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    found = _by_code(probed(queries, index, probes), index, DEEP * k)
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= DEEP * k).select("query_id", "chunk_id")
    pairs = found.join(queries.select("query_id", "q"), "query_id").join(index.rows.select("chunk_id", "v"), "chunk_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top_by_query(pairs.select("query_id", "chunk_id", score.alias("score")), k)


def calibrated(index: DenseIndex | None, share: float = 0.95, sample: int = CALIBRATION) -> int:
    """The least number of probes with which `share` of the NEAREST neighbours of a sample of rows, themselves left out, lie in a probed cell."""
    if index is None:
        return 1
    drawn = index.rows.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    drawn = staged(drawn, "drawn")
    hits = dense(drawn, index.rows.select("chunk_id", "v"), NEAREST + 1).filter("query_id <> chunk_id")
    rows = hits.join(index.rows.select("chunk_id", "cell"), "chunk_id").join(drawn, "query_id").select("q", "cell").toArrow()  # sample * NEAREST
    if not rows.num_rows:
        return 1
    near = np.array(rows["q"].to_pylist(), np.float64) @ index.centroids.T
    own = np.take_along_axis(near, rows["cell"].to_numpy()[:, None], axis=1)
    place = np.sort((near > own).sum(axis=1))
    return int(place[min(len(place) - 1, int(np.ceil(len(place) * share)) - 1)]) + 1
