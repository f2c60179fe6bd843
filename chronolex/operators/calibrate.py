"""Isotonic calibration: the non-decreasing function of a score that is nearest to the outcomes, weighted least squares.

Pooling of adjacent violators, as a reduction that merges: equal scores are pooled by an aggregation, each range of scores
is pooled in its own task, and what is left of neighbouring ranges is pooled again, in fewer tasks each round. That
gives the same blocks as one pass, since blocks are the lower convex hull of the cumulative sums, and a hull is that of its
parts' hulls. Outcomes of 0 and 1 leave some n^(2/3) blocks of n scores at most.

Rows with a null or non-finite score, outcome or weight, or a weight that is not positive, take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.staging import staged

AT_ONCE = 100_000  # blocks that one task pools
_SCHEMA = "lo double, hi double, w double, wy double, n long"


def pooled(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, wy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order of score, adjacent ones pooled until their means rise."""
    stack: list[list[float]] = []
    for row in zip(lo.tolist(), hi.tolist(), w.tolist(), wy.tolist(), n.tolist(), strict=True):
        new = list(row)
        while stack and stack[-1][3] * new[2] >= new[3] * stack[-1][2]:
            last = stack.pop()
            new = [last[0], new[1], last[2] + new[2], last[3] + new[3], last[4] + new[4]]
        stack.append(new)
    return tuple(np.array(c) for c in zip(*stack, strict=True)) if stack else (lo, hi, w, wy, n)


def _pool_parts(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            out = pooled(*(table[c].to_numpy() for c in ("lo", "hi", "w", "wy", "n")))
            yield pa.record_batch([*(pa.array(c, pa.float64()) for c in out[:4]), pa.array(out[4].astype(np.int64))], ["lo", "hi", "w", "wy", "n"])

    return blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(run, _SCHEMA)


def isotonic(rows: DataFrame, score: str, outcome: str, weight: str | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(lo, hi, w, wy, n, fitted): blocks of scores lo to hi with their weight, weighted outcomes, rows and fitted value, which rises from block to block."""
    x, y, w = F.col(score).cast("double"), F.col(outcome).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    able = rows.select(x.alias("x"), y.alias("y"), w.alias("w")).filter("w > 0 AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('infinity') AND abs(y) < double('infinity') AND w < double('infinity')")
    blocks = able.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"))
    blocks = staged(blocks.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "w", "wy", "n"), "scores")
    left = blocks.count()
    while True:
        parts = -(-left // at_once)
        blocks = staged(_pool_parts(blocks, max(parts, 1)), "blocks")
        before, left = left, blocks.count()
        if parts <= 1:
            return blocks.withColumn("fitted", F.col("wy") / F.col("w"))
        if left > before // 2:  # hardly anything to pool: the rest in one task, as rising blocks are all that it holds
            at_once = max(at_once, left)


def calibrated(score: Column, blocks: DataFrame, most: int = 1_000_000) -> Column:
    """The fitted value of a score: that of its block, on a straight line between the blocks around it, that of the nearest outside of all.

    blocks: from isotonic(), `most` at most, which the driver holds."""
    held = blocks.select("lo", "hi", "fitted").orderBy("lo").limit(most + 1).toPandas()
    if len(held) > most:
        raise ValueError(f"more than {most} blocks")
    if not len(held):
        return F.lit(None).cast("double")
    at = np.stack([held["lo"].to_numpy(), held["hi"].to_numpy()], axis=1).ravel()
    fitted = np.repeat(held["fitted"].to_numpy(), 2)
    sent = blocks.sparkSession.sparkContext.broadcast((at, fitted))

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, np.interp(x.fillna(0), *sent.value))).where(x.notna().to_numpy())

    return value(score.cast("double"))
