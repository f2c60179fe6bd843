"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt to shards of bounded size and stand there in a seeded order, so
that the shard is one stream of words cut into blocks of `block` words. Sainte-Laguë gives every
source an integer number of blocks by its target, and again every shard of a source by its size.
A shard that may take q of its m blocks takes each q // m times and, once more, the q % m blocks that
follow a seeded one, round the end; so documents stay whole but at the two ends of that run, and a
document's share is the overlap of two intervals.

Null or empty texts have size 0 and take 0 words; null sources are one source, the last; repeated
rows are documents of their own. Very long texts may span many blocks. Other columns of any name are kept by
mixed(). An empty table gives an empty result. What stands in one task is the table of sources, one row each, and
of one source's shards; the number of sources must fit a task's memory (millions do).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import WORD_PATTERN, staged, unused

CYCLE = (5.0, 2.0, 1.0)


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), none above its cap; ties go to the first."""
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    won = np.zeros(len(weights), np.int64)
    open_ = (weights > 0) & (caps > 0)
    seats = min(seats, int(caps[open_].sum()))
    if seats <= 0:
        return won

    def at(level: float) -> np.ndarray:
        q = np.floor((np.where(open_, weights, 0.0) / level + 1) / 2)
        return np.minimum(np.where(open_, q, 0), caps).astype(np.int64)

    low, high = 0.0, float(weights.max()) * 2  # at `high` nobody has a seat
    for _ in range(200):
        middle = (low + high) / 2
        if middle <= 0 or at(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    won = at(high)
    heap = [(-weights[i] / (2 * won[i] + 1), i) for i in np.flatnonzero(open_ & (won < caps))]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (source, source_size) with `target`: weights 5, 2, 1 repeating by code point order, at most
    `most` times the source's size; what a full source leaves goes to the others by weight.

    All targets are min(cap, level * weight) for one level, found where the sources fill up in the order
    of cap / weight; only the table of sources, one row each, is sorted."""
    cycle = F.array(*[F.lit(w) for w in CYCLE])
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = sources.withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_weight", cycle[F.col("_n") % len(CYCLE)])
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fills = Window.orderBy(F.col("_cap") / F.col("_weight"), "_n")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_goal", F.sum("source_size").over(all_) * F.lit(float(share)))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights_left", F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_goal") - F.col("_caps_before")) / F.col("_weights_left"))
    )
    # the first source, in filling order, whose cap is above level * weight sets the level of all that follow
    free = F.col("_cap") >= F.col("_level") * F.col("_weight")
    level = F.min_by("_level", F.when(free, F.struct(F.col("_cap") / F.col("_weight"), F.col("_n")))).over(all_)
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 64, shard_docs: int = 4096, seed: int = 20261, size=None
) -> DataFrame:
    """docs (doc_id, source and text, or a column expression for `size`) with source_size, target and `taken`, the words the mix takes.

    `shard_docs`: documents of a shard on average. Each source's taken words differ from its target by half a block and less than
    one block for each of its shards; no document is taken more than `most` (a whole number) times."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long") if size is None else size
    sized = staged(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    goals = targets(totals.select("source", "source_size"), share, most)
    goals = goals.join(totals.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goals = goals.withColumn("_shards", F.ceil(F.col("_docs") / shard_docs).cast("long"))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = sized.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_docs")
    dealt = dealt.withColumn("_order", order).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.col("_shards")))
    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("target").alias("target"))
    quotas = _quotas(shards, block, int(most), seed)
    stream = Window.partitionBy("source", "_shard").orderBy("_order", F.col("doc_id"), "size")
    placed = dealt.withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(
        quotas.withColumnsRenamed({"source": "_s", "_shard": "_k"}),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")),
    )
    m, r, off = F.col("_blocks"), F.col("_quota") % F.col("_blocks"), F.col("_offset")

    def overlap(low, high):  # words of the document in blocks low to high
        inside = F.least(F.col("_end"), high * block) - F.greatest(F.col("_end") - F.col("size"), low * block)
        return F.greatest(inside, F.lit(0))

    again = overlap(off, off + r) + overlap(F.lit(0), off + r - m)
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("_quota") / m) * F.col("size") + again)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _quotas(shards: DataFrame, block: int, most: int, seed: int) -> DataFrame:
    """shards (source, _shard, _words, target) with _blocks, _quota and the seeded _offset of the choice."""
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / F.lit(block)).cast("long"))
    sources = shards.groupBy("source").agg(F.first("target").alias("target"), (F.sum("_blocks") * most).alias("_caps"))

    def of_sources(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a source
        pdf = pdf.sort_values("source", na_position="last", key=lambda s: s.map(lambda x: x if x is None else x.encode()), ignore_index=True)
        seats = round(pdf["target"].sum() / block)
        return pd.DataFrame({"source": pdf["source"], "_source_quota": sainte_lague(pdf["target"].to_numpy(), seats, pdf["_caps"].to_numpy())})

    def of_shards(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a shard of one source
        pdf = pdf.sort_values("_shard", ignore_index=True)
        quota = sainte_lague(pdf["_words"].to_numpy(), int(pdf["_source_quota"].iloc[0]), pdf["_blocks"].to_numpy() * most)
        return pdf[["source", "_shard", "_blocks", "_offset"]].assign(_quota=quota)

    won = sources.groupBy(F.lit(0).alias("_all")).applyInPandas(of_sources, "source string, _source_quota long")
    shards = shards.join(won.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source", "_shard"), F.greatest(F.col("_blocks"), F.lit(1)))
    quotas = (
        shards.withColumn("_offset", offset)
        .groupBy("source")
        .applyInPandas(of_shards, "source string, _shard long, _blocks long, _offset long, _quota long")
    )
    return quotas.withColumn("_blocks", F.greatest("_blocks", F.lit(1)))


def mixed(docs: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The mix itself: each document as often as the words taken of it round to whole documents; wordless ones are left out.

    Rows that share a doc_id are each taken as often as the most taken of them, so repeated ids weigh more than the plan says."""
    plan = mix(docs, **options).filter("taken > 0")
    times = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    of, much, nth = (unused(docs, n) for n in ("_id", "_times", "_nth"))
    plan = plan.groupBy(F.col("doc_id").alias(of)).agg(F.max(times).alias(much))
    plan = staged(plan.filter(F.col(much) > 0), "mix-plan")
    joined = docs.join(F.broadcast(plan) if plan.count() <= broadcast_rows else plan, F.col("doc_id").eqNullSafe(F.col(of)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(much)))).select(docs.columns)
