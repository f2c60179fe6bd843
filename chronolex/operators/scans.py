"""Running totals in the order of a key, split inside the key: a document of most of the rows spreads over many tasks.

Rows of a key are cut into buckets that follow its order. Each bucket is reduced to one row first, the buckets' rows
are scanned by key, and what a bucket carries over is joined to the scan inside it. A task holds one bucket of a key, or its
buckets' rows: with n rows in buckets of b, the longer of b and n / b, not n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = 1024  # places of a bucket
ROWS = 250_000  # of a task, where rows are small when they are dealt but not in memory


def spread(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """rows dealt by keys to tasks of about ROWS; Spark's own choice goes by compressed bytes, which say little of alike rows. n: how many rows, if known."""
    return rows.repartition(max(1, -(-(rows.count() if n is None else n) // ROWS)), *keys)


def scan(rows: DataFrame, keys: list[str], buckets: list[str], order: list[str], totals: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """rows with a column for each of totals: name -> (sum, max or last, of a column), over the rows of the key up to each one; without itself if not inclusive.

    buckets: columns that order the rows of a key as `order` does, more coarsely; rows are in order by buckets, then `order`.
    A sum of nothing is 0, a maximum or last value of nothing null. Nulls are passed over. Null keys are a key."""
    at = F.struct(*keys, *buckets)  # one column, so that the join and the window deal rows alike; a struct is never null, its fields may be
    valued = rows.withColumns({"_at": at} | {f"_v_{n}": c for n, (_, c) in totals.items()})
    place = F.struct(*order)
    reduce = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), place))}
    each = valued.groupBy("_at").agg(*[reduce[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in totals.items()])
    before = Window.partitionBy(*[f"_at.{c}" for c in keys]).orderBy(*[f"_at.{c}" for c in buckets]).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carried = each.select("_at", *[over[kind](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _) in totals.items()])
    joined = valued.join(carried, "_at")
    joined = joined.withColumns({f"_i_{n}": over[kind](F.col(f"_v_{n}")).over(inside) for n, (kind, _) in totals.items()})
    merge = {"sum": lambda c, i: F.coalesce(c, F.lit(0)) + F.coalesce(i, F.lit(0)), "max": lambda c, i: F.greatest(c, i), "last": lambda c, i: F.coalesce(i, c)}
    return joined.select(*rows.columns, *[merge[kind](F.col(f"_c_{n}"), F.col(f"_i_{n}")).alias(n) for n, (kind, _) in totals.items()])
