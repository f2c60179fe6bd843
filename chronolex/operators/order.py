"""Exact places in an order, without ordering a key in one task.

Rows are dealt by ranges of their order key (Spark samples the ranges), so a key with most of the rows spans many
partitions. A place is found from the counts of the partitions before it and the order inside its own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.staging import staged


def _ranged(rows: DataFrame, *by: str) -> DataFrame:
    """rows by ranges of `by`, with the number of their range as _range; written, so that it stays what it is."""
    return staged(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")


def with_places(counts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """counts (keys, column, _c), a row a distinct value of a key, with _to: how many of the key are not above the value; and _n: of the key in all.

    Windows are over the values of a key within one range, and over the ranges of a key."""
    ranged = _ranged(counts, *keys, column)
    part = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_part"))
    by_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_part").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_before", before).withColumn("_n", F.sum("_part").over(by_key)).drop("_part")
    inside = ranged.withColumn("_in", F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy(column)))
    same = [inside[c].eqNullSafe(part[c]) for c in [*keys, "_range"]]
    joined = inside.join(part, same)
    return joined.select(*[inside[c] for c in keys], inside[column], "_c", (F.col("_before") + F.col("_in")).alias("_to"), "_n")


def at_place(place: Column, column: str) -> Column:
    """Aggregate over with_places(): the value at a place from 1."""
    return F.min(F.when(F.col("_to") >= place, F.col(column)))


def first_share(rows: DataFrame, by: list[str], share: float, name: str = "part", parts: tuple[str, str] = ("train", "test")) -> DataFrame:
    """rows with `name`: parts[0] for the first floor(n share) in order of `by`, parts[1] for the rest.

    The cut is exact: rows that are equal in `by` are told apart by the order in which they are read. Only the range that the cut
    falls in is numbered, each range's count comes to the driver."""
    ranged = _ranged(rows.withColumn("_at", F.monotonically_increasing_id()), *by, "_at")
    sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # partitions
    left, cut = int(sum(n for _, n in sizes) * share + 1e-9), -1
    for number, n in sizes:
        if n > left:
            cut = number
            break
        left -= n
    else:
        cut = max([number for number, _ in sizes], default=-1) + 1
    order = Window.partitionBy("_range").orderBy(*by, "_at")
    whole = ranged.filter(F.col("_range") != cut).withColumn(name, F.when(F.col("_range") < cut, parts[0]).otherwise(parts[1]))
    split = ranged.filter(F.col("_range") == cut).withColumn(name, F.when(F.row_number().over(order) <= left, parts[0]).otherwise(parts[1]))
    return whole.unionByName(split).drop("_range", "_at")
