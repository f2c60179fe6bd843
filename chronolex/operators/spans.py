"""Interval algebra of spans (document_id, start, end, text, confidence, page_num, section_id, metadata), half-open [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import span_hash
from chronolex.operators.scans import scan, spread
from chronolex.staging import staged

BUCKET = 4096


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return ~((a_end <= b_start) | (b_end <= a_start))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Rows of left (start, end) with overlapping rows of right (r_start, r_end) of equal keys.

    Both sides are dealt to the buckets that they touch; a pair is kept in the bucket where the later of the
    two begins, so it comes out once and long documents don't pair all with all."""
    touch = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bucket)))
    a, b = left.withColumn("_bucket", touch("start", "end")), right.withColumn("_bucket", touch("r_start", "r_end"))
    joined = a.join(b, [*keys, "_bucket"])
    first = F.floor(F.greatest("start", "r_start") / bucket) == F.col("_bucket")
    return joined.filter(first & overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).drop("_bucket")


def overlapping(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, span_id): spans of the target's document that overlap it, itself left out."""
    right = targets.select("document_id", F.col("span_id").alias("target_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return interval_join(spans, right, ["document_id"]).filter("span_id <> target_id").select("target_id", "span_id")


def merge_adjacent(spans: DataFrame, max_gap: int = 0, touching: bool = False) -> DataFrame:
    """Islands of spans by (document_id, start): the next span joins when it begins at most max_gap after the island's
    end (touching), or before it (otherwise, with max_gap 0: overlaps only).

    Documents within one bucket, most of them, are dealt once and folded; longer ones are scanned, so that none is one task's."""
    bucketed = spans.withColumn("_b", F.floor(F.col("start") / BUCKET))
    long = bucketed.groupBy("document_id").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")).filter("_lo < _hi").select(F.col("document_id").alias("_long"))
    long = staged(long, "long")
    if not long.take(1):
        return _islands(_in_order(bucketed, max_gap, touching))
    same = F.col("document_id").eqNullSafe(F.col("_long"))
    short = _in_order(bucketed.join(long, same, "left_anti"), max_gap, touching)
    return _islands(short).unionByName(_islands(_scanned(bucketed.join(long, same, "left_semi"), max_gap, touching)))


def _joins(start: Column, reach: Column, max_gap: int, touching: bool) -> Column:
    return (start <= reach + max_gap) if touching else (start < reach)


def _in_order(bucketed: DataFrame, max_gap: int, touching: bool) -> DataFrame:
    """spans with `island`, by windows of one order: rows of a document are dealt and sorted once."""
    order = Window.partitionBy("document_id").orderBy("start", "end", "span_id")
    reached = bucketed.withColumn("_reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | ~_joins(F.col("start"), F.col("_reach"), max_gap, touching), 1).otherwise(0)
    return reached.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _scanned(bucketed: DataFrame, max_gap: int, touching: bool) -> DataFrame:
    """The same by scans that split a document."""
    order = ["start", "end", "span_id"]
    reached = scan(bucketed, ["document_id"], ["_b"], order, {"_reach": ("max", F.col("end"))}, inclusive=False)
    new = F.when(F.col("_reach").isNull() | ~_joins(F.col("start"), F.col("_reach"), max_gap, touching), 1).otherwise(0)
    return scan(reached.withColumn("_new", new), ["document_id"], ["_b"], order, {"island": ("sum", F.col("_new"))})


def _islands(rows: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("start", "end", "span_id", "text", "section_id"))).alias("_s")
    out = rows.groupBy("document_id", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        held,
        F.min("page_num").alias("page_num"),
        F.min("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_spans"),
    )
    listed = lambda c, by: F.array_join(F.transform("_s", lambda x: x[c]), by).alias(c)
    return out.select("document_id", "island", "start", "end", listed("text", " "), "page_num", "confidence", listed("section_id", "+"), "n_spans")


def confident(spans: DataFrame, threshold: float) -> DataFrame:
    return spans.filter(F.col("confidence") >= threshold)


def by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "span_id"))).alias("spans"))


def citations(spans: DataFrame) -> DataFrame:
    digest = span_hash(F.col("document_id"), F.col("start"), F.col("end"), F.col("text"))
    return spans.select("span_id", "document_id", "start", "end", "page_num", "section_id", "confidence", digest.alias("span_hash"))


def integrity(spans: DataFrame) -> DataFrame:
    """spans with `invalid` (bad bounds or blank text), `duplicate` (a later row of an equal signature) and `orphaned` (no document)."""
    again = Window.partitionBy("text", "start", "end", "document_id").orderBy("span_id")
    invalid = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.trim("text") == "")
    flags = {"invalid": invalid, "duplicate": F.row_number().over(again) > 1, "orphaned": F.col("document_id").isNull() | (F.col("document_id").cast("string") == "")}
    return spans.withColumns(flags)


def integrity_report(spans: DataFrame) -> DataFrame:
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("invalid", "duplicate", "orphaned")]
    valid = F.sum((~(F.col("invalid") | F.col("duplicate") | F.col("orphaned"))).cast("long")).alias("valid")
    return integrity(spans).agg(F.count(F.lit(1)).alias("total"), *counts, valid)


def resolve_overlaps(spans: DataFrame, high: float = 0.8) -> DataFrame:
    """Spans without an overlap in their document, and those of high confidence.

    Only spans that an overlap would remove are looked up, and each needs to know of one other span, not of all."""
    sure = F.coalesce(F.col("confidence") >= high, F.lit(False))
    rest = spans.filter(~sure)
    touch = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / BUCKET), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / BUCKET)))
    a = rest.select("document_id", "span_id", "start", "end").withColumn("_bucket", touch("start", "end"))
    b = spans.select("document_id", F.col("span_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).withColumn("_bucket", touch("r_start", "r_end"))
    n = spans.count()
    a, b = spread(a, "document_id", "_bucket", n=n), spread(b, "document_id", "_bucket", n=n)
    meets = (a["document_id"] == b["document_id"]) & (a["_bucket"] == b["_bucket"]) & (F.col("span_id") != F.col("r_id")) & overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    hit = a.join(b, meets, "left_semi").select("span_id").distinct()
    return spans.filter(sure).unionByName(spread(rest, "span_id", n=n).join(spread(hit, "span_id", n=n), "span_id", "left_anti"))


def context(spans: DataFrame, within: int = 200, most: int = 3) -> DataFrame:
    """(target_id, side, rank, span_id): the last `most` spans that end at most `within` before each span, and the first that begin at most `within` after."""
    t = spans.select("document_id", F.col("span_id").alias("target_id"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    wide = t.withColumns({"r_start": F.col("t_start") - within - 1, "r_end": F.col("t_end") + within + 1})
    near = interval_join(spans.select("document_id", "span_id", "start", "end"), wide, ["document_id"]).filter("span_id <> target_id")
    side = F.when((F.col("end") <= F.col("t_start")) & (F.col("t_start") - F.col("end") <= within), "preceding").when((F.col("start") >= F.col("t_end")) & (F.col("start") - F.col("t_end") <= within), "following")
    near = near.withColumn("side", side).filter("side IS NOT NULL")
    nearest = F.when(F.col("side") == "preceding", F.col("t_start") - F.col("end")).otherwise(F.col("start") - F.col("t_end"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("target_id", "side").orderBy(nearest, "span_id")))
    return ranked.filter(F.col("rank") <= most).select("target_id", "side", "rank", "span_id")
