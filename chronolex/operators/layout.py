"""Page layout: boxes, element types, reading order, columns and structure of pages (page, elem_id, text, x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators.scans import spread


def bbox(points: Column) -> Column:
    """struct(x1,y1,x2,y2) of a polygon array<struct<x,y>>."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def area(x1, y1, x2, y2) -> Column:
    return (F.col(x2) - F.col(x1)) * (F.col(y2) - F.col(y1))


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of boxes a_x1.. and b_x1..; 0 without a union."""
    c = lambda side, k: F.col(f"{side}_{k}")
    width = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    height = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    union = area(*(f"{a}_{k}" for k in ("x1", "y1", "x2", "y2"))) + area(*(f"{b}_{k}" for k in ("x1", "y1", "x2", "y2"))) - width * height
    return F.when(union > 0, width * height / union).otherwise(F.lit(0.0))


def table_like(text: Column) -> Column:
    return F.contains(text, F.lit("\t")) | (F.regexp_count(text, F.lit(r"\s{2,}")) >= 2)


def classified(elements: DataFrame, heading_factor: float = 1.5) -> DataFrame:
    """elements with `kind`; the mean height of the page's boxes is the measure of a heading."""
    elements, text = spread(elements, "page"), F.trim("text")
    mean = F.coalesce(F.avg(F.col("y2") - F.col("y1")).over(Window.partitionBy("page")), F.lit(20.0))
    upper = (F.upper(text) == text) & text.rlike(r"\p{Lu}")
    kind = (
        F.when(text == "", "empty")
        .when(F.col("y2") - F.col("y1") > mean * heading_factor, "heading")
        .when((F.length(text) < 50) & upper, "title")
        .when(text.rlike(r"^[0-9]+\."), "numbered_item")
        .when(text.rlike(r"(?i)^\s*TABLE\s*[0-9]*"), "table_header")
        .when(table_like(text), "table_cell")
        .when((F.col("x2") - F.col("x1") < 100) & (F.length(text) < 20), "label")
        .otherwise("paragraph")
    )
    return elements.withColumn("kind", kind)


def reading_order(elements: DataFrame) -> DataFrame:
    order = Window.partitionBy("page").orderBy((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2, "elem_id")
    return elements.withColumn("reading_order", F.row_number().over(order) - 1)


def columns(elements: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """(page, elem_id, column): by x centre, an element opens a column when it lies more than the tolerance from the column's first.

    The seed rule needs an ordered fold: one page at a time, inside the JVM."""
    centre = ((F.col("x1") + F.col("x2")) / 2).cast("double")
    pages = elements.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(centre.alias("x"), "elem_id"))).alias("e"))
    empty = F.expr("CAST(array() AS array<struct<elem_id:bigint,column:int>>)")

    def step(acc, e):
        new = acc["seed"].isNull() | (F.abs(e["x"] - acc["seed"]) > tolerance)
        number = acc["n"] + F.when(new, 1).otherwise(0)
        one = F.array(F.struct(e["elem_id"].cast("long").alias("elem_id"), number.alias("column")))
        return F.struct(F.when(new, e["x"]).otherwise(acc["seed"]).alias("seed"), number.alias("n"), F.concat(acc["out"], one).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("seed"), F.lit(-1).alias("n"), empty.alias("out"))
    folded = pages.select("page", F.explode(F.aggregate("e", start, step, lambda a: a["out"])).alias("c"))
    return folded.select("page", "c.elem_id", "c.column")


def structure(classified_elements: DataFrame) -> DataFrame:
    """Per page the first title in reading order and the counts of element groups."""
    count = lambda name, *kinds: F.sum(F.col("kind").isin(*kinds).cast("long")).alias(name)
    return reading_order(classified_elements).groupBy("page").agg(
        F.min_by("text", F.when(F.col("kind") == "title", F.col("reading_order"))).alias("title"),
        count("headings", "heading"),
        count("sections", "numbered_item"),
        count("tables", "table_header", "table_cell"),
        count("paragraphs", "paragraph"),
    )


def structure_lists(classified_elements: DataFrame) -> DataFrame:
    """Per page the first title in reading order, and the headings, sections, tables and paragraphs with text, place and box, each in that order."""
    item = lambda *more: F.struct(F.col("reading_order").alias("position"), "text", F.struct("x1", "y1", "x2", "y2").alias("bbox"), *more)
    held = lambda name, kinds, *more: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), item(*more)))).alias(name)
    return reading_order(classified_elements).groupBy("page").agg(
        F.min_by("text", F.when(F.col("kind") == "title", F.col("reading_order"))).alias("title"),
        held("headings", ["heading"]),
        held("sections", ["numbered_item"]),
        held("tables", ["table_header", "table_cell"], F.col("kind").alias("type")),
        held("paragraphs", ["paragraph"]),
    )
