"""Difference of two texts by lines, as joins and scans over hashes of the lines that both have: no Python worker; texts are read where their pair lies.

Lines that occur once on both sides are candidates; of those the longest run that rises on both sides is matched
(patience). What lies between two matches is a gap with candidates of its own, so the same is done again inside the gaps,
ROUNDS times in all. What is never matched was removed or added. Taking the removed lines of a difference away from the old text and putting
the added ones in gives the new text, whatever was matched.

pairs: rows (key, old, new), each an array of lines; null arrays count as empty, a null line as an empty one. Keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import scans
from chronolex.staging import staged

ROUNDS, CONTEXT = 3, 3


def rising(anchors: Column) -> Column:
    """Of an array of structs (i, j), sorted by i: those of a longest run with rising j."""
    kind = "array<struct<j:int,at:int>>"
    start = F.struct(F.expr(f"CAST(array() AS {kind})").alias("tails"), F.expr("CAST(array() AS array<int>)").alias("before"))

    def step(acc, a):
        place = F.size(F.filter(acc["tails"], lambda t: t["j"] < a["j"]))
        own = F.array(F.struct(a["j"].alias("j"), F.size(acc["before"]).alias("at")))
        tails = F.concat(F.slice(acc["tails"], F.lit(1), place), own, F.slice(acc["tails"], place + 2, F.greatest(F.size(acc["tails"]) - place - 1, F.lit(0))))
        before = F.when(place > 0, F.get(acc["tails"], place - 1)["at"]).otherwise(-1)
        return F.struct(tails.alias("tails"), F.concat(acc["before"], F.array(before)).alias("before"))

    return F.aggregate(anchors, start, step)


def _walk(anchors: Column, run: Column) -> Column:
    """The anchors on the way back from the last tail of rising()."""
    last = F.coalesce(F.get(run["tails"], F.size(run["tails"]) - 1)["at"], F.lit(-1))
    start = F.struct(last.alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    back = lambda acc, _: F.struct(F.coalesce(F.get(run["before"], acc["at"]), F.lit(-1)).alias("at"), F.concat(F.array(acc["at"]), acc["out"]).alias("out"))
    picked = F.aggregate(run["tails"], start, back, lambda acc: acc["out"])
    return F.transform(picked, lambda at: F.get(anchors, at))


def _lines(pairs: DataFrame, side: str) -> DataFrame:
    """(key, pos, h) of the lines of a side that the other side has, too: others are in no match. Lines go by two hashes, 96 bits."""
    lines = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit("")))
    both = F.array_intersect(lines(F.col("old")), lines(F.col("new")))
    shared = pairs.select("key", F.col(side).alias("_side"), both.alias("_both")).filter(F.size("_both") > 0)
    digest = F.struct(F.xxhash64("line").alias("a"), F.hash("line").alias("b")).alias("h")
    rows = shared.select("key", F.posexplode(lines(F.col("_side"))).alias("pos", "line")).select("key", "pos", digest)
    known = shared.select("key", F.explode("_both").alias("line")).select("key", digest)
    return rows.join(known, ["key", "h"], "left_semi").select("key", "pos", "h")


def _matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, i, j) of lines (key, gap, pos, h): unique in their gap on both sides, in the longest rising run of the gap."""
    once = lambda df, p: df.groupBy("key", "gap", "h").agg(F.count(F.lit(1)).alias("n"), F.first("pos").alias(p)).filter("n = 1").drop("n")
    both = once(old, "i").join(once(new, "j"), ["key", "gap", "h"]).groupBy("key", "gap").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("a"))
    run = both.withColumn("r", rising(F.col("a")))
    return run.select("key", F.explode(_walk(F.col("a"), F.col("r"))).alias("m")).select("key", "m.i", "m.j")


def _with_gaps(lines: DataFrame, matched: DataFrame, pos: str) -> DataFrame:
    """lines with `hit` (the old place of the line's match, null without) and `gap` (that of the last match up to the line, -1 without)."""
    found = lines.drop("hit", "gap").join(matched.select("key", F.col(pos).alias("pos"), F.col("i").alias("hit")), ["key", "pos"], "left")
    bucketed = found.withColumn("_b", F.floor(F.col("pos") / scans.SPLIT))
    return scans.scan(bucketed, ["key"], ["_b"], ["pos"], {"gap": ("last", F.col("hit"))}).drop("_b").withColumn("gap", F.coalesce("gap", F.lit(-1)))


def _matched(pairs: DataFrame, rounds: int) -> DataFrame:
    """(key, i, j) of all rounds; ends before when a round finds none."""
    old, new = (staged(_lines(pairs, side).withColumn("gap", F.lit(-1)).withColumn("hit", F.lit(None).cast("int")), "lines") for side in ("old", "new"))
    matched = None
    for n in range(rounds):
        fresh = staged(_matches(old.filter("hit IS NULL"), new.filter("hit IS NULL")), "matches")
        matched = fresh if matched is None else matched.unionByName(fresh)
        if n + 1 == rounds or not fresh.take(1):
            return matched
        old, new = (staged(_with_gaps(df, matched, pos), "lines") for df, pos in ((old, "i"), (new, "j")))
    return pairs.select("key", F.lit(0).alias("i"), F.lit(0).alias("j")).limit(0)


def differences(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, gap, kind, pos, op, line) of all lines: op is a space for a kept line, - for a removed and + for an added one; in order by gap, kind, pos.

    pairs is read for each side, and again for the lines; rounds go over shared lines' hashes only."""
    pairs = pairs.select("key", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("old", "new")])
    held = _matched(pairs, rounds).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_m"))
    # from each match, and from before the first one, to the next
    none = F.expr("CAST(array() AS array<struct<i:int,j:int>>)")
    begins = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), F.coalesce("_m", none))
    ends = F.concat(F.coalesce("_m", none), F.array(F.struct(F.size("old").alias("i"), F.size("new").alias("j"))))
    gaps = pairs.join(held, "key", "left").select("key", "old", "new", F.arrays_zip(begins.alias("b"), ends.alias("e")).alias("_g"))
    row = lambda gap, kind, pos, op, line: F.struct(gap.alias("gap"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), F.lit(op).alias("op"), F.coalesce(line, F.lit("")).alias("line"))
    cut = lambda c, after, end: F.slice(c, after + 2, F.greatest(end - after - 1, F.lit(0)))

    def between(g):
        i, j = g["b"]["i"], g["b"]["j"]
        kept = F.when(i >= 0, F.array(row(i, 0, i, " ", F.get("old", i)))).otherwise(F.array().cast(_ROW))
        removed = F.transform(cut("old", i, g["e"]["i"]), lambda x, n: row(i, 1, i + 1 + n, "-", x))
        added = F.transform(cut("new", j, g["e"]["j"]), lambda x, n: row(i, 2, j + 1 + n, "+", x))
        return F.concat(kept, removed, added)

    return gaps.select("key", F.explode(F.flatten(F.transform("_g", between))).alias("r")).select("key", "r.*")


_ROW = "array<struct<gap:int,kind:int,pos:int,op:string,line:string>>"


def applied(diff: DataFrame, new: bool = True) -> DataFrame:
    """(key, lines): the new text, or the old one, that a difference holds; keys without lines are not in it."""
    ordered = F.array_sort(F.collect_list(F.struct("gap", "kind", "pos", "line")))
    return diff.filter(F.col("op") != ("-" if new else "+")).groupBy("key").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))


def unified(diff: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(key, lines): the unified form, with headers and `context` kept lines around changes; keys without changes are not in it."""
    order = Window.partitionBy("key").orderBy("gap", "kind", "pos")
    rows = diff.withColumns({"n": F.row_number().over(order), "a": F.count_if(F.col("op") != "+").over(order), "b": F.count_if(F.col("op") != "-").over(order)})
    around = Window.partitionBy("key").orderBy("n").rowsBetween(-context, context)
    shown = rows.withColumn("near", F.max((F.col("op") != " ").cast("int")).over(around)).filter("near = 1")
    by_n = Window.partitionBy("key").orderBy("n")
    shown = shown.withColumn("new_hunk", F.when(F.col("n") - F.lag("n").over(by_n) == 1, 0).otherwise(1)).withColumn("hunk", F.sum("new_hunk").over(by_n))
    first = lambda c, op: F.min(F.col(c) - F.when(F.col("op") == op, 0).otherwise(1))
    hunks = shown.groupBy("key", "hunk").agg(first("a", "+").alias("a"), F.count_if(F.col("op") != "+").alias("la"), first("b", "-").alias("b"), F.count_if(F.col("op") != "-").alias("lb"), F.array_sort(F.collect_list(F.struct("n", F.concat("op", "line").alias("t")))).alias("t"))
    span = lambda start, n: F.when(F.col(n) == 1, (F.col(start) + 1).cast("string")).when(F.col(n) == 0, F.concat(F.col(start).cast("string"), F.lit(",0"))).otherwise(F.concat_ws(",", (F.col(start) + 1).cast("string"), F.col(n).cast("string")))
    head = F.concat(F.lit("@@ -"), span("a", "la"), F.lit(" +"), span("b", "lb"), F.lit(" @@"))
    said = hunks.select("key", "hunk", F.concat(F.array(head), F.transform("t", lambda x: x["t"])).alias("said"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("hunk", "said"))), lambda x: x["said"])
    return said.groupBy("key").agg(F.concat(F.array(F.lit("--- "), F.lit("+++ ")), F.flatten(listed)).alias("lines"))
