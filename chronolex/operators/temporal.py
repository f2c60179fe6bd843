"""Validity intervals, as-of filters, supersession, conflicts and differences between dates.

Spans are rows (query_id, span_id, text, document_id, effective_date, expiry_date, repeal_date, status,
precedence_weight, supersedes, superseded_by, ...). Null dates are unbounded. Everything is partitioned by query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import conflicts
from chronolex.operators.supersession import named_edges
from chronolex.staging import staged

# fixed values: the phrases of the rules
_FORCE = r"(?:effective|comes?\s+into\s+force|shall\s+come\s+into\s+force)(?:\s+on)?(?:\s+the)?\s*"
_CEASE = r"(?:expires?|ceases?\s+to\s+have\s+effect|valid\s+until)(?:\s+on)?(?:\s+the)?\s*"
_NUMERIC, _WORDY = r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})", r"([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})"
EFFECTIVE = (_FORCE + _NUMERIC, _FORCE + _WORDY, r"with\s+effect\s+from\s*" + _NUMERIC, r"w\.e\.f\.?\s*" + _NUMERIC)
EXPIRY = (_CEASE + _NUMERIC, _CEASE + _WORDY, r"shall\s+remain\s+in\s+force\s+until\s*" + _NUMERIC)
PUBLICATION = (r"published\s+(?:on\s+)?(?:the\s+)?" + _NUMERIC, r"gazette\s+(?:dated\s+)?" + _NUMERIC, r"notification\s+(?:dated\s+)?" + _NUMERIC)
_NAMES = r"\s+([A-Z0-9\s,./()-]+?)(?:\s+dated|\s+of|\.|$)"
SUPERSEDED_BY = (r"superseded\s+by" + _NAMES, r"replaced\s+by" + _NAMES, r"substituted\s+by" + _NAMES)
SUPERSEDES = (r"(?:supersedes?|replaces?|substitutes?)" + _NAMES, r"in\s+supersession\s+of" + _NAMES)
# fixed values: every match of a pattern has one of its cues, in either case; a text without them is spared the pattern
CUES = (
    dict.fromkeys(EFFECTIVE[:2], ("effective", "into"))
    | {EFFECTIVE[2]: ("from",), EFFECTIVE[3]: ("w.e.f",)}
    | dict.fromkeys(EXPIRY[:2], ("expire", "cease", "valid"))
    | {EXPIRY[2]: ("remain",)}
    | dict(zip(PUBLICATION, (("published",), ("gazette",), ("notification",))))
    | dict(zip(SUPERSEDED_BY, (("superseded",), ("replaced",), ("substituted",))))
    | {SUPERSEDES[0]: ("supersede", "replace", "substitute"), SUPERSEDES[1]: ("supersession",)}
)
STATUS = (
    ("active", "in force|current|valid|effective"),
    ("repealed", "repealed|revoked|superseded|replaced"),
    ("suspended", "suspended|stayed|postponed"),
    ("amended", "amended|modified|updated"),
)
DOCUMENT_TYPES = (
    ("constitution", r"\bconstitution\b"),
    ("act", r"\bact\b|\bstatute\b"),
    ("rule", r"\brules?\b|\bregulations?\b"),
    ("notification", r"\bnotification\b|\bgazette\b"),
    ("circular", r"\bcircular\b|\bmemorandum\b"),
    ("guideline", r"\bguidelines?\b|\bdirectives?\b"),
    ("order", r"\border\b|\bdecision\b"),
    ("advisory", r"\badvisory\b|\bguidance\b"),
)
WEIGHTS = {"constitution": 10.0, "act": 8.0, "rule": 6.0, "regulation": 5.0, "notification": 4.0, "circular": 3.0, "guideline": 2.0, "order": 1.5, "advisory": 1.0}


def parse_date(plain: Column) -> Column:
    """Day first, month first where that fails; null when it is no date. plain: with slashes and single spaces, a column rather than an expression, as it is read several times."""
    numeric = F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in ("d/M/yyyy", "M/d/yyyy")])
    return F.when(F.contains(plain, F.lit("/")), numeric).otherwise(F.try_to_timestamp(plain, F.lit("d MMMM yyyy"))).cast("timestamp_ntz")


def _has_any(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _cued(text: Column, pattern: str, found: Column) -> Column:
    """What is found by the pattern, null for a text without its cues."""
    return F.when(_has_any(F.lower(text), CUES[pattern]), found)


def _found_date(text: Column, pattern: str) -> Column:
    """What the pattern finds, with slashes and single spaces; null without a match."""
    found = F.translate(F.regexp_extract(text, f"(?i){pattern}", 1), "-", "/")
    found = F.regexp_replace(found, r"\s+", " ") if pattern.endswith(_WORDY) else found
    return F.nullif(_cued(text, pattern, found), F.lit(""))


def _found_name(text: Column, pattern: str) -> Column:
    return F.nullif(_cued(text, pattern, F.trim(F.regexp_extract(text, f"(?i){pattern}", 1))), F.lit(""))


def supersedes(text: Column) -> Column:
    """All names, comma lists split; null without any."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(_cued(text, p, F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1))), none) for p in SUPERSEDES]
    names = F.transform(F.flatten(F.transform(F.concat(*found), lambda m: F.split(m, ","))), lambda x: F.trim(x))
    return F.nullif(F.when(_has_any(F.lower(text), [w for p in SUPERSEDES for w in CUES[p]]), names), none)


def status(text: Column) -> Column:
    """The first group of which any phrase occurs anywhere, parts of words included; active without any."""
    low, out = F.lower(text), F.lit("active")
    for name, phrases in reversed(STATUS):
        out = F.when(_has_any(low, phrases.split("|")), name).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("guideline")
    for name, pattern in reversed(DOCUMENT_TYPES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def precedence_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), kind), F.lit(1.0))


def with_temporal_metadata(df: DataFrame, text: str = "text", published: Column | None = None) -> DataFrame:
    """df with effective_date, expiry_date, publication_date, superseded_by, supersedes and status of its texts; a published date given goes before one found.

    Each pattern is tried once on texts with its cues, in a projection of its own; dates are parsed in the next, which
    reads each find several times and so is not merged with the first."""
    t, kinds = F.col(text), {"effective_date": EFFECTIVE, "expiry_date": EXPIRY, "publication_date": PUBLICATION}
    finds = {f"_{name}_{i}": _found_date(t, p) for name, patterns in kinds.items() for i, p in enumerate(patterns)}
    names = {f"_superseded_by_{i}": _found_name(t, p) for i, p in enumerate(SUPERSEDED_BY)}
    out = df.withColumns(finds | names | {"supersedes": supersedes(t), "status": status(t)})
    dates = {name: F.coalesce(*([published] if published is not None and name == "publication_date" else []), *[parse_date(F.col(f"_{name}_{i}")) for i in range(len(patterns))]) for name, patterns in kinds.items()}
    return out.withColumns(dates | {"superseded_by": F.coalesce(*names)}).drop(*finds, *names)


def temporal_spans(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """hits (query_id, chunk_id, text, spans, score, confidence) -> one temporal span a span, typed by the chunk's text; columns that `keep` names stay."""
    rows = hits.select("query_id", "chunk_id", *keep, F.col("text").alias("chunk_text"), "score", "confidence", F.posexplode("spans").alias("pos", "span"))
    rows = rows.select("*", F.col("span.text").alias("text"), F.coalesce(F.col("span.byte_start"), F.lit(0)).alias("byte_start"))
    rows = with_temporal_metadata(rows).withColumn("document_type", document_type(F.col("chunk_text")))
    return rows.withColumns(
        {
            "span_id": F.concat_ws("_", "chunk_id", "byte_start"),
            "document_id": F.split("chunk_id", "_")[0],
            "precedence_weight": precedence_weight(F.col("document_type")),
            "repeal_date": F.lit(None).cast("timestamp_ntz"),
            "supersedes": F.coalesce("supersedes", F.array().cast("array<string>")),
        }
    ).drop("chunk_text", "span")


# --- as-of ----------------------------------------------------------------------------------------
def in_interval(as_of: Column) -> Column:
    """effective <= as_of <= expiry, repeal; nulls are unbounded, bounds belong to the interval."""
    after = F.col("effective_date").isNull() | (as_of >= F.col("effective_date"))
    return after & (F.col("expiry_date").isNull() | (as_of <= F.col("expiry_date"))) & (F.col("repeal_date").isNull() | (as_of <= F.col("repeal_date")))


def hit_valid(as_of: Column) -> Column:
    after = F.col("effective_date").isNull() | (as_of >= F.col("effective_date"))
    return after & (F.col("expiry_date").isNull() | (as_of <= F.col("expiry_date"))) & ~F.col("status").isin("repealed", "suspended")


def simply_valid(as_of: Column) -> Column:
    return in_interval(as_of) & (F.col("status") == "active")


def active(as_of: Column) -> Column:
    return in_interval(as_of) & F.col("status").isin("active", "amended")


def supersession_edges(spans: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(query_id, superseding, superseded) of spans of the same query, from both directions; independent of row order.

    `supersedes` and `superseded_by` hold span ids, or, with titles (document_id, key), names of documents."""
    if titles is not None:
        return named_edges(spans, titles)
    forward = spans.select("query_id", F.col("span_id").alias("superseding"), F.explode("supersedes").alias("superseded"))
    backward = spans.filter("superseded_by IS NOT NULL").select("query_id", F.col("superseded_by").alias("superseding"), F.col("span_id").alias("superseded"))
    return forward.unionByName(backward).distinct()


def active_spans(spans: DataFrame, as_of: Column, titles: DataFrame | None = None) -> DataFrame:
    """Spans active as of the date that no active span supersedes."""
    now = spans.filter(active(as_of))
    edges = supersession_edges(spans, titles).join(now.select("query_id", F.col("span_id").alias("superseding")), ["query_id", "superseding"], "left_semi")
    return now.join(edges.select("query_id", F.col("superseded").alias("span_id")), ["query_id", "span_id"], "left_anti")


def split_by_date(spans: DataFrame, as_of: Column, precedence: bool = True, titles: DataFrame | None = None) -> DataFrame:
    """spans with `valid`: the two values partition the input."""
    if not precedence:
        return spans.withColumn("valid", simply_valid(as_of))
    kept = active_spans(spans, as_of, titles).select("query_id", "span_id").distinct().withColumn("_kept", F.lit(True))
    return spans.join(kept, ["query_id", "span_id"], "left").withColumn("valid", F.coalesce("_kept", F.lit(False))).drop("_kept")


def precedence_score(as_of: Column) -> Column:
    """100 and up to 10 by age in whole days when in effect, 50 / 30 / -100 by status, -75 superseded, 25 superseding."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("effective_date").cast("timestamp"))) / 86_400_000_000)
    in_effect = F.when(F.col("effective_date") <= as_of, 100.0 + F.least(days / 365, F.lit(10.0))).otherwise(0.0)
    by_status = F.when(F.col("status") == "active", 50.0).when(F.col("status") == "amended", 30.0).when(F.col("status").isin("repealed", "suspended"), -100.0).otherwise(0.0)
    older = F.when(F.col("superseded_by").isNotNull(), -75.0).otherwise(0.0)
    newer = F.when(F.coalesce(F.size("supersedes"), F.lit(0)) > 0, 25.0).otherwise(0.0)
    return in_effect + by_status + older + newer


# --- conflicts ------------------------------------------------------------------------------------
def metadata_conflicts(spans: DataFrame) -> DataFrame:
    """Pairs of one query where one names the other as superseded, or with equal effective dates and different status.

    Candidates come from equi-joins, on the dates and on the supersession edges, so no query's spans are all paired."""
    rows = spans.select("query_id", "pos", "span_id")
    side = lambda x: rows.select("query_id", *[F.col(c).alias(f"{x}_{c}") for c in ("pos", "span_id")])
    edges = supersession_edges(spans)
    named = edges.join(side("x").withColumnRenamed("x_span_id", "superseding"), ["query_id", "superseding"]).join(side("y").withColumnRenamed("y_span_id", "superseded"), ["query_id", "superseded"]).filter("x_pos <> y_pos")
    forward = F.col("x_pos") < F.col("y_pos")
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    named = named.select("query_id", pick("x_pos", "y_pos").alias("a_pos"), pick("y_pos", "x_pos").alias("b_pos"), pick("superseding", "superseded").alias("first"), pick("superseded", "superseding").alias("second"), forward.alias("f"))
    named = named.groupBy("query_id", "a_pos", "b_pos", "first", "second").agg(F.max("f").alias("f"))
    named = named.select("query_id", "first", "second", F.lit("supersession").alias("conflict_type"), F.when(F.col("f"), "prefer_first").otherwise("prefer_second").alias("resolution"))
    return named.unionByName(status_conflicts(spans))


def status_conflicts(spans: DataFrame) -> DataFrame:
    """The pairs of metadata_conflicts with equal dates and different status of which neither names the other.

    There are as many as the dates make, so they are told apart where the dates meet: spans go through a shuffle, pairs never do."""
    rows = spans.select("query_id", "effective_date", "pos", "span_id", "status", "supersedes", "superseded_by").filter("effective_date IS NOT NULL").distinct()
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "query_id", "effective_date")  # by a number: few bytes make many pairs
    side = lambda x: dealt.select("query_id", "effective_date", *[F.col(c).alias(f"{x}_{c}") for c in ("pos", "span_id", "status", "supersedes", "superseded_by")])
    names = lambda x, y: F.coalesce(F.array_contains(f"{x}_supersedes", F.col(f"{y}_span_id")), F.lit(False)) | F.coalesce(F.col(f"{x}_superseded_by") == F.col(f"{y}_span_id"), F.lit(False))
    pairs = side("a").hint("merge").join(side("b"), ["query_id", "effective_date"]).filter(F.expr("a_pos < b_pos AND a_status <> b_status") & ~names("a", "b") & ~names("b", "a"))
    prefer = F.when(F.col("a_status") == "active", "prefer_first").when(F.col("b_status") == "active", "prefer_second").otherwise("prefer_latest")
    return pairs.select("query_id", F.col("a_span_id").alias("first"), F.col("b_span_id").alias("second"), F.lit("status_conflict").alias("conflict_type"), prefer.alias("resolution"))


def metadata_conflict_classes(spans: DataFrame) -> DataFrame:
    """metadata_conflicts in rows that grow with the input: (query_id, first, second, conflict_type, resolution).

    Spans of one query, date and status are a class, named by its least span_id. member: first is the class of span second,
    resolution the status. status_conflict: classes of one date, first < second; each span of one conflicts with each of the
    other. supersession: a pair of spans of which one names the other, the earlier by pos first; it goes before what their classes say."""
    rows = spans.select("query_id", "pos", "span_id", "effective_date", "status")
    dated = rows.filter("effective_date IS NOT NULL")
    classes = staged(dated.groupBy("query_id", "effective_date", "status").agg(F.min("span_id").alias("class_id")), "classes")
    held = dated.join(classes, ["query_id", "effective_date", "status"]).select("query_id", F.col("class_id").alias("first"), F.col("span_id").alias("second"), F.lit("member").alias("conflict_type"), F.col("status").alias("resolution"))
    side = lambda x: classes.select("query_id", "effective_date", F.col("class_id").alias(x), F.col("status").alias(f"{x}_status"))
    prefer = F.when(F.col("first_status") == "active", "prefer_first").when(F.col("second_status") == "active", "prefer_second").otherwise("prefer_latest")
    differ = side("first").join(side("second"), ["query_id", "effective_date"]).filter("first < second AND first_status <> second_status")
    differ = differ.select("query_id", "first", "second", F.lit("status_conflict").alias("conflict_type"), prefer.alias("resolution"))
    at = lambda x: rows.select("query_id", F.col("span_id").alias(x), F.col("pos").alias(f"{x}_pos"))
    named = supersession_edges(spans).join(at("superseding"), ["query_id", "superseding"]).join(at("superseded"), ["query_id", "superseded"]).filter("superseding_pos <> superseded_pos")
    newer_first = F.col("superseding_pos") < F.col("superseded_pos")
    pair = [F.when(newer_first, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("superseding", "superseded", "first"), ("superseded", "superseding", "second"))]
    named = named.select("query_id", *pair, newer_first.alias("f")).groupBy("query_id", "first", "second").agg(F.max("f").alias("f"))
    named = named.select("query_id", "first", "second", F.lit("supersession").alias("conflict_type"), F.when(F.col("f"), "prefer_first").otherwise("prefer_second").alias("resolution"))
    return held.unionByName(differ).unionByName(named)


def versioned_answer(spans: DataFrame, as_of: Column, threshold: float = 0.8) -> DataFrame:
    """(query_id, total, valid, expired, conflicts, resolved): spans valid at the date, conflicts among them, and what is left when each is resolved."""
    split = split_by_date(spans, as_of)
    split = staged(split, "split")
    valid = split.filter("valid").drop("valid")
    membership = staged(conflicts.members(valid), "members")
    linked = staged(conflicts.links(valid, membership, threshold), "links")
    left = conflicts.resolve(valid, membership, linked).groupBy("query_id").agg(F.count(F.lit(1)).alias("resolved"))
    counts = split.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("expired"))
    found = conflicts.pair_count(valid, membership, linked)
    return counts.join(found, "query_id", "left").join(left, "query_id", "left").fillna(0, ["conflicts", "resolved"])


# --- answers at two dates -------------------------------------------------------------------------
def answer_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, text, change): added, removed or modified between two valid sets, told apart by text."""
    side = lambda df, s: df.select("query_id", "text", *[F.col(c).alias(f"{s}_{c}") for c in ("effective_date", "status", "precedence_weight")]).withColumn(f"in_{s}", F.lit(True))
    both = side(old, "old").join(side(new, "new"), ["query_id", "text"], "full_outer")
    same = F.lit(True)
    for c in ("effective_date", "status", "precedence_weight"):
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "modified").otherwise("same")
    return both.withColumn("change", change).filter("change <> 'same'").select("query_id", "text", "change", F.coalesce("new_precedence_weight", "old_precedence_weight").alias("weight"))


def change_score(diff: DataFrame) -> DataFrame:
    weight = F.when(F.col("change") == "modified", F.col("weight") * 0.5).otherwise(F.col("weight"))
    return diff.groupBy("query_id").agg(F.sum(weight).alias("change_score"), *[F.sum((F.col("change") == c).cast("long")).alias(c) for c in ("added", "removed", "modified")])


def shortened(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _iso(day: Column) -> Column:
    """A date as text: microseconds where there are any."""
    whole = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", day) == day, whole).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def diff_view(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that show the difference of two valid sets, spans told apart by (query_id, text): change, text cut to 100 characters,
    ISO dates; type and weight of what was added or removed, both states and dates of what was modified.

    Of rows with one text in a set the one with the greatest (weight, date, status) counts."""
    fields = ("precedence_weight", "effective_date", "status", "document_type")

    def side(df, s):
        best = F.max(F.struct(*fields)).alias("x")
        return df.groupBy("query_id", "text").agg(best).select("query_id", "text", *[F.col(f"x.{c}").alias(f"{s}_{c}") for c in fields], F.lit(True).alias(f"in_{s}"))

    both = side(old, "old").join(side(new, "new"), ["query_id", "text"], "full_outer")
    same = F.lit(True)
    for c in ("effective_date", "status", "precedence_weight"):
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "modified")
    one = F.col("change") != "modified"
    either = lambda c: F.when(one, F.when(F.col("change") == "added", F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")))
    rows = both.withColumn("change", change).filter("change IS NOT NULL")
    return rows.select(
        "query_id", "change", shortened(F.col("text")).alias("text"), _iso(either("effective_date")).alias("effective_date"), F.when(one, F.coalesce(either("document_type"), F.lit("unknown"))).alias("document_type"), either("precedence_weight").alias("precedence_weight"),
        *[F.when(~one, F.col(f"{s}_status")).alias(f"{s}_status") for s in ("old", "new")], *[F.when(~one, _iso(F.col(f"{s}_effective_date"))).alias(f"{s}_effective") for s in ("old", "new")],
    )


def statistics(spans: DataFrame) -> DataFrame:
    """(dimension, value, n, earliest and latest of both dates, superseding) over all spans and by document type, status and whole-number weight, in one scan.

    superseding: spans that name a superseding or superseded one. A null type counts as unknown, a null status or weight has a null value."""
    whole = F.floor("precedence_weight")
    bucket = F.when(whole.isNotNull(), F.concat_ws("-", whole.cast("string"), (whole + 1).cast("string")))
    kind = F.coalesce("document_type", F.lit("unknown")) if "document_type" in spans.columns else F.lit("unknown")
    keyed = spans.select("status", bucket.alias("weight"), kind.alias("document_type"), "effective_date", "expiry_date", (F.col("superseded_by").isNotNull() | (F.coalesce(F.size("supersedes"), F.lit(0)) > 0)).alias("_s"))
    names = ("document_type", "status", "weight")
    bounds = [f(c).alias(f"{n}_{s}") for c, s in (("effective_date", "effective"), ("expiry_date", "expiry")) for n, f in (("earliest", F.min), ("latest", F.max))]
    sets = keyed.groupingSets([(), *[(n,) for n in names]], *names).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), *bounds, F.count_if("_s").alias("superseding"))
    marks = {7: "total"} | {7 - (4 >> i): n for i, n in enumerate(names)}  # the set bits are the columns that are not grouped by
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, name in marks.items():
        dimension = F.when(F.col("_g") == g, name).otherwise(dimension)
        value = F.when(F.col("_g") == g, F.lit("all") if name == "total" else F.col(name)).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n", *[c for c in sets.columns if c.startswith(("earliest", "latest"))], "superseding")
