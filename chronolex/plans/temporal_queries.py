"""Temporal and span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators import conflicts as cf
from chronolex.operators import spans as sp
from chronolex.operators import supersession as su
from chronolex.operators import temporal as tp
from chronolex.plans import fixed as fx
from chronolex.plans.inputs import AS_OF, EARLIER, FIFTIETH, INTERVALS, LEGAL, LEGAL_SPARK, SPANS, WIDE_SPANS, intervals, legal, sql, table, temporal
from chronolex.staging import staged

NOTICES = 100_000  # of a task
_DATE = lambda day: F.lit(day).cast("timestamp_ntz")


def _metadata(s, d):
    rows = tp.with_temporal_metadata(legal(s, d))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("doc_id", day("effective_date"), day("expiry_date"), day("publication_date"), "superseded_by", F.array_join("supersedes", "|").alias("supersedes"), "status")


def _types(s, d):
    kind = tp.document_type(F.col("text"))
    return legal(s, d).select("doc_id", kind.alias("document_type"), tp.precedence_weight(kind).alias("weight"))


def _split(s, d):
    return tp.split_by_date(temporal(s, d), _DATE(AS_OF)).select("query_id", "span_id", "valid")


def _diff(s, d):
    spans = temporal(s, d)
    kept = lambda day: tp.active_spans(spans, _DATE(day)).groupBy("query_id", "text").agg(F.max("effective_date").alias("effective_date"), F.max("status").alias("status"), F.max("precedence_weight").alias("precedence_weight"))
    return tp.answer_diff(kept(EARLIER), kept(AS_OF))


def _metadata_conflicts(s, d):
    """Classes and pairs of classes, pairs that name each other, and each pair of spans that differs in status (status_pair)."""
    spans = staged(temporal(s, d, FIFTIETH), "spans")
    return tp.metadata_conflict_classes(spans).unionByName(tp.status_conflicts(spans).withColumn("conflict_type", F.lit("status_pair")))


def _members(s, d):
    return cf.members(temporal(s, d))


def _worded(s, d, *query):
    """Temporal spans as far as their conflicts need them, computed once."""
    return staged(temporal(s, d, *query).select("query_id", "span_id", "document_id", "text", "precedence_weight", "effective_date"), "spans")


def _links(s, d):
    """Links between classes, and the membership that gives the pairs of spans from them."""
    spans = _worded(s, d, FIFTIETH)
    membership = staged(cf.members(spans), "members")
    linked = cf.links(spans, membership).select("query_id", F.lit("link").alias("kind"), "first", "second", F.lit(None).cast("long").alias("document_id"), F.round("similarity", 6).alias("similarity"))
    held = spans.join(membership, ["query_id", "span_id"]).select("query_id", F.lit("member").alias("kind"), F.col("class_id").alias("first"), F.col("span_id").alias("second"), "document_id", F.lit(1.0).alias("similarity"))
    return linked.unionByName(held)


def _resolved(s, d):
    spans = _worded(s, d, FIFTIETH)
    membership = staged(cf.members(spans), "members")
    return cf.resolve(spans, membership, staged(cf.links(spans, membership), "links")).select("query_id", "span_id")


def _conflict_counts(s, d):
    spans = _worded(s, d)
    membership = staged(cf.members(spans), "members")
    return cf.pair_count(spans, membership, staged(cf.links(spans, membership), "links"))


def _spread_legal(s, d):
    """Legal notices, dealt by their orders to tasks of about NOTICES before their texts are made: patterns cost far more than a row's few bytes tell."""
    orders = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return sql(s, d, LEGAL_SPARK, orders=orders.repartition(max(1, -(-orders.count() // NOTICES)), "o_orderkey"))


def _notices(s, d, *keep):
    """Notices of orders as temporal spans, sixty-four to a query, each with the names that it gives and the key of its own title; columns that `keep` names stay.

    Texts are made and read once, and only what is found in them is staged."""
    rows = tp.with_temporal_metadata(_spread_legal(s, d)).withColumns({"supersedes": F.coalesce("supersedes", F.array().cast("array<string>")), "key": su.title_key(F.col("text"))})
    return staged(rows.select(F.expr("doc_id DIV 64").alias("query_id"), F.col("doc_id").alias("span_id"), F.col("doc_id").alias("document_id"), *keep, "effective_date", "expiry_date", F.lit(None).cast("timestamp_ntz").alias("repeal_date"), "status", "supersedes", "superseded_by", "key"), "spans")


def _keys(rows):
    return rows.select("document_id", "key").filter("key IS NOT NULL")


def _titles(s, d):
    """Staged before rows without a key go, as the filter would find every key a second time."""
    return _keys(staged(_spread_legal(s, d).select(F.col("doc_id").alias("document_id"), su.title_key(F.col("text")).alias("key")), "titles"))


def _named_edges(s, d):
    spans = _notices(s, d)
    return su.named_edges(spans, _keys(spans))


def _named_active(s, d):
    spans = _notices(s, d)
    return tp.active_spans(spans, _DATE(AS_OF), _keys(spans)).select("query_id", "span_id")


def _view(s, d):
    """Notices that hold at one of two dates or differ between them."""
    kind = tp.document_type(F.col("text"))
    spans = staged(_notices(s, d, "text").withColumn("document_type", kind).withColumn("precedence_weight", tp.precedence_weight(kind)), "typed")
    return tp.diff_view(*[tp.active_spans(spans, _DATE(day), _keys(spans)) for day in (EARLIER, AS_OF)])


def _statistics(s, d):
    spans = temporal(s, d)
    out = tp.statistics(spans.withColumn("document_type", F.when(F.col("span_id") % 9 > 0, tp.document_type(F.col("text")))))
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in out.columns if c.startswith(("earliest", "latest"))]
    return out.select("dimension", "value", "n", *days, "superseding")


def _overlap(s, d):
    spans = intervals(s, d)
    return sp.overlapping(spans, spans)


def _merged(touching, gap):
    def run(s, d):
        out = sp.merge_adjacent(intervals(s, d), gap, touching)
        return out.select("document_id", "start", F.col("end").alias("end_"), F.sha2("text", 256).alias("digest"), "page_num", F.round("confidence", 6).alias("confidence"), "section_id", "n_spans")

    return run


QUERIES = {
    "temporal_meta": _metadata,
    "doc_type": _types,
    "hit_valid": lambda s, d: temporal(s, d).select("span_id", tp.hit_valid(_DATE(AS_OF)).alias("valid")),
    "asof_simple": lambda s, d: temporal(s, d).filter(tp.simply_valid(_DATE(AS_OF))).select("query_id", "span_id"),
    "asof_split": _split,
    "active_not_superseded": lambda s, d: tp.active_spans(temporal(s, d), _DATE(AS_OF)).select("query_id", "span_id"),
    "supersession_edges": lambda s, d: tp.supersession_edges(temporal(s, d)),
    "precedence_score": lambda s, d: temporal(s, d).select("span_id", F.round(tp.precedence_score(_DATE(AS_OF)), 6).alias("score")),
    "meta_conflicts": _metadata_conflicts,
    "supersession_names": _named_edges,
    "active_by_name": _named_active,
    "document_titles": _titles,
    "conflict_members": _members,
    "text_conflicts": _links,
    "conflict_counts": _conflict_counts,
    "conflict_resolve": _resolved,
    "versioned_answer": lambda s, d: tp.versioned_answer(temporal(s, d, FIFTIETH), _DATE(AS_OF)),
    "answer_diff": _diff,
    "change_score": lambda s, d: tp.change_score(_diff(s, d)).withColumn("change_score", F.round("change_score", 6)),
    "diff_view": _view,
    "temporal_stats": _statistics,
    "span_overlap": _overlap,
    "span_merge_overlap": _merged(False, 0),
    "span_merge_gap": _merged(True, 5),
    "span_confident": lambda s, d: sp.confident(intervals(s, d), 0.5).select("span_id"),
    "span_groups": lambda s, d: sp.by_document(intervals(s, d)).select("document_id", F.array_join(F.transform("spans", lambda x: x["span_id"]), ",").alias("span_ids")),
    "span_citations": lambda s, d: sp.citations(intervals(s, d)).select("span_id", "span_hash"),
    "span_integrity": lambda s, d: sp.integrity_report(intervals(s, d).withColumn("end", F.when(F.col("span_id") % 50 == 0, F.col("start")).otherwise(F.col("end"))).withColumn("text", F.when(F.col("span_id") % 70 == 1, F.lit(" ")).otherwise(F.col("text")))),
    "span_resolve": lambda s, d: sp.resolve_overlaps(intervals(s, d)).select("span_id"),
    "span_context": lambda s, d: sp.context(intervals(s, d)),
}

_OF = f"TIMESTAMP '{AS_OF}'"
_ERA = f"TIMESTAMP '{EARLIER}'"
_IN = "(effective_date IS NULL OR {d} >= effective_date) AND (expiry_date IS NULL OR {d} <= expiry_date) AND (repeal_date IS NULL OR {d} <= repeal_date)"


def _active(day: str) -> str:
    return f"""SELECT * FROM s WHERE {_IN.format(d=day)} AND status IN ('active', 'amended')"""


def _kept(day: str) -> str:
    return f"""SELECT a.* FROM ({_active(day)}) a WHERE NOT EXISTS (SELECT 1 FROM ({_active(day)}) b WHERE b.query_id = a.query_id AND (b.older = a.span_id OR a.superseded_by = b.span_id))"""


_WITH = f"WITH s AS ({SPANS})"
_WIDE = f"WITH s AS ({WIDE_SPANS})"


def _first(patterns) -> str:
    days = []
    for p in patterns:
        x = f"regexp_replace(regexp_replace(nullif(regexp_extract(text, '(?i){p}', 1), ''), '-', '/', 'g'), '\\s+', ' ', 'g')"
        days.append(f"coalesce(try_strptime({x}, '%d/%m/%Y'), try_strptime({x}, '%m/%d/%Y'), try_strptime({x}, '%d %B %Y'))")
    return f"strftime(coalesce({', '.join(days)}), '%Y-%m-%d')"


def _cases(rules, default, test="regexp_matches(lower(text), '{p}')") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(p=p)} THEN '{k}'" for k, p in rules) + f" ELSE '{default}' END"


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> ''))"
_PAIRS = f"""w AS (SELECT *, {_WORDS} AS words FROM s),
    u AS (SELECT DISTINCT query_id, text, words FROM w),
    t AS (SELECT a.query_id, a.text AS ta, b.text AS tb, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS similarity FROM u a JOIN u b ON a.query_id = b.query_id),
    p AS (SELECT a.query_id, a.span_id AS first, b.span_id AS second, round(t.similarity, 6) AS similarity,
      CASE WHEN a.precedence_weight > b.precedence_weight THEN a.span_id WHEN a.precedence_weight < b.precedence_weight THEN b.span_id WHEN b.effective_date > a.effective_date THEN b.span_id ELSE a.span_id END AS winner
      FROM t JOIN w a ON a.query_id = t.query_id AND a.text = t.ta JOIN w b ON b.query_id = t.query_id AND b.text = t.tb
      WHERE t.similarity > 0.8 AND a.span_id < b.span_id AND a.document_id <> b.document_id)"""
_CLASSES = f"""w AS (SELECT *, list_sort({_WORDS}) AS words FROM s), c AS (SELECT query_id, span_id, words, min(span_id) OVER (PARTITION BY query_id, words) AS class_id FROM w WHERE len(words) > 0),
    h AS (SELECT query_id, class_id, words FROM c WHERE span_id = class_id),
    k AS (SELECT a.query_id, a.class_id AS first, b.class_id AS second, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6)::DOUBLE AS similarity FROM h a JOIN h b ON a.query_id = b.query_id AND a.class_id <= b.class_id
      WHERE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) > 0.8)"""
# fixed values: kinds of documents that a title names
_KINDS = "act|statute|order|circular|notification|rule|regulation|guideline|directive|memorandum|advisory|constitution|decision"
_TITLED = rf"'(?i)\b({_KINDS})s?\s+(?:(?:no\b\.?|number\b)\s*)?([0-9]+[A-Za-z0-9/-]*)'"


def _key(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace(trim(regexp_replace(upper({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '\b(?:THE|THIS|NO|NUMBER)\b', ' ', 'g'), '\b({_KINDS.upper()})S\b', '\1', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"


_DATES = f"{_first(fx.EFFECTIVE).replace('strftime(', '(', 1).rsplit(',', 1)[0]}) AS effective_date, {_first(fx.EXPIRY).replace('strftime(', '(', 1).rsplit(',', 1)[0]}) AS expiry_date, {_cases(fx.STATUS, 'active')} AS status"
_NOTICES = rf"""WITH l AS ({LEGAL}), t0 AS (SELECT doc_id AS document_id, regexp_extract(text, {_TITLED}, 1) AS kind, regexp_extract(text, {_TITLED}, 2) AS number FROM l),
    t AS (SELECT document_id, {_key("kind || ' ' || number")} AS key FROM t0 WHERE kind <> ''),
    n0 AS (SELECT doc_id, unnest(list_transform(flatten(list_transform(list_concat({", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in fx.SUPERSEDES)}), lambda m: string_split(m, ','))), lambda x: trim(x))) AS name, TRUE AS newer FROM l
      UNION ALL SELECT doc_id, coalesce({", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 1)), '')" for p in fx.SUPERSEDED_BY)}), FALSE FROM l),
    n AS (SELECT DISTINCT doc_id, newer, {_key("name")} AS key FROM n0 WHERE name IS NOT NULL),
    e AS (SELECT DISTINCT doc_id // 64 AS query_id, CASE WHEN newer THEN doc_id ELSE document_id END AS superseding, CASE WHEN newer THEN document_id ELSE doc_id END AS superseded
      FROM n JOIN t USING (key) WHERE document_id <> doc_id AND document_id // 64 = doc_id // 64 AND regexp_matches(key, '[0-9]| '))"""
_DIFF = f"""o AS (SELECT query_id, text, max(effective_date) e, max(status) st, max(precedence_weight) w FROM ({_kept(_ERA)}) GROUP BY ALL),
    n AS (SELECT query_id, text, max(effective_date) e, max(status) st, max(precedence_weight) w FROM ({_kept(_OF)}) GROUP BY ALL),
    d AS (SELECT query_id, text, CASE WHEN o.w IS NULL THEN 'added' WHEN n.w IS NULL THEN 'removed' WHEN o.e IS DISTINCT FROM n.e OR o.st <> n.st OR o.w <> n.w THEN 'modified' END AS change, coalesce(n.w, o.w) AS weight
      FROM o FULL JOIN n USING (query_id, text))"""
_SUP = "(a.older = b.span_id OR b.superseded_by = a.span_id)"
_SUB = "(b.older = a.span_id OR a.superseded_by = b.span_id)"
_I = f"WITH i AS ({INTERVALS})"
_HIT = "a.document_id = b.document_id AND a.span_id <> b.span_id AND NOT (a.\"end\" <= b.start OR b.\"end\" <= a.start)"


def _islands(test: str) -> str:
    return f"""{_I}, r AS (SELECT *, max("end") OVER (PARTITION BY document_id ORDER BY start, "end", span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR NOT ({test}) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY start, "end", span_id) AS island FROM r)
    SELECT document_id, min(start) AS start, max("end") AS end_, sha256(string_agg(text, ' ' ORDER BY start, "end", span_id)) AS digest, min(page_num) AS page_num, round(min(confidence), 6) AS confidence,
    string_agg(section_id, '+' ORDER BY start, "end", span_id) AS section_id, count(*) AS n_spans FROM n GROUP BY document_id, island"""


ORACLE = {
    "temporal_meta": rf"""SELECT doc_id, {_first(fx.EFFECTIVE)} AS effective_date, {_first(fx.EXPIRY)} AS expiry_date, {_first(fx.PUBLICATION)} AS publication_date,
        coalesce({", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 1)), '')" for p in fx.SUPERSEDED_BY)}) AS superseded_by,
        nullif(array_to_string(list_transform(flatten(list_transform(list_concat({", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in fx.SUPERSEDES)}), lambda m: string_split(m, ','))), lambda x: trim(x)), '|'), '') AS supersedes,
        {_cases(fx.STATUS, "active")} AS status FROM ({LEGAL})""",
    "doc_type": f"""WITH t AS (SELECT doc_id, {_cases(fx.DOCUMENT_TYPES, "guideline")} AS document_type FROM ({LEGAL}))
        SELECT doc_id, document_type, CASE document_type {" ".join(f"WHEN '{k}' THEN {w}" for k, w in fx.WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS weight FROM t""",
    "hit_valid": f"""{_WITH} SELECT span_id, (effective_date IS NULL OR {_OF} >= effective_date) AND (expiry_date IS NULL OR {_OF} <= expiry_date) AND status NOT IN ('repealed', 'suspended') AS valid FROM s""",
    "asof_simple": f"{_WITH} SELECT query_id, span_id FROM s WHERE {_IN.format(d=_OF)} AND status = 'active'",
    "asof_split": f"{_WITH}, k AS ({_kept(_OF)}) SELECT query_id, span_id, span_id IN (SELECT span_id FROM k) AS valid FROM s",
    "active_not_superseded": f"{_WITH}, k AS ({_kept(_OF)}) SELECT query_id, span_id FROM k",
    "supersession_edges": f"{_WITH} SELECT query_id, span_id AS superseding, older AS superseded FROM s WHERE older IS NOT NULL UNION SELECT query_id, superseded_by, span_id FROM s WHERE superseded_by IS NOT NULL",
    "precedence_score": f"""{_WITH} SELECT span_id, round(CASE WHEN effective_date <= {_OF} THEN 100 + least(floor((epoch_us({_OF}) - epoch_us(effective_date)) / 86400000000.0) / 365, 10) ELSE 0 END
        + CASE status WHEN 'active' THEN 50 WHEN 'amended' THEN 30 WHEN 'repealed' THEN -100 WHEN 'suspended' THEN -100 ELSE 0 END + CASE WHEN superseded_by IS NOT NULL THEN -75 ELSE 0 END + CASE WHEN older IS NOT NULL THEN 25 ELSE 0 END, 6) AS score FROM s""",
    "meta_conflicts": f"""{_WIDE}, m AS (SELECT query_id, span_id, status, effective_date, min(span_id) OVER (PARTITION BY query_id, effective_date, status) AS c FROM s WHERE effective_date IS NOT NULL), h AS (SELECT * FROM m WHERE span_id = c),
          p AS (SELECT a.query_id, a.span_id AS first, b.span_id AS second, coalesce({_SUP}, FALSE) AS f, coalesce({_SUB}, FALSE) AS g, a.status AS sa, b.status AS sb, a.effective_date = b.effective_date AS same
            FROM s a JOIN s b ON a.query_id = b.query_id AND a.pos < b.pos AND (a.effective_date = b.effective_date OR a.document_id = b.document_id))
        SELECT query_id, c AS first, span_id AS second, 'member' AS conflict_type, status AS resolution FROM m
        UNION ALL SELECT a.query_id, a.c, b.c, 'status_conflict', CASE WHEN a.status = 'active' THEN 'prefer_first' WHEN b.status = 'active' THEN 'prefer_second' ELSE 'prefer_latest' END FROM h a JOIN h b ON a.query_id = b.query_id AND a.effective_date = b.effective_date AND a.c < b.c
        UNION ALL SELECT query_id, first, second, 'supersession', CASE WHEN f THEN 'prefer_first' ELSE 'prefer_second' END FROM p WHERE f OR g
        UNION ALL SELECT query_id, first, second, 'status_pair', CASE WHEN sa = 'active' THEN 'prefer_first' WHEN sb = 'active' THEN 'prefer_second' ELSE 'prefer_latest' END FROM p WHERE NOT (f OR g) AND coalesce(same, FALSE) AND sa <> sb""",
    "conflict_members": f"{_WITH}, {_CLASSES} SELECT query_id, span_id, class_id FROM c",
    "text_conflicts": f"""{_WIDE}, {_CLASSES}, d AS (SELECT query_id, span_id, document_id FROM s) SELECT query_id, 'link' AS kind, first, second, NULL::BIGINT AS document_id, similarity FROM k
        UNION ALL SELECT query_id, 'member', class_id, span_id, document_id, 1.0::DOUBLE FROM c JOIN d USING (query_id, span_id)""",
    "conflict_counts": f"{_WITH}, {_PAIRS} SELECT query_id, count(*) AS conflicts FROM p GROUP BY 1",
    "document_titles": f"{_NOTICES} SELECT document_id, key FROM t",
    "supersession_names": f"{_NOTICES} SELECT query_id, superseding, superseded FROM e",
    "active_by_name": f"""{_NOTICES}, s AS (SELECT doc_id // 64 AS query_id, doc_id AS span_id, {_DATES} FROM l), a AS (SELECT * FROM s WHERE (effective_date IS NULL OR {_OF} >= effective_date) AND (expiry_date IS NULL OR {_OF} <= expiry_date) AND status IN ('active', 'amended'))
        SELECT query_id, span_id FROM a WHERE NOT EXISTS (SELECT 1 FROM e JOIN a b ON b.query_id = e.query_id AND b.span_id = e.superseding WHERE e.query_id = a.query_id AND e.superseded = a.span_id)""",
    "conflict_resolve": f"""{_WIDE}, {_PAIRS}, l AS (SELECT query_id, span_id, max(CASE WHEN winner = span_id THEN 1 ELSE 0 END) AS won FROM (SELECT query_id, first AS span_id, winner FROM p UNION ALL SELECT query_id, second, winner FROM p) GROUP BY ALL)
        SELECT query_id, span_id FROM s WHERE (query_id, span_id) NOT IN (SELECT (query_id, span_id) FROM l WHERE won = 0)""",
    "versioned_answer": f"""WITH s0 AS ({WIDE_SPANS}), s AS (SELECT a.* FROM s0 a JOIN (WITH s AS (SELECT * FROM s0) {_kept(_OF)}) k ON a.query_id = k.query_id AND a.span_id = k.span_id), {_PAIRS},
        l AS (SELECT query_id, span_id, max(CASE WHEN winner = span_id THEN 1 ELSE 0 END) AS won FROM (SELECT query_id, first AS span_id, winner FROM p UNION ALL SELECT query_id, second, winner FROM p) GROUP BY ALL)
        SELECT query_id, count(*) AS total, (SELECT count(*) FROM s WHERE s.query_id = s0.query_id) AS valid, count(*) - (SELECT count(*) FROM s WHERE s.query_id = s0.query_id) AS expired, (SELECT count(*) FROM p WHERE p.query_id = s0.query_id) AS conflicts,
        (SELECT count(*) FROM s WHERE s.query_id = s0.query_id) - (SELECT count(*) FROM l WHERE l.query_id = s0.query_id AND won = 0) AS resolved FROM s0 GROUP BY query_id""",
    "answer_diff": f"{_WITH}, {_DIFF} SELECT query_id, text, change, weight FROM d WHERE change IS NOT NULL",
    "change_score": f"""{_WITH}, {_DIFF} SELECT query_id, round(sum(CASE WHEN change = 'modified' THEN weight / 2 ELSE weight END), 6) AS change_score, count_if(change = 'added')::BIGINT AS added, count_if(change = 'removed')::BIGINT AS removed,
        count_if(change = 'modified')::BIGINT AS modified FROM d WHERE change IS NOT NULL GROUP BY 1""",
    "diff_view": rf"""{_NOTICES}, s AS (SELECT doc_id // 64 AS query_id, doc_id AS span_id, text, {_DATES}, {_cases(fx.DOCUMENT_TYPES, "guideline")} AS document_type FROM l), z AS (SELECT *, CASE document_type {" ".join(f"WHEN '{k}' THEN {w}" for k, w in fx.WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w FROM s),
        {", ".join(f"""{n}a AS (SELECT * FROM z WHERE (effective_date IS NULL OR {day} >= effective_date) AND (expiry_date IS NULL OR {day} <= expiry_date) AND status IN ('active', 'amended')),
        {n} AS (SELECT query_id, text, max(w) AS w, max(effective_date) AS e, max(status) AS st, max(document_type) AS ty FROM {n}a a WHERE NOT EXISTS (SELECT 1 FROM e JOIN {n}a b ON b.query_id = e.query_id AND b.span_id = e.superseding WHERE e.query_id = a.query_id AND e.superseded = a.span_id) GROUP BY ALL)""" for n, day in (("vo", _ERA), ("vn", _OF)))},
        j AS (SELECT query_id, text, o.w AS ow, n.w AS nw, o.e AS oe, n.e AS ne, o.st AS os, n.st AS ns, o.ty AS ot, n.ty AS nt, CASE WHEN o.w IS NULL THEN 'added' WHEN n.w IS NULL THEN 'removed' WHEN o.e IS DISTINCT FROM n.e OR o.st <> n.st OR o.w <> n.w THEN 'modified' END AS change FROM vo o FULL JOIN vn n USING (query_id, text)),
        v AS (SELECT *, change = 'modified' AS m FROM j WHERE change IS NOT NULL)
        SELECT query_id, change, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text, CASE WHEN NOT m THEN strftime(coalesce(ne, oe), '%Y-%m-%dT%H:%M:%S') END AS effective_date, CASE WHEN NOT m THEN coalesce(nt, ot) END AS document_type, CASE WHEN NOT m THEN coalesce(nw, ow) END AS precedence_weight,
        CASE WHEN m THEN os END AS old_status, CASE WHEN m THEN ns END AS new_status, CASE WHEN m THEN strftime(oe, '%Y-%m-%dT%H:%M:%S') END AS old_effective, CASE WHEN m THEN strftime(ne, '%Y-%m-%dT%H:%M:%S') END AS new_effective FROM v""",
    "temporal_stats": f"""{_WITH}, y AS (SELECT *, CASE WHEN span_id % 9 > 0 THEN {_cases(fx.DOCUMENT_TYPES, "guideline")} ELSE 'unknown' END AS kind FROM s)
        {" UNION ALL ".join(f"SELECT '{name}' AS dimension, {value} AS value, count(*) AS n, strftime(min(effective_date), '%Y-%m-%d') AS earliest_effective, strftime(max(effective_date), '%Y-%m-%d') AS latest_effective, strftime(min(expiry_date), '%Y-%m-%d') AS earliest_expiry, strftime(max(expiry_date), '%Y-%m-%d') AS latest_expiry, count_if(superseded_by IS NOT NULL OR older IS NOT NULL)::BIGINT AS superseding FROM y GROUP BY 1, 2" for name, value in (("total", "'all'"), ("document_type", "kind"), ("status", "status"), ("weight", "floor(precedence_weight)::INT || '-' || (floor(precedence_weight)::INT + 1)")))}""",
    "span_overlap": f"{_I} SELECT b.span_id AS target_id, a.span_id FROM i a JOIN i b ON {_HIT}",
    "span_merge_overlap": _islands("start < reach"),
    "span_merge_gap": _islands("start <= reach + 5"),
    "span_confident": f"{_I} SELECT span_id FROM i WHERE confidence >= 0.5",
    "span_groups": f"""{_I} SELECT document_id, string_agg(span_id::VARCHAR, ',' ORDER BY start, "end", span_id) AS span_ids FROM i GROUP BY 1""",
    "span_citations": f"""{_I} SELECT span_id, left(sha256(document_id || ':' || start || ':' || "end" || ':' || text), 16) AS span_hash FROM i""",
    "span_integrity": f"""{_I}, j AS (SELECT span_id, document_id, start, CASE WHEN span_id % 50 = 0 THEN start ELSE "end" END AS e, CASE WHEN span_id % 70 = 1 THEN ' ' ELSE text END AS t FROM i),
        f AS (SELECT start < 0 OR e <= start OR trim(t) = '' AS inv, row_number() OVER (PARTITION BY t, start, e, document_id ORDER BY span_id) > 1 AS dup, document_id IS NULL AS orp FROM j)
        SELECT count(*) AS total, count_if(inv)::BIGINT AS invalid, count_if(dup)::BIGINT AS duplicate, count_if(orp)::BIGINT AS orphaned, count_if(NOT (inv OR dup OR orp))::BIGINT AS valid FROM f""",
    "span_resolve": f"{_I} SELECT span_id FROM i a WHERE confidence >= 0.8 OR NOT EXISTS (SELECT 1 FROM i b WHERE {_HIT})",
    "span_context": f"""{_I}, n AS (SELECT b.span_id AS target_id, a.span_id, CASE WHEN a."end" <= b.start AND b.start - a."end" <= 200 THEN 'preceding' WHEN a.start >= b."end" AND a.start - b."end" <= 200 THEN 'following' END AS side,
          CASE WHEN a."end" <= b.start AND b.start - a."end" <= 200 THEN b.start - a."end" ELSE a.start - b."end" END AS gap FROM i a JOIN i b ON a.document_id = b.document_id AND a.span_id <> b.span_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY target_id, side ORDER BY gap, span_id) AS rank FROM n WHERE side IS NOT NULL)
        SELECT target_id, side, rank::INT AS rank, span_id FROM r WHERE rank <= 3""",
}
