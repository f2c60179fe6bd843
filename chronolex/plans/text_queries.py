"""Text, segmentation and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import segment as sg
from chronolex.operators import text_diff as td
from chronolex.plans.inputs import LEGAL, legal, table
from chronolex.staging import staged

_DATES = lambda s, d: legal(s, d).select("doc_id", F.explode(tx.dates_in(F.col("text"))).alias("d")).select("doc_id", F.col("d.text").alias("date_text"), F.col("d.start").cast("long").alias("start"), F.col("d.end").cast("long").alias("end_"))


def _line_hierarchy(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "raw"))
    rows = lines.withColumn("line", F.trim("raw")).filter("line <> ''").withColumn("c", tx.line_level(F.col("line")))
    return rows.select("doc_id", "line_number", F.length("line").alias("n"), "c.level", "c.type")


def _pages(s, d):
    docs = table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_num"), F.col("text").alias("raw_text"), F.lit(1.0).alias("trust_score"))


def _sections(s, d):
    return sg.sections(_pages(s, d), "\n").select("document_id", F.col("pos").cast("long").alias("pos"), "section_type", "level", F.col("byte_start").cast("long").alias("byte_start"), F.col("byte_end").cast("long").alias("byte_end"), F.sha2("text", 256).alias("digest"), "language", "parent")


def _leveled(s, d):
    rows = sg.sections(_pages(s, d), "\n")
    return rows.withColumn("level", (F.length("text") % 4).cast("int"))


def _hier(s, d):
    rows = staged(_leveled(s, d), "sections")
    chunks = sg.chunk_rows(sg.hierarchical_chunks(rows), rows)
    return chunks.select("document_id", "chunk_no", "byte_start", "byte_end", "level", F.sha2("text", 256).alias("digest"), F.size("spans").alias("n_spans"))


def _sliding(s, d):
    texts = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    out = sg.sliding_windows(texts)
    return out.select("document_id", "window", F.sha2("text", 256).alias("digest"), "byte_start", "byte_end")


def _window_sections(s, d):
    texts = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return sg.window_sections(texts, sg.paragraphs(_pages(s, d), "\n")).withColumn("pos", F.col("pos").cast("long"))


def _dedup(s, d):
    lines = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_no", "text")).withColumn("kind", F.lit(0))
    return sg.without_copies(lines).select("document_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("text").alias("n"))


def _windows(s, d):
    """Windows of all documents as chunks, with pages of 4096 bytes and the types of the sections that they share bytes with."""
    texts = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    n = F.octet_length("text").cast("long")
    rows = texts.filter(n > 0).select("document_id", n.alias("n"), F.posexplode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(448).cast("long"))).alias("chunk_no", "byte_start"))
    rows = rows.withColumn("byte_end", F.least(F.col("byte_start") + 512, "n")).withColumn("page_nums", F.sequence(F.expr("byte_start DIV 4096"), F.expr("(byte_end - 1) DIV 4096")))
    typed = sg.sections(_pages(s, d), "\n")
    kinds = sg.window_sections(texts, typed).join(typed.select("document_id", "pos", "section_type"), ["document_id", "pos"])
    kinds = kinds.groupBy("document_id", F.col("window").alias("chunk_no")).agg(F.collect_set("section_type").alias("section_types"))
    return rows.drop("n").join(kinds, ["document_id", "chunk_no"], "left").withColumn("section_types", F.coalesce("section_types", F.array().cast("array<string>")))


def _context(s, d):
    out = sg.chunk_context(_windows(s, d).drop("section_types"))
    return out.select("document_id", "chunk_no", *[F.col(c).cast("long").alias(c) for c in ("start_place", "end_place", "n_preceding", "n_following")])


def _detections(s, d):
    """Lines of documents as detections, forty to a page; a line is as sure as its length says, and every third page has none that is."""
    lines = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    page = F.floor(F.col("pos") / 40).cast("int") + 1
    sure = F.when((F.col("document_id") + page) % 3 > 0, 0.5 + F.length("text") % 6 / 10.0).otherwise(0.1)
    return lines.withColumn("page_num", page).withColumn("confidence", sure)


def _detected(s, d):
    rows = sg.detected(_detections(s, d))
    return rows.select("document_id", "page_num", "pos", "byte_start", "coarse_type", F.round("trust_score", 6).alias("trust_score"))


def _page_sections(s, d):
    lines = _detections(s, d)
    pages = lines.groupBy("document_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("raw_text"), F.lit(0.5).alias("trust_score"))
    found = sg.detected(lines).select("document_id", "page_num", "pos", "text", "byte_start", F.when(F.col("pos") % 2 == 0, F.col("confidence")).alias("confidence"))
    out = sg.page_sections(pages, found, "\n")
    return out.select("document_id", "pos", "page_num", "section_type", "level", "byte_start", "byte_end", F.round("confidence", 6).alias("confidence"))


def _chunk_union(s, d):
    texts = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return sg.document_chunks(staged(_leveled(s, d), "sections"), texts, digest=True).select("document_id", "kind", "chunk_no", "byte_start", "byte_end", "digest")


def _text_diff(s, d):
    """Each document against the one with the next id, by lines: sizes from the difference, and whether it gives both texts back."""
    docs = table(s, d, "documents").select("doc_id", "text")
    lines = lambda c: F.split(c, "\n")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    pairs = staged(docs.join(after, "doc_id").select(F.col("doc_id").alias("key"), lines("text").alias("old"), lines("next").alias("new")), "pairs")
    diff = td.differences(pairs)
    ordered = F.array_sort(F.collect_list(F.struct("gap", "kind", "pos", "op", "line"))).alias("_d")  # both texts from one grouping
    rows = pairs.join(diff.groupBy("key").agg(ordered), "key")
    back = lambda op: F.transform(F.filter("_d", lambda x: x["op"] != op), lambda x: x["line"])
    rows = rows.select("key", "old", "new", back("+").alias("_False"), back("-").alias("_True"))
    return rows.select(F.col("key").alias("doc_id"), F.size("_False").cast("long").alias("n_old"), F.size("_True").cast("long").alias("n_new"), (F.col("_False") == F.col("old")).alias("old_back"), (F.col("_True") == F.col("new")).alias("new_back"))


def _language(s, d):
    docs = table(s, d, "documents").select("doc_id", "text").unionByName(s.createDataFrame([(-1, "नियम rule"), (-2, "123"), (-3, "")], "doc_id long, text string"))
    return docs.select("doc_id", tx.detect_language(F.col("text")).alias("language"))


def _fragments(s, d):
    parts = legal(s, d).select("doc_id", F.split(F.replace("text", F.lit(" "), F.lit("-| ")), r"\|").alias("p"))
    return parts.select("doc_id", F.array_join(tx.merge_fragments(F.transform("p", lambda x: F.trim(x))), "|").alias("merged"))


def _nfkc(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), tx.normalize_unicode(F.col("text")).alias("text"))


QUERIES = {
    "nfkc_normalize": _nfkc,
    "dehyphenate": lambda s, d: legal(s, d).select("doc_id", tx.dehyphenate(F.col("text")).alias("text")),
    "clean_noise": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(tx.clean_noise(F.col("html")), 256).alias("digest")),
    "text_quality": lambda s, d: table(s, d, "documents").select("doc_id", F.round(tx.text_quality(F.col("text")), 6).alias("quality")),
    "lang_detect": _language,
    "extract_dates": _DATES,
    "line_hierarchy": _line_hierarchy,
    "merge_fragments": _fragments,
    "sentence_split": lambda s, d: legal(s, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence")),
    "join_coherently": lambda s, d: legal(s, d).select("doc_id", tx.join_coherently(F.split("text", " it ")).alias("text")),
    "answer_hash": lambda s, d: table(s, d, "documents").select("doc_id", tx.answer_hash(F.col("text")).alias("answer_hash")),
    "dated_answer": lambda s, d: table(s, d, "orders").select("o_orderkey", tx.dated_answer(F.col("o_orderpriority"), F.col("o_orderdate")).alias("answer")),
    "code_mixed": lambda s, d: legal(s, d).select("doc_id", tx.code_mixed(F.col("text")).alias("text")),
    "negated_claim": lambda s, d: legal(s, d).select("doc_id", tx.negated_claim(F.col("text")).alias("text")),
    "modified_claim": lambda s, d: legal(s, d).select("doc_id", tx.modified_claim(F.col("text")).alias("text")),
    "trust_gate": lambda s, d: table(s, d, "lineitem").filter(tx.trust_gate(F.nullif("l_discount", F.lit(0.0)), 0.07)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
    "segment_sections": _sections,
    "hier_chunks": _hier,
    "sliding_chunks": _sliding,
    "window_sections": _window_sections,
    "chunk_dedup": _dedup,
    "chunk_context": _context,
    "text_diff": _text_diff,
    "detected_lines": _detected,
    "page_sections": _page_sections,
    "chunk_union": _chunk_union,
    "chunk_groups": lambda s, d: sg.chunk_groups(_windows(s, d)),
}

_MONTHS = tx.MONTHS
_SECTION_CASES = "\n".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p, _ in sg.SECTION_PATTERNS)
_LEVEL_CASES = "\n".join(f"WHEN '{k}' THEN {level}" for k, _, level in sg.SECTION_PATTERNS)

_SECTIONS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    o AS (SELECT doc_id, n, trim(raw) AS t, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM l),
    sec AS (SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos, t, strlen(t) AS b, length(t) % 4 AS lv, byte_start, byte_start + strlen(t) AS byte_end FROM o WHERE t <> '')"""

_TYPED = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        o AS (SELECT doc_id, n, trim(raw) AS t, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM l),
        c AS (SELECT *, CASE {_SECTION_CASES} WHEN length(t) < 200 AND upper(t) = t AND regexp_matches(t, '\p{{Lu}}') THEN 'heading' WHEN regexp_matches(t, '^[0-9]+\.') THEN 'numbered_section'
            WHEN regexp_matches(t, '^\([a-z]\)') THEN 'clause' WHEN starts_with(t, 'Note:') OR starts_with(t, 'NOTE:') THEN 'note' ELSE 'paragraph' END AS section_type FROM o WHERE t <> '')"""
_WINDOWED = "d AS (SELECT doc_id AS document_id, strlen(text) AS n, unnest(range(0, strlen(text), 448)) AS s FROM documents), w AS (SELECT document_id, (s // 448)::INT AS chunk_no, s, least(s + 512, n) AS e FROM d)"

_FOUND = """WITH l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos FROM documents),
    e AS (SELECT *, (pos // 40)::INT + 1 AS page_num, CASE WHEN (document_id + pos // 40 + 1) % 3 > 0 THEN 0.5::DOUBLE + (length(text) % 6) / 10.0::DOUBLE ELSE 0.1::DOUBLE END AS sure FROM l),
    f AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY document_id, page_num ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM e WHERE sure >= 0.7 AND trim(text) <> '')"""

ORACLE = {
    "merge_fragments": rf"""SELECT doc_id, list_reduce(list_transform(string_split(replace(text, ' ', '-| '), '|'), lambda x: trim(x)),
        lambda a, x: CASE WHEN regexp_matches(x, '^\p{{Ll}}') AND a LIKE '%-' THEN left(a, length(a) - 1) || x ELSE a || '|' || x END) AS merged FROM ({LEGAL})""",
    "join_coherently": f"""SELECT doc_id, list_reduce(string_split(text, ' it '), lambda a, x: CASE WHEN regexp_matches(a, '[.!?,;]$') THEN a || ' ' || x ELSE a || '. ' || x END) AS text FROM ({LEGAL})""",
    "hier_chunks": f"""WITH RECURSIVE {_SECTIONS}, f AS (SELECT document_id, pos, lv, pos AS lo, b AS bytes, NULL::BIGINT AS cut_lo, NULL::BIGINT AS full_lo FROM sec WHERE pos = 1
          UNION ALL SELECT document_id, pos, lv, CASE WHEN lo < pos AND bytes > 512 THEN pos ELSE lo END, CASE WHEN lo < pos AND bytes > 512 THEN b ELSE bytes END, cut_lo, CASE WHEN lo < pos AND bytes > 512 THEN lo END
          FROM (SELECT s.document_id, s.pos, s.lv, s.b, CASE WHEN s.lv <= f.lv THEN s.pos ELSE f.lo END AS lo, CASE WHEN s.lv <= f.lv THEN s.b ELSE f.bytes + 1 + s.b END AS bytes, CASE WHEN s.lv <= f.lv THEN f.lo END AS cut_lo
            FROM f JOIN sec s ON s.document_id = f.document_id AND s.pos = f.pos + 1)),
        r AS (SELECT document_id, pos, 0 AS kind, cut_lo AS lo, pos - 1 AS hi FROM f WHERE cut_lo IS NOT NULL UNION ALL SELECT document_id, pos, 1, full_lo, pos FROM f WHERE full_lo IS NOT NULL
          UNION ALL (SELECT document_id, pos, 2, lo, pos FROM f QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY pos DESC) = 1)),
        c AS (SELECT document_id, lo, hi, row_number() OVER (PARTITION BY document_id ORDER BY pos, kind) - 1 AS chunk_no FROM r)
        SELECT document_id, chunk_no::INT AS chunk_no, min(byte_start)::BIGINT AS byte_start, max(byte_end)::BIGINT AS byte_end, min(lv)::INT AS level, sha256(string_agg(t, ' ' ORDER BY pos)) AS digest, count(*)::INT AS n_spans
        FROM c JOIN sec USING (document_id) WHERE pos BETWEEN lo AND hi GROUP BY document_id, chunk_no""",
    "dehyphenate": rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '([\p{{L}}\p{{M}}\p{{N}}_]+)-\s*\n\s*([\p{{L}}\p{{M}}\p{{N}}_]+)', '\1\2', 'g'),
        '([\p{{L}}\p{{M}}\p{{N}}_]+)-\s+([\p{{L}}\p{{M}}\p{{N}}_]+)', '\1\2', 'g') AS text FROM ({LEGAL})""",
    "clean_noise": r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '[^\p{L}\p{M}\p{N}_\s.,;:!?()\[\]''"/\\-]', '', 'g'), '\s+', ' ', 'g'), '\.{3,}', '...', 'g'))) AS digest FROM pages""",
    "text_quality": r"""SELECT doc_id, CASE WHEN length(text) > 0 THEN round(least(1.0, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) * 0.7
        + length(regexp_replace(text, '[^\p{L}\p{Nd}\s.,;:!?()\[\]''"/\\-]', '', 'g')) / length(text) * 0.3), 6) ELSE 0.0 END AS quality FROM documents""",
    "lang_detect": r"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL VALUES (-1::BIGINT, 'नियम rule'), (-2::BIGINT, '123'), (-3::BIGINT, '')),
        c AS (SELECT doc_id, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS h, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS l FROM t)
        SELECT doc_id, CASE WHEN h + l = 0 THEN 'unknown' WHEN h / (h + l) > 0.3 THEN 'hi' ELSE 'en' END AS language FROM c""",
    "extract_dates": rf"""WITH t AS ({LEGAL}), m AS (
        SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}')) AS d FROM t
        UNION ALL SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)[0-9]{{1,2}}\s+(?:{_MONTHS})\s+[0-9]{{4}}')) FROM t)
        SELECT doc_id, d AS date_text, (instr(text, d) - 1)::BIGINT AS start, (instr(text, d) - 1 + length(d))::BIGINT AS end_ FROM m""",
    "line_hierarchy": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number FROM documents),
        t AS (SELECT doc_id, line_number, trim(raw) AS line FROM l WHERE trim(raw) <> '')
        SELECT doc_id, line_number::INT AS line_number, length(line)::INT AS n,
        CASE WHEN regexp_matches(line, '^[0-9]+\.') THEN 1 WHEN regexp_matches(line, '^[A-Z\s]+$') AND length(line) < 100 THEN 0 WHEN regexp_matches(line, '^\([a-z]\)') THEN 2 ELSE 0 END AS level,
        CASE WHEN regexp_matches(line, '^[0-9]+\.') THEN 'numbered' WHEN regexp_matches(line, '^[A-Z\s]+$') AND length(line) < 100 THEN 'heading' WHEN regexp_matches(line, '^\([a-z]\)') THEN 'subsection' ELSE 'paragraph' END AS type FROM t""",
    "sentence_split": rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({LEGAL}))
        SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS sentence FROM s""",
    "answer_hash": "SELECT doc_id, left(sha256(text), 16) AS answer_hash FROM documents",
    "dated_answer": "SELECT o_orderkey, 'As of ' || strftime(o_orderdate, '%B %d, %Y') || ': ' || o_orderpriority AS answer FROM orders",
    "code_mixed": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM ({LEGAL}))
        SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN coalesce(CASE lower(x) WHEN 'bank' THEN 'बैंक' WHEN 'rule' THEN 'नियम' WHEN 'regulation' THEN 'विनियम' WHEN 'money' THEN 'पैसा'
        WHEN 'account' THEN 'खाता' WHEN 'document' THEN 'दस्तावेज' WHEN 'requirement' THEN 'आवश्यकता' WHEN 'government' THEN 'सरकार' END, x) ELSE x END), ' ') AS text FROM w""",
    "negated_claim": f"""SELECT doc_id, CASE WHEN contains(lower(text), 'shall') THEN replace(lower(text), 'shall', 'shall not') WHEN contains(lower(text), 'must') THEN replace(lower(text), 'must', 'must not')
        WHEN contains(lower(text), 'is') THEN replace(lower(text), 'is', 'is not') WHEN contains(lower(text), 'are') THEN replace(lower(text), 'are', 'are not') ELSE 'It is not true that ' || lower(text) END AS text FROM ({LEGAL})""",
    "modified_claim": f"""SELECT doc_id, CASE length(text) % 5 WHEN 0 THEN replace(text, '10%', '15%') WHEN 1 THEN replace(text, 'shall', 'may') WHEN 2 THEN replace(text, 'must', 'should')
        WHEN 3 THEN replace(text, 'all', 'some') ELSE replace(text, 'every', 'any') END AS text FROM ({LEGAL})""",
    "trust_gate": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE coalesce(nullif(l_discount, 0.0), 1.0) >= 0.07 GROUP BY 1",
    "segment_sections": rf"""WITH {_TYPED},
        v AS (SELECT *, CASE section_type {_LEVEL_CASES} WHEN 'heading' THEN 0 WHEN 'numbered_section' THEN 1 WHEN 'note' THEN 2 ELSE 3 END AS level,
            length(regexp_replace(t, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS h, length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS lat FROM c)
        SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos, section_type, level, byte_start, (byte_start + strlen(t))::BIGINT AS byte_end, sha256(t) AS digest,
        CASE WHEN h + lat = 0 THEN 'unknown' WHEN h / (h + lat) > 0.3 THEN 'hi' ELSE 'en' END AS language,
        CASE WHEN level > 0 THEN last_value(CASE WHEN level = 0 THEN left(t, 50) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM v""",
    "window_sections": f"""WITH {_SECTIONS}, w AS (SELECT doc_id AS document_id, strlen(text) AS n, unnest(range(0, strlen(text), 448)) AS s FROM documents)
        SELECT document_id, (s // 448)::INT AS "window", pos FROM w JOIN sec USING (document_id) WHERE byte_start < least(s + 512, n) AND byte_end > s""",
    "chunk_dedup": """WITH l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_no FROM documents)
        SELECT document_id, min(chunk_no)::BIGINT AS chunk_no, length(text)::INT AS n FROM l GROUP BY document_id, text""",
    "chunk_context": f"""WITH {_WINDOWED} SELECT document_id, chunk_no, row_number() OVER (PARTITION BY document_id ORDER BY s, chunk_no) AS start_place, row_number() OVER (PARTITION BY document_id ORDER BY e, chunk_no) AS end_place,
        (SELECT count(*) FROM w b WHERE b.document_id = a.document_id AND b.e <= a.s) AS n_preceding, (SELECT count(*) FROM w b WHERE b.document_id = a.document_id AND b.s >= a.e) AS n_following FROM w a""",
    "detected_lines": rf"""{_FOUND} SELECT document_id, page_num, pos, byte_start, CASE WHEN regexp_matches(trim(text), '^[0-9]+\.') THEN 'numbered_section' WHEN upper(trim(text)) = trim(text) AND regexp_matches(trim(text), '\p{{Lu}}') AND length(trim(text)) < 100 THEN 'heading'
        WHEN regexp_matches(trim(text), '^[A-Z][^.!?]*[.!?]') THEN 'paragraph' ELSE 'text' END AS coarse_type, round(avg(sure) OVER (PARTITION BY document_id, page_num), 6) AS trust_score FROM f""",
    "page_sections": rf"""{_FOUND}, r AS (SELECT document_id, page_num, pos, trim(text) AS t, byte_start, CASE WHEN pos % 2 = 0 THEN sure ELSE 0.5 END AS confidence FROM f
          UNION ALL SELECT document_id, page_num, pos - 40 * (page_num - 1), trim(text), coalesce(sum(strlen(trim(text)) + 1) OVER (PARTITION BY document_id, page_num ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, 0.5 FROM e WHERE trim(text) <> '' AND (document_id, page_num) NOT IN (SELECT (document_id, page_num) FROM f)),
        c AS (SELECT *, CASE {_SECTION_CASES} WHEN length(t) < 200 AND upper(t) = t AND regexp_matches(t, '\p{{Lu}}') THEN 'heading' WHEN regexp_matches(t, '^[0-9]+\.') THEN 'numbered_section'
            WHEN regexp_matches(t, '^\([a-z]\)') THEN 'clause' WHEN starts_with(t, 'Note:') OR starts_with(t, 'NOTE:') THEN 'note' ELSE 'paragraph' END AS section_type FROM r)
        SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_num, pos)::INT AS pos, page_num, section_type, CASE section_type {_LEVEL_CASES} WHEN 'heading' THEN 0 WHEN 'numbered_section' THEN 1 WHEN 'note' THEN 2 ELSE 3 END AS level,
        byte_start, byte_start + strlen(t) AS byte_end, round(confidence, 6) AS confidence FROM c""",
    "text_diff": "SELECT a.doc_id, len(string_split(a.text, chr(10))) AS n_old, len(string_split(b.text, chr(10))) AS n_new, TRUE AS old_back, TRUE AS new_back FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "chunk_groups": rf"""WITH {_WINDOWED}, {_TYPED} SELECT document_id, 'page' AS relation, unnest(range(s // 4096, (e - 1) // 4096 + 1))::VARCHAR AS value, chunk_no FROM w
        UNION ALL SELECT DISTINCT document_id, 'section', section_type, chunk_no FROM w JOIN (SELECT doc_id AS document_id, section_type, byte_start AS b, byte_start + strlen(t) AS f FROM c) USING (document_id) WHERE b < e AND f > s""",
}
