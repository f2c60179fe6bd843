"""Pages to typed sections with byte offsets and parents, and sections to chunks.

Sections are rows (document_id, pos, text, section_type, level, byte_start, byte_end, page_num, confidence, language, parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import detect_language
from chronolex.operators import scans
from chronolex.operators.spans import interval_join

# fixed values: section types with their patterns, tried in this order, and levels
SECTION_PATTERNS = (
    ("chapter", r"(?i)^(?:CHAPTER|अध्याय)\s*[IVXLC0-9]+", 0),
    ("section", r"(?i)^[0-9]+\.\s+[A-Z]", 1),
    ("subsection", r"(?i)^[0-9]+\.[0-9]+\.\s", 2),
    ("clause", r"(?i)^\([a-z]\)\s", 3),
    ("definition", r'(?i)^"[^"]+"\s+means', 2),
    ("proviso", r"(?i)^\s*Provided\s+that", 3),
    ("explanation", r"(?i)^\s*Explanation\s*[:-]", 3),
    ("table", r"(?i)^\s*TABLE\s*[0-9]*", 2),
    ("schedule", r"(?i)^SCHEDULE\s*[IVXLC0-9]*", 1),
)


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & text.rlike(r"\p{Lu}")


def section_class(text: Column) -> Column:
    """struct(section_type, level) of a trimmed section."""
    one = lambda kind, level: F.struct(F.lit(kind).alias("section_type"), F.lit(level).alias("level"))
    out = F.when(text.rlike(SECTION_PATTERNS[0][1]), one("chapter", 0))
    for kind, pattern, level in SECTION_PATTERNS[1:]:
        out = out.when(text.rlike(pattern), one(kind, level))
    out = out.when((F.length(text) < 200) & is_upper(text), one("heading", 0)).when(text.rlike(r"^[0-9]+\."), one("numbered_section", 1))
    out = out.when(text.rlike(r"^\([a-z]\)"), one("clause", 2)).when(text.startswith("Note:") | text.startswith("NOTE:"), one("note", 2))
    return out.otherwise(one("paragraph", 3))


def coarse_class(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]+\."), "numbered_section").when(is_upper(text) & (F.length(text) < 100), "heading").when(text.rlike(r"^[A-Z][^.!?]*[.!?]"), "paragraph").otherwise("text")


def paragraphs(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """pages (document_id, page_num, raw_text, trust_score) -> one row a non-blank paragraph with document-wide byte offsets.

    Offsets run over all pages of a document; a separator counts with its own bytes."""
    return _placed(pages, separator).drop("c", "_title")


def _placed(pages: DataFrame, separator: str) -> DataFrame:
    """paragraphs() with their class, c, and the last title of level 0 before each, _title: one pass, in which each text is dealt once."""
    rows = pages.select("document_id", "page_num", "trust_score", F.posexplode(F.split("raw_text", separator)).alias("n", "raw"))
    rows = rows.withColumn("text", F.trim("raw")).withColumn("_b", F.floor(F.col("n") / scans.SPLIT)).withColumn("_size", (F.octet_length("raw") + F.lit(len(separator.encode()))).cast("long"))
    rows = rows.drop("raw").withColumn("c", section_class(F.col("text")))
    totals = {"byte_start": ("sum", F.col("_size")), "pos": ("sum", (F.col("text") != "").cast("int")), "_title": ("last", _title(F.col("c.level")))}
    rows = scans.scan(rows, ["document_id"], ["page_num", "_b"], ["n"], totals, inclusive=False)
    rows = rows.drop("_b", "_size").filter("text <> ''").withColumn("pos", (F.col("pos") + 1).cast("int"))
    return rows.withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))


def detected(detections: DataFrame, trust: float = 0.7) -> DataFrame:
    """detections (document_id, page_num, pos, text, confidence) at or above the trust, with a coarse type, running byte offsets and the page's mean confidence."""
    kept = detections.filter((F.col("confidence") >= trust) & (F.trim("text") != ""))
    order = Window.partitionBy("document_id", "page_num").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("text") + 1).over(order), F.lit(0)).cast("long"))
    kept = kept.withColumn("coarse_type", coarse_class(F.trim("text")))
    return kept.withColumn("trust_score", F.avg("confidence").over(Window.partitionBy("document_id", "page_num")))


def page_sections(pages: DataFrame, found: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Typed sections of pages: those found (document_id, page_num, pos, text, byte_start, confidence) where a page has any, else its raw text cut.

    A found section keeps its own offset (0 without one) and confidence (the page's trust without one); blank ones go, and a page of
    blank ones only has none. Offsets are within the page; `pos` numbers a document's sections by page, then place."""
    at = ["document_id", "page_num"]
    own = found.join(pages.select(*at, F.coalesce("trust_score", F.lit(1.0)).alias("_trust")).distinct(), at)
    own = own.select(*at, F.col("pos").cast("long").alias("n"), F.trim("text").alias("text"), F.coalesce(F.col("byte_start").cast("long"), F.lit(0)).alias("byte_start"), F.coalesce("confidence", "_trust").alias("confidence")).filter("text <> ''")
    rest = pages.join(found.select(*at).distinct(), at, "left_anti").select(*at, F.coalesce("trust_score", F.lit(1.0)).alias("confidence"), F.posexplode(F.split("raw_text", separator)).alias("n", "raw"))
    rest = rest.withColumn("text", F.trim("raw")).filter("text <> ''").withColumn("_b", F.floor(F.col("n") / scans.SPLIT))
    size = F.octet_length("text") + len(separator.encode())  # blank paragraphs take no room here
    rest = scans.scan(rest, at, ["_b"], ["n"], {"byte_start": ("sum", size.cast("long"))}, inclusive=False)
    both = own.unionByName(rest.select(*at, F.col("n").cast("long").alias("n"), "text", F.col("byte_start").cast("long").alias("byte_start"), "confidence")).withColumn("c", section_class(F.col("text")))
    both = scans.scan(both.withColumn("_b", F.floor(F.col("n") / scans.SPLIT)), ["document_id"], ["page_num", "_b"], ["n"], {"pos": ("sum", F.lit(1))})
    rows = both.select("document_id", F.col("pos").cast("int").alias("pos"), "text", "c.section_type", "c.level", "byte_start", (F.col("byte_start") + F.octet_length("text")).alias("byte_end"), "page_num", "confidence")
    return with_parents(rows.withColumn("language", detect_language(F.col("text"))))


def sections(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Typed sections with language and parent: the first 50 characters of the last level-0 section before."""
    rows = _placed(pages, separator)
    rows = rows.select("document_id", "pos", "text", "c.section_type", "c.level", "byte_start", "byte_end", "page_num", F.coalesce("trust_score", F.lit(1.0)).alias("confidence"), "_title")
    return rows.withColumn("language", detect_language(F.col("text"))).withColumn("parent", F.when(F.col("level") > 0, F.col("_title"))).drop("_title")


def _title(level: Column) -> Column:
    return F.when(level == 0, F.substring("text", 1, 50))


def with_parents(rows: DataFrame) -> DataFrame:
    found = scans.scan(rows.withColumn("_b", F.floor(F.col("pos") / scans.SPLIT)), ["document_id"], ["_b"], ["pos"], {"_last": ("last", _title(F.col("level")))})
    return found.withColumn("parent", F.when(F.col("level") > 0, F.col("_last"))).drop("_b", "_last")


# --- chunks ---------------------------------------------------------------------------------------
def hierarchical_chunks(rows: DataFrame, chunk_size: int = 512) -> DataFrame:
    """(document_id, chunk_no, first_pos, last_pos): greedy runs of sections.

    A run ends before a section whose level is not deeper than the one before, and after one that brings it over
    chunk_size bytes; then that section also opens the next run. An ordered fold per document, inside the JVM."""
    ordered = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", F.octet_length("text").alias("bytes")))).alias("s"))
    empty = F.expr("CAST(array() AS array<struct<lo:int,hi:int>>)")
    run = lambda lo, hi: F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))

    def step(acc, s):
        flush = acc["lo"].isNotNull() & (s["level"] <= acc["level"])
        out = F.when(flush, F.concat(acc["out"], run(acc["lo"], acc["hi"]))).otherwise(acc["out"])
        lo = F.when(flush | acc["lo"].isNull(), s["pos"]).otherwise(acc["lo"])
        size = F.when(flush | acc["lo"].isNull(), s["bytes"]).otherwise(acc["bytes"] + 1 + s["bytes"])
        over = (size > chunk_size) & (lo < s["pos"])
        return F.struct(
            F.when(over, F.concat(out, run(lo, s["pos"]))).otherwise(out).alias("out"),
            F.when(over, s["pos"]).otherwise(lo).cast("int").alias("lo"),
            s["pos"].cast("int").alias("hi"),
            F.when(over, s["bytes"]).otherwise(size).cast("int").alias("bytes"),
            s["level"].cast("int").alias("level"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(empty.alias("out"), none.alias("lo"), none.alias("hi"), F.lit(0).alias("bytes"), F.lit(0).alias("level"))
    last = lambda a: F.when(a["lo"].isNotNull(), F.concat(a["out"], run(a["lo"], a["hi"]))).otherwise(a["out"])
    runs = ordered.select("document_id", F.posexplode(F.aggregate("s", start, step, last)).alias("chunk_no", "r"))
    return runs.select("document_id", "chunk_no", F.col("r.lo").alias("first_pos"), F.col("r.hi").alias("last_pos"))


_SETS = (("page_num", "page_nums"), ("section_type", "section_types"), ("language", "languages"), ("parent", "parents"))


def chunk_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs of sections as chunks: joined text, byte bounds, distinct pages, types and languages, least level, spans."""
    each = runs.withColumn("pos", F.explode(F.sequence("first_pos", "last_pos"))).join(rows, ["document_id", "pos"])
    fields = ("byte_start", "byte_end", "text", "page_num", "section_type", "confidence")
    held = F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_s")  # a section's text goes to its chunk once
    texts = F.transform("_s", lambda x: x["text"])
    spans = F.array_sort(F.transform("_s", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    sets = [F.sort_array(F.collect_set(c)).alias(n) for c, n in _SETS]
    out = each.groupBy("document_id", "chunk_no").agg(held, F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.min("level").alias("level"), *sets)
    return out.select("document_id", "chunk_no", F.array_join(texts, " ").alias("text"), "byte_start", "byte_end", "level", *[n for _, n in _SETS], spans.alias("spans"))


def sliding_windows(texts: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """texts (document_id, text) -> windows of `size` bytes every size - overlap: (document_id, window, text, byte_start, byte_end).

    A window that isn't the last is cut back to its last space if that lies beyond half of it; broken characters at its ends go."""
    raw = F.encode("text", "utf-8")
    step = size - overlap
    rows = texts.withColumn("_n", F.octet_length("text")).filter("_n > 0").withColumn("byte_start", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))))
    broken = lambda at, pattern: (F.length(F.regexp_extract(F.hex(F.substring(raw, F.col("byte_start") + at, 3)), pattern, 1)) / 2).cast("int")
    head, tail = broken(1, "^((?:[89AB].)*)"), broken(size - 2, "^(?:..)*?([C-F].|[EF].[89AB].|F.[89AB].[89AB].)$")
    rows = rows.withColumn("_piece", F.substring(raw, F.col("byte_start") + 1 + head, size - head - tail).cast("string"))
    cut = F.length("_piece") - F.locate(" ", F.reverse("_piece"))
    last = F.col("byte_start") + size >= F.col("_n")
    shorter = (~last) & (F.locate(" ", F.reverse("_piece")) > 0) & (cut > size / 2)
    rows = rows.withColumn("text", F.trim(F.when(shorter, F.substr("_piece", F.lit(1), cut)).otherwise(F.col("_piece")))).filter("text <> ''")
    rows = rows.withColumn("window", (F.col("byte_start") / step).cast("int"))
    return rows.select("document_id", "window", "text", F.col("byte_start").cast("long").alias("byte_start"), (F.col("byte_start") + F.octet_length("text")).cast("long").alias("byte_end"))


def document_chunks(rows: DataFrame, texts: DataFrame, chunk_size: int = 512, overlap: int = 64, digest: bool = False) -> DataFrame:
    """Hierarchical chunks of sections (kind 0) and sliding windows of whole texts (kind 1), the first of each text of a document: document_id, kind, chunk_no, text, byte_start, byte_end, and the text's digest if asked for."""
    columns = ("document_id", "kind", "chunk_no", "text", "byte_start", "byte_end")
    runs = chunk_rows(hierarchical_chunks(rows, chunk_size), rows).withColumn("kind", F.lit(0))
    windows = sliding_windows(texts, chunk_size, overlap).withColumn("kind", F.lit(1)).withColumnRenamed("window", "chunk_no")
    return without_copies(runs.select(*columns).unionByName(windows.select(*columns)), digest)


def without_copies(chunks: DataFrame, digest: bool = False) -> DataFrame:
    """The first chunk of each text of a document, hierarchical (kind 0) before sliding (kind 1), with the text's digest if asked for: who needs that only moves no texts."""
    first = Window.partitionBy("document_id", "digest").orderBy("kind", "chunk_no")
    return chunks.withColumn("digest", F.sha2("text", 256)).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", *([] if digest else ["digest"]))


def chunk_context(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, chunk_no, byte_start, byte_end) with the places of a chunk by its end and by its start, from 1, and how many precede and follow it.

    The chunks that precede one are those of its document with end_place <= n_preceding, those that follow it the n_following
    last by start_place: whole lists as ranges, a row a chunk. A chunk is in neither list of itself if it has bytes;
    ties of ends and starts go by chunk_no. Counts come from one merge of starts and ends in order, not from pairs."""
    of = Window.partitionBy("document_id")
    rows = chunks.select("document_id", "chunk_no", "byte_start", "byte_end")
    rows = rows.withColumn("end_place", F.row_number().over(of.orderBy("byte_end", "chunk_no"))).withColumn("start_place", F.row_number().over(of.orderBy("byte_start", "chunk_no")))
    ends = rows.select("document_id", F.col("byte_end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["chunk_no"].dataType).alias("chunk_no"))
    starts = rows.select("document_id", F.col("byte_start").alias("at"), F.lit(1).alias("kind"), "chunk_no")
    merged = ends.unionByName(starts)
    ended = F.count_if(F.col("kind") == 0).over(of.orderBy("at", "kind"))  # an end at a start lies before it
    preceding = merged.withColumn("n_preceding", ended).filter("kind = 1").select("document_id", "chunk_no", "n_preceding")
    begun = F.count_if(F.col("kind") == 1).over(of.orderBy(F.desc("at"), F.desc("kind")))
    after = merged.withColumn("n_following", begun).filter("kind = 0")
    following = after.select("document_id", F.col("at").alias("byte_end"), "n_following").distinct()
    out = rows.join(preceding, ["document_id", "chunk_no"]).join(following, ["document_id", "byte_end"])
    return out.select("document_id", "chunk_no", "start_place", "end_place", "n_preceding", "n_following")


def chunk_groups(chunks: DataFrame) -> DataFrame:
    """(document_id, relation, value, chunk_no): the pages and the section types of chunks (page_nums, section_types).

    Two chunks of a document are on the same page, or of the same section type, where they share a row's document, relation and value."""
    each = lambda relation, column: chunks.select("document_id", F.lit(relation).alias("relation"), F.explode(F.array_distinct(F.col(column).cast("array<string>"))).alias("value"), "chunk_no")
    return each("page", "page_nums").unionByName(each("section", "section_types"))


def neighbours(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, chunk_no, relation, neighbour) of the asked chunks (document_id, chunk_no): preceding, following, page and section, none of itself.

    As many rows as the lists are long: for a stated few chunks; chunk_context and chunk_groups hold the same for all."""
    few = asked.select("document_id", "chunk_no").distinct()
    own = chunks.join(few, ["document_id", "chunk_no"], "left_semi").select("document_id", "chunk_no", F.col("byte_start").alias("_s"), F.col("byte_end").alias("_e"))
    others = chunks.select("document_id", F.col("chunk_no").alias("neighbour"), "byte_start", "byte_end")
    side = F.when(F.col("byte_end") <= F.col("_s"), "preceding").when(F.col("byte_start") >= F.col("_e"), "following")
    placed = own.join(others, "document_id").filter("neighbour <> chunk_no").select("document_id", "chunk_no", side.alias("relation"), "neighbour").filter("relation IS NOT NULL")
    groups = chunk_groups(chunks)
    shared = groups.join(few, ["document_id", "chunk_no"], "left_semi").join(groups.withColumnRenamed("chunk_no", "neighbour"), ["document_id", "relation", "value"])
    shared = shared.filter("neighbour <> chunk_no").select("document_id", "chunk_no", "relation", "neighbour").distinct()
    return placed.unionByName(shared)


def window_sections(texts: DataFrame, rows: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(document_id, window, pos): sections (pos, byte_start, byte_end) that share bytes with each sliding window of texts."""
    step, n = size - overlap, F.octet_length("text")
    windows = texts.filter(n > 0).select("document_id", F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("start"), n.alias("_n"))
    windows = windows.select("document_id", "start", F.least(F.col("start") + size, "_n").alias("end"), (F.col("start") / step).cast("int").alias("window"))
    right = rows.select("document_id", "pos", F.col("byte_start").alias("r_start"), F.col("byte_end").alias("r_end"))
    return interval_join(windows, right, ["document_id"]).select("document_id", "window", "pos")
