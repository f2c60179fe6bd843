"""Top-k retrieval, score fusion, reciprocal-rank fusion and filters; queries are rows (query_id, text)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolex.operators.index import MOST_PARTS, SUMS, Lexical, bm25_idf, bm25_weight, norms, part_of, tfidf_idf, tokens
from chronolex.staging import staged


def top_by_query(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best positive scores of each query with `rank` from 1; rounded scores decide, ties go to the smaller chunk."""
    rounded = scores.withColumn("score", F.round("score", digits)).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


ASKED_TERMS = 1_000_000  # (query, term) rows that are sent to the postings
LISTED_TERMS = 10_000
SPARED = 8


def _few(df: DataFrame, most: int = ASKED_TERMS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _listed(asked: DataFrame) -> list[str] | None:
    """The distinct asked terms, if they are few enough to be looked up where the postings lie."""
    terms = [r["term"] for r in asked.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    return terms if len(terms) <= LISTED_TERMS else None


def _asking(asked: DataFrame) -> int:
    return asked.select("query_id").distinct().count()


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries (query_id, text)."""
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _dots(index: DataFrame, asked: DataFrame, times: str) -> DataFrame:
    """(query_id, chunk_id, score): index (term, chunk_id, weight) joined on terms and summed."""
    return index.join(_few(asked), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col(times)).alias("score"))


def bm25(queries: DataFrame, lex: Lexical | None, k: int, index: DataFrame | None = None) -> DataFrame:
    """Postings joined on terms, summed per (query, chunk); query words count as often as they occur.

    index: a written bm25_index; without it only the postings of asked terms leave the term counts of lex."""
    asked = asked_terms(queries)
    if index is not None:
        return top_by_query(_dots(index, asked, "times"), k)
    asked = staged(asked.join(lex.vocabulary.select("term", bm25_idf(lex).alias("idf")), "term"), "asked")
    rows = lex.postings(_listed(asked), by_chunk=_asking(asked)).join(_few(asked), "term")
    scores = rows.groupBy("query_id", "chunk_id").agg(F.sum(bm25_weight(lex) * F.col("times")).alias("score"))
    return top_by_query(scores, k)


def asked_vectors(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, term, asked): unit TF-IDF vectors of the queries, idf with at most MAX_TERMS rows."""
    raw = asked_terms(queries).join(F.broadcast(idf), "term").withColumn("w", F.col("times") * F.col("idf"))
    return raw.join(norms(raw, "query_id"), "query_id").select("query_id", "term", (F.col("w") / F.col("norm")).alias("asked"))


def sparse(queries: DataFrame, lex: Lexical | None, k: int, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors over shared terms only; index: written (idf, vectors)."""
    if index is not None:
        return top_by_query(_dots(index[1], asked_vectors(queries, index[0]), "asked"), k)
    idf = staged(tfidf_idf(lex), "idf")
    weighted = lambda posts: posts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    asked = staged(asked_vectors(queries, idf), "asked")
    rows = weighted(lex.postings(_listed(asked), by_chunk=_asking(asked), beside=norms(weighted(lex.postings())))).join(_few(asked), "term")
    return top_by_query(rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("asked") / F.col("norm")).alias("score")), k)


# --- top k by profiles of common words ---
COMMON = 4096  # chunks with a term from which on the term is common


def bm25_by_profile(queries: DataFrame, lex: Lexical, k: int, common: int = COMMON) -> DataFrame:
    """bm25() for corpora of many chunks that are alike in the questions' common words."""
    if lex.n <= 2 * common:
        return bm25(queries, lex, k)
    asked = asked_terms(queries).join(lex.vocabulary.select("term", "df", bm25_idf(lex).alias("idf")), "term")
    found = _by_profile(staged(asked, "asked"), lex, bm25_weight(lex) * F.col("times"), k, common)
    return bm25(queries, lex, k) if found is None else found


def sparse_by_profile(queries: DataFrame, lex: Lexical, k: int, common: int = COMMON) -> DataFrame:
    """sparse() for the same; a chunk's length in TF-IDF space is part of its profile."""
    if lex.n <= 2 * common:
        return sparse(queries, lex, k)
    idf = staged(tfidf_idf(lex), "idf")
    asked = asked_vectors(queries, idf).join(F.broadcast(idf), "term").join(lex.vocabulary.select("term", "df"), "term")
    lengths = norms(lex.postings().join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf")))
    found = _by_profile(staged(asked, "asked"), lex, F.col("tf") * F.col("idf") * F.col("asked") / F.col("norm"), k, common, lengths)
    return sparse(queries, lex, k) if found is None else found


def _by_profile(asked: DataFrame, lex: Lexical, weight: Column, k: int, common: int, lengths: DataFrame | None = None) -> DataFrame | None:
    """The k best of each query, exactly; None where profiles spare nothing.

    asked: (query_id, term, df, what weight needs). Chunks with equal counts of the questions' common terms and equal length
    get the same from these, and so do questions that ask the same of them: that part of the score is made once for a
    profile and a kind of question, and of a profile's chunks only the k first by id can be among the k best. Chunks with one
    of a question's rare terms, not more than `common` a term, are scored one by one: their rare part, never negative, and the profile's."""
    few, many = asked.filter(F.col("df") <= common), asked.filter(F.col("df") > common)
    terms = _listed(many)
    if not terms:
        return None
    about = [c for c in many.columns if c not in ("query_id", "df")]
    asks = many.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*about))).alias("asks")).withColumn("pattern", _digest("asks"))
    asks = staged(asks, "patterns")
    patterns = asks.dropDuplicates(["pattern"]).select("pattern", F.explode("asks").alias("a")).select("pattern", "a.*")

    own = ["doc_len", *(["norm"] if lengths is not None else [])]
    counts = lex.counts.withColumn("terms", F.filter("terms", lambda t: t["term"].isin(terms))).filter(F.size("terms") > 0)
    counts = counts if lengths is None else counts.join(lengths, "chunk_id").withColumn("doc_len", F.lit(0))
    profiles = staged(counts.withColumn("profile", _digest(*own, "terms")), "profiles")
    place = F.row_number().over(Window.partitionBy("profile").orderBy("chunk_id"))
    firsts = staged(profiles.withColumn("place", place).filter(F.col("place") <= k), "firsts")
    heads = firsts.filter("place = 1")
    if 4 * heads.count() * asks.select("pattern").distinct().count() > lex.n * asks.count():
        return None
    posts = heads.select("profile", *own, F.explode("terms").alias("_p")).select("profile", *own, "_p.term", "_p.tf")
    alike = staged(posts.join(_few(patterns), "term").groupBy("pattern", "profile").agg(F.sum(weight).alias("score")), "alike")

    by_pattern = Window.partitionBy("pattern")
    order = by_pattern.orderBy(F.desc(F.round("score", 6)), "chunk_id")
    best = alike.join(heads.select("profile", "chunk_id"), "profile").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("chunk_id", "n")
    best = best.join(firsts.select("profile", "chunk_id"), "profile").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    best = asks.select("query_id", "pattern").join(best.select("pattern", "chunk_id", "score"), "pattern").select("query_id", "chunk_id", "score")

    rare = lex.postings(_listed(few)) if lengths is None else lex.postings(_listed(few)).join(lengths, "chunk_id")
    rare = rare.join(_few(few), "term").groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("rare"))
    rare = rare.join(asks.select("query_id", "pattern"), "query_id", "left").join(profiles.select("chunk_id", "profile"), "chunk_id", "left")
    rare = rare.join(alike.withColumnRenamed("score", "alike"), ["pattern", "profile"], "left")
    rare = rare.select("query_id", "chunk_id", (F.col("rare") + F.coalesce("alike", F.lit(0.0))).alias("score"))
    return top_by_query(best.unionByName(rare).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# --- top k by blocks ------------------------------------------------------------------------------
def block_top_k(asked: DataFrame, blocks: DataFrame, k: int, seeds: int = 2, reads: list | None = None) -> DataFrame:
    """The k best of each query over blocks of postings (index.blocks): exact, and reads only blocks that can matter.

    asked: (query_id, term, times), times not negative. 1. Each query's most promising blocks give chunks whose exact scores
    bound the k-th score from below. 2. A chunk that reaches the bound lies in a block whose largest weight, with all
    that the query's other terms can add, reaches it, too: only such blocks are read; a chunk goes on if what it
    got and what unread blocks could add reaches the bound. 3. The scores of these are completed from the parts that
    hold them. Where more than one in SPARED of the postings asked for has to be read, 2 and 3 are one pass over all asked blocks.
    Postings go to the task of their chunk once, whatever the number of queries, and meet the queries there; no query's or term's postings meet in one task.
    reads, if given, gets the tables of (term, level or part) that were read, for blocks_read()."""
    asked = staged(asked.filter("times > 0"), "asked")
    asked_blocks = blocks.join(_few(asked.select("term").distinct()), "term", "left_semi")
    levels = asked_blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("parts").alias("parts"))
    levels = staged(asked.join(levels, "term").withColumn("add", F.col("times") * F.col("most")), "levels")
    by_query = Window.partitionBy("query_id")

    # 1: about seeds * k chunks a query, from its highest levels
    before = F.sum("n").over(by_query.orderBy(F.desc("add"), "term", "level").rowsBetween(Window.unboundedPreceding, -1))
    first = levels.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < seeds * k)
    some = F.least(F.col("parts"), F.greatest(F.lit(1), F.ceil(F.col("parts") * (seeds * k) / F.col("n")))).cast("int")
    drawn = _read(asked_blocks, first.select("query_id", "term", "level", some.alias("some")), F.col("part") < F.col("some"))
    reads = [] if reads is None else reads
    seeded = _completed(drawn.select("query_id", "chunk_id").distinct(), asked, asked_blocks, reads)
    kth = F.row_number().over(by_query.orderBy(F.desc("score"), "chunk_id"))
    bound = seeded.withColumn("r", kth).filter(F.col("r") == k).select("query_id", (F.col("score") - 2e-6).alias("bound"))

    # 2: what each level must have beside it to matter
    most = levels.groupBy("query_id", "term").agg(F.greatest(F.max("add"), F.lit(0.0)).alias("best"))
    most = most.withColumn("all", F.sum("best").over(by_query)).withColumn("less", F.sum("best").over(by_query.orderBy("best", "term")))
    most = most.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    able = levels.join(most, ["query_id", "term"])
    needed = (F.col("less") >= F.col("bound")) & (F.col("add") + F.col("all") - F.col("best") >= F.col("bound"))
    able = staged(able.withColumn("needed", needed), "able")
    work, wanted = able.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n"))), F.lit(0))).first()
    if SPARED * wanted > work:
        reads.append(able.select("term", "level"))
        rows = _by_chunk(_postings(asked_blocks), work).join(_few(asked), "term")
        return top_by_query(rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("weight")).alias("score")), k)
    unread = able.groupBy("query_id", "term").agg(F.greatest(F.max(F.when(~F.col("needed"), F.col("add"))), F.lit(0.0)).alias("unread"), F.max("bound").alias("bound"))
    unread = unread.withColumn("unread", F.coalesce("unread", F.lit(0.0)))
    limits = unread.groupBy("query_id").agg(F.sum("unread").alias("all_unread"), F.max("bound").alias("bound"))
    asking = staged(able.filter("needed").select("query_id", "term", "level", "times").join(unread.drop("bound"), ["query_id", "term"]), "asking")
    got = _postings(asked_blocks.join(_few(asking.select("term", "level").distinct()), ["term", "level"], "left_semi"), "level")
    got = _by_chunk(got, wanted).join(_few(asking), ["term", "level"])
    partial = got.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("weight")).alias("got"), F.sum("unread").alias("met")).join(_few(limits), "query_id")
    left = partial.filter(F.col("got") + F.col("all_unread") - F.col("met") >= F.col("bound")).select("query_id", "chunk_id")

    reads.append(able.filter("needed").select("term", "level"))
    return top_by_query(_completed(left, asked, asked_blocks, reads), k)  # 3


def blocks_read(asked: DataFrame, blocks: DataFrame, reads: list[DataFrame]) -> tuple[int, int]:
    """Postings of asked terms, and those in blocks that block_top_k read (the first blocks lie in parts that are counted)."""
    of = blocks.join(_few(asked.select("term").distinct()), "term", "left_semi").select("term", "level", "part", "n")
    hit = None
    for table in reads:
        one = of.join(table.distinct(), [c for c in table.columns], "left_semi")
        hit = one if hit is None else hit.unionByName(one)
    sums = [df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (of, hit.distinct())]
    return sums[0], sums[1]


def _read(blocks: DataFrame, wanted: DataFrame, which: Column | None = None) -> DataFrame:
    """wanted (query_id, term, level, ...) with a row for each posting (chunk_id, weight) of its blocks."""
    met = blocks.join(_few(wanted), ["term", "level"])
    met = met if which is None else met.filter(which)
    columns = [c for c in wanted.columns if c not in ("term", "level")]
    return met.select(*columns, F.explode(F.arrays_zip("chunk_ids", "weights")).alias("_p")).select(*columns, F.col("_p.chunk_ids").alias("chunk_id"), F.col("_p.weights").alias("weight"))


def _postings(blocks: DataFrame, *columns: str) -> DataFrame:
    """A row (term, chunk_id, weight) a posting of the blocks, with their columns."""
    rows = blocks.select("term", *columns, F.explode(F.arrays_zip("chunk_ids", "weights")).alias("_p"))
    return rows.select("term", *columns, F.col("_p.chunk_ids").alias("chunk_id"), F.col("_p.weights").alias("weight"))


def _by_chunk(postings: DataFrame, sums: int) -> DataFrame:
    """Postings dealt by chunk, so that sums by query and chunk need no shuffle of their own; `sums` bounds how many there are in all."""
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(max(least, min(MOST_PARTS, -(-sums // (8 * SUMS)))), "chunk_id")


def _completed(candidates: DataFrame, asked: DataFrame, blocks: DataFrame, reads: list[DataFrame]) -> DataFrame:
    """(query_id, chunk_id, score) of candidates (query_id, chunk_id): exact sums from the parts of asked terms that hold them.

    Parts are looked up by how many of them a term has, not term by term; more candidates than a few a part are in all of them."""
    candidates = staged(candidates, "candidates")
    chunks = staged(candidates.select("chunk_id").distinct(), "chunks")
    parts = staged(blocks.groupBy("term").agg(F.max("parts").alias("parts")), "parts")
    if chunks.count() > 16 * (parts.agg(F.max("parts")).first()[0] or 1):
        held = blocks.select("term", "part").distinct()
    else:
        places = chunks.join(F.broadcast(parts.select("parts").distinct())).select("parts", part_of(F.col("chunk_id"), F.col("parts")).alias("part")).distinct()
        held = staged(parts.join(places, "parts").select("term", "part"), "held")
        blocks = blocks.join(_few(held), ["term", "part"], "left_semi")
    reads.append(held)
    rows = _postings(blocks).join(_few(chunks), "chunk_id", "left_semi").join(candidates, "chunk_id").join(_few(asked), ["query_id", "term"])
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))


def dense(queries: DataFrame, vectors: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """Cosine of unit vectors (chunk_id, v) for queries (query_id, q): exact, by matrix products where the vectors lie.

    Queries are a stated set; a block of them goes to every task, which sends on the k best of each query
    for each batch of vectors only. More queries than a block are dealt in several, one scan of the vectors each.
    Queries with one vector are searched as one, and its list is dealt to them."""
    kinds = staged(queries.groupBy("q").agg(F.min("query_id").alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    count, asked = kinds.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count == asked:
        return _dense(queries, vectors, k, block, count)
    each = queries.join(kinds.select("q", "first"), "q").select("first", "query_id")
    found = _dense(kinds.select(F.col("first").alias("query_id"), "q"), vectors, k, block, count)
    return found.withColumnRenamed("query_id", "first").join(each, "first").select("query_id", "chunk_id", "score", "rank")


def _dense(queries: DataFrame, vectors: DataFrame, k: int, block: int, count: int) -> DataFrame:
    blocks = max(1, -(-count // block))
    parts = [queries] if blocks == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
    out = None
    for part in parts:
        scores = top_by_query(_block_scores(part, vectors, k), k)
        out = scores if out is None else out.unionByName(scores)
    return out


def _block_scores(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    kind = vectors.schema["chunk_id"].dataType
    asked = queries.select("query_id", "q").toArrow()  # a block: bounded
    ids = asked["query_id"].to_numpy()
    sent = queries.sparkSession.sparkContext.broadcast(np.array(asked["q"].to_pylist(), np.float64).reshape(len(ids), -1) if len(ids) else None)

    def run(batches):
        q = sent.value
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            v = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
            for at in range(0, len(ids), 512):
                scores = np.round(q[at : at + 512] @ v.T, digits)
                if batch.num_rows > k:  # all that reach the k-th score: ties are settled by id later
                    limit = np.partition(scores, batch.num_rows - k, axis=1)[:, [batch.num_rows - k]]
                    row, column = np.nonzero((scores >= limit) & (scores > 0))
                else:
                    row, column = np.nonzero(scores > 0)
                yield pa.record_batch([pa.array(ids[at + row]), batch["chunk_id"].take(pa.array(column)), pa.array(scores[row, column])], ["query_id", "chunk_id", "score"])

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("chunk_id", kind), StructField("score", DoubleType())])
    return vectors.select("chunk_id", "v").mapInArrow(run, schema)


def normalised(score: Column, low: Column, high: Column) -> Column:
    """Min-max within a list; a chunk that the list misses enters as 0 and can come out negative."""
    flat = F.when(score > 0, 1.0).otherwise(0.0)
    return F.when(high.isNull() | (high == 0), 0.0).when(high == low, flat).otherwise((score - low) / (high - low))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, bm25_hits: DataFrame, alpha: float = 0.5, clamp: bool = False) -> DataFrame:
    """(query_id, chunk_id, dense, sparse, bm25, score, confidence): union of the lists in one aggregation, then list bounds by query."""
    kinds = ("dense", "sparse", "bm25")
    union = None
    for kind, hits in zip(kinds, (dense_hits, sparse_hits, bm25_hits), strict=True):
        rows = hits.select("query_id", "chunk_id", *[(F.col("score") if k == kind else F.lit(None).cast("double")).alias(k) for k in kinds])
        union = rows if union is None else union.unionByName(rows)
    merged = union.groupBy("query_id", "chunk_id").agg(*[F.max(k).alias(k) for k in kinds])
    by_query = Window.partitionBy("query_id")
    norm = {}
    for k in kinds:
        value = normalised(F.coalesce(F.col(k), F.lit(0.0)), F.min(k).over(by_query), F.max(k).over(by_query))
        norm[k] = F.greatest(value, F.lit(0.0)) if clamp else value
    out = merged.select("query_id", "chunk_id", *[norm[k].alias(k) for k in kinds])
    return out.withColumn("score", hybrid_score(alpha)).withColumn("confidence", confidence())


def hybrid_score(alpha: float) -> Column:
    return (F.col("dense") * alpha + F.col("sparse") * (1 - alpha)) * 0.8 + F.col("bm25") * 0.2


def confidence() -> Column:
    mean = (F.col("dense") + F.col("sparse") + F.col("bm25")) / 3
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean * 0.7 + (1 - F.abs(F.col("dense") - F.col("sparse"))) * 0.3))


def reciprocal_rank(*lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score): sum of 1 / (k + rank) with ranks from 1."""
    union = None
    for hits in lists:
        rows = hits.select("query_id", "chunk_id", (1.0 / (k + F.col("rank"))).alias("s"))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def top(fused: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filtered(hits: DataFrame, min_confidence: float = 0.0, languages=None, section_types=None, valid: Column | None = None) -> DataFrame:
    """Filters after the top-k: confidence, any language (missing: unknown), any section type, validity."""
    out = hits.filter(F.col("confidence") >= min_confidence)
    if languages:
        out = out.filter(F.arrays_overlap(F.coalesce("languages", F.array(F.lit("unknown"))), F.array(*[F.lit(x) for x in languages])))
    if section_types:
        out = out.filter(F.arrays_overlap("section_types", F.array(*[F.lit(x) for x in section_types])))
    return out if valid is None else out.filter(valid)


def rerank(hits: DataFrame, scorer: Column) -> DataFrame:
    """0.7 of the score and 0.3 of a scorer's column (a pandas UDF of a cross-encoder, say)."""
    return hits.withColumn("score", F.col("score") * 0.7 + scorer * 0.3)


def provenance(hits: DataFrame) -> DataFrame:
    """One row a span of a hit, with its document."""
    rows = hits.select("query_id", "chunk_id", "score", F.explode("spans").alias("s"))
    return rows.select("query_id", "chunk_id", F.split("chunk_id", "_")[0].alias("document_id"), "score", "s.*")
