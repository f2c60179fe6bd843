"""Postings and vectors of chunks (chunk_id, text): BM25, TF-IDF and unit vectors. Indices are tables, keyed by chunk_id."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.staging import staged

# fixed values: parameters of the ranking function
K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_TERMS = 10_000
BLOCK, LEVELS, BUCKETS = 2048, 8, 16  # postings of a part, levels of impact, folders of a written table of blocks
SENT_TERMS = 1_000_000  # terms of a vocabulary that are sent to the postings
SUMS, MOST_PARTS = 1 << 20, 20_000  # sums by query and chunk that a task holds, and parts that they are dealt to
#: a short list of our own; the query and its oracle share it
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: Column) -> Column:
    """Lower-case words, with repetition."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


@dataclass(frozen=True)
class Lexical:
    """What both lexical rankings read, from one tokenisation: term counts by chunk, the vocabulary, and three totals."""

    counts: DataFrame  #: (chunk_id, doc_len, terms array<struct<term, tf>>)
    vocabulary: DataFrame  #: (term, df, total)
    n: int
    avgdl: float
    mean_idf: float

    def postings(self, only: list[str] | None = None, by_chunk: int = 0, beside: DataFrame | None = None) -> DataFrame:
        """(chunk_id, doc_len, term, tf), a row a distinct term of a chunk (of those in `only`, if given), with the columns that beside has for the chunk_id.

        by_chunk: dealt by chunk_id while a chunk is one row, so that sums by query and chunk need no shuffle of their own; the
        number says how many sums a chunk can have, and a task gets as few chunks as keep its sums below SUMS."""
        counts = self.counts if only is None else self.counts.withColumn("terms", F.filter("terms", lambda t: t["term"].isin(only)))
        if by_chunk:
            least = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            counts = counts.repartition(max(least, min(MOST_PARTS, -(-self.n * by_chunk // SUMS))), "chunk_id")
        counts = counts if beside is None else counts.join(beside, "chunk_id")
        more = [c for c in counts.columns if c != "terms"]
        return counts.select(*more, F.explode("terms").alias("_p")).select(*more, "_p.term", "_p.tf")


def term_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_len, terms): runs of equal words in each chunk's sorted words, so counting needs no shuffle."""
    words = chunks.select("chunk_id", F.array_sort(tokens(F.col("text"))).alias("_w"))
    first = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    words = words.withColumn("_at", F.when(F.size("_w") > 0, first).otherwise(F.array().cast("array<int>")))
    run = lambda i, k: F.struct(F.get("_w", i - 1).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_w") + 1) - i).alias("tf"))
    return words.select("chunk_id", F.size("_w").alias("doc_len"), F.transform("_at", run).alias("terms"))


def lexical(chunks: DataFrame) -> Lexical:
    """chunks (chunk_id, text), each id once; a null text counts as a chunk without words or length."""
    return lexical_of(staged(term_counts(chunks), "terms"))


def lexical_of(counts: DataFrame) -> Lexical:
    """From term_counts() of all chunks, a written table."""
    each = counts.select(F.explode("terms").alias("_p")).groupBy("_p.term").agg(F.count(F.lit(1)).alias("df"), F.sum("_p.tf").alias("total"))
    vocabulary = staged(each.select("term", "df", "total"), "vocabulary")
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("doc_len") >= 0, F.col("doc_len"))).alias("avgdl")).first()
    mean = vocabulary.agg(F.avg(_raw_idf(size["n"]))).first()[0]
    return Lexical(counts, vocabulary, size["n"], size["avgdl"] or 1.0, mean or 0.0)


def _raw_idf(n: int, df: Column | None = None) -> Column:
    df = F.col("df") if df is None else df
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25_idf(lex: Lexical, df: Column | None = None) -> Column:
    """Of a vocabulary row, or of a df: ln((n - df + 0.5) / (df + 0.5)), negative ones replaced by a quarter of the mean over all terms."""
    raw = _raw_idf(lex.n, df)
    return F.when(raw < 0, F.lit(lex.mean_idf * EPSILON)).otherwise(raw)


def bm25_weight(lex: Lexical) -> Column:
    """What one occurrence of the term in a query adds to a chunk's score, from tf, doc_len and idf."""
    return F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / lex.avgdl)))


def bm25_index(lex: Lexical) -> DataFrame:
    """(term, chunk_id, weight) of all postings. Terms of one chunk only, most of a vocabulary, need no look-up of theirs."""
    many = lex.vocabulary.filter("df > 1").select("term", bm25_idf(lex).alias("idf"))
    rows = lex.postings().join(_sent(many), "term", "left").withColumn("idf", F.coalesce("idf", bm25_idf(lex, F.lit(1))))
    return rows.select("term", "chunk_id", bm25_weight(lex).alias("weight"))


def tfidf_idf(lex: Lexical, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, idf) of the max_terms terms with most occurrences, ties by term: ln((1 + n) / (1 + df)) + 1."""
    able = lex.vocabulary.filter((F.length("term") >= 2) & ~F.col("term").isin(*STOP_WORDS)).orderBy(F.desc("total"), "term").limit(max_terms)
    return able.select("term", (F.log((1 + F.lit(lex.n)) / (1 + F.col("df"))) + 1).alias("idf"))


def norms(weighted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, norm): lengths of the vectors with rows (key, w), summed within the scan's tasks before the shuffle."""
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def tfidf_vectors(lex: Lexical, idf: DataFrame) -> DataFrame:
    """(chunk_id, term, weight) of unit length; idf has at most MAX_TERMS rows."""
    weighted = lambda posts: posts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    held = staged(lex.counts.join(norms(weighted(lex.postings())), "chunk_id"), "lengths")  # while a chunk is one row
    return weighted(replace(lex, counts=held).postings()).select("chunk_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def hashed_vectors(texts: DataFrame, key: str = "chunk_id", width: int = 64) -> DataFrame:
    """(key, embedding) of texts (key, text): each word adds 1 or -1 to one of `width` components, by its hash; a stand-in for an encoder."""
    h = F.xxhash64("w")
    words = texts.select(key, F.explode_outer(tokens(F.col("text"))).alias("w")).select(key, F.when(F.col("w").isNotNull(), F.pmod(h, F.lit(width)).cast("int")).alias("at"), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0).alias("x"))
    sums = words.groupBy(key, "at").agg(F.sum("x").alias("x"))
    held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "x")))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(chunk_id, v): vectors as doubles of length one; zero vectors go."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.withColumn("_v", v).withColumn("_norm", norm).filter("_norm > 0")
    return rows.select("chunk_id", F.transform("_v", lambda x: x / F.col("_norm")).alias("v"), *[c for c in vectors.columns if c not in ("chunk_id", "embedding")])


# --- postings in blocks ---------------------------------------------------------------------------
def blocks(index: DataFrame) -> DataFrame:
    """index (term, chunk_id, weight) -> (bucket, term, part, level, n, most, parts, chunk_ids, weights): postings in blocks of about BLOCK at most.

    A block holds the postings of one term, of one level of impact (LEVELS equal steps up to the term's largest weight, the
    highest first) and of one part of the chunks, by a hash of chunk_id; frequent terms have many parts, so no term meets in
    one task. `most` is the block's largest weight; bucket spreads terms over folders of a written table."""
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"), F.min("weight").alias("low"))
    parts = F.ceil(F.col("df") / BLOCK).cast("int")
    sizes = staged(sizes.filter("df > 1").withColumn("parts", parts), "sizes")  # what one chunk has only is its own highest level
    rows = index.join(_sent(sizes), "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    step = (F.col("top") - F.col("weight")) / F.when(F.col("top") > F.col("low"), F.col("top") - F.col("low"))
    rows = rows.withColumn("level", F.least(F.coalesce(F.floor(step * LEVELS), F.lit(0)), F.lit(LEVELS - 1)).cast("int")).withColumn("part", part_of(F.col("chunk_id"), F.col("parts")))
    held = rows.groupBy("term", "part", "level").agg(F.max("parts").alias("parts"), F.max("weight").alias("most"), F.collect_list(F.struct("chunk_id", "weight")).alias("p"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return held.select(bucket, "term", "part", "level", F.size("p").alias("n"), "most", "parts", F.col("p.chunk_id").alias("chunk_ids"), F.col("p.weight").alias("weights"))


def _sent(terms: DataFrame) -> DataFrame:
    """A table by term, sent to the postings unless it is too large."""
    return F.broadcast(terms) if terms.count() <= SENT_TERMS else terms


def part_of(chunk_id: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), parts).cast("int")


def index_statistics(lex: Lexical) -> DataFrame:
    return lex.vocabulary.agg(F.lit(lex.n).cast("long").alias("chunks"), F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


def write_indices(chunks: DataFrame, vectors: DataFrame | None, path: str) -> dict[str, str]:
    """Chunks, postings of both kinds, in rows and in blocks, and vectors as tables below path; name -> "ok" or the error of a part that failed.

    Empty input is an error; a part that fails leaves the others."""
    if not chunks.take(1):
        raise ValueError("no chunks to index")
    lex = lexical(chunks)
    idf = tfidf_idf(lex)
    parts = {"chunks": lambda: chunks, "bm25": lambda: bm25_index(lex), "tfidf_idf": lambda: idf, "tfidf": lambda: tfidf_vectors(lex, idf)}
    parts |= {"bm25_blocks": lambda: blocks(bm25_index(lex)), "tfidf_blocks": lambda: blocks(tfidf_vectors(lex, idf))}
    if vectors is not None:
        parts["dense"] = lambda: unit_vectors(vectors)
    said = {}
    for name, made in parts.items():
        try:
            table = made()
            table.write.mode("overwrite").partitionBy(*[c for c in ("bucket",) if c in table.columns]).parquet(f"{path}/{name}")
            said[name] = "ok"
        except Exception as e:  # the other parts are of use without this one
            said[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return said


def read_indices(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that write_indices left below path; a part that isn't there is missing from the result."""
    found = {}
    for name in ("chunks", "bm25", "tfidf_idf", "tfidf", "bm25_blocks", "tfidf_blocks", "dense"):
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            continue
    return found
