"""Answer assembly: suppression, precedence groups, decoding, refusal, citations and version differences.

Spans of an answer are rows (query_id, pos, span_id, text, precedence_weight, effective_date, ...) in their order.
Greedy rules are ordered folds over one query's spans, a handful of rows, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import answer_hash, join_coherently, overlap_coefficient, sentences, word_set

DUPLICATE, CONFLICT = 0.8, 0.7


def without_refuted_spans(spans: DataFrame, results: DataFrame) -> DataFrame:
    """Spans that no refuted claim rests on, joined on (query_id, span_id)."""
    return spans.join(results.filter("label = 'refuted'").select("query_id", "span_id").distinct(), ["query_id", "span_id"], "left_anti")


def conflict_groups(spans: DataFrame, threshold: float = CONFLICT) -> DataFrame:
    """(query_id, span_id, group): each span joins the first group whose first member it overlaps above the threshold, or opens one."""
    item = F.struct("pos", "span_id", word_set(F.col("text")).alias("words"))
    per_query = spans.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kind = spans.select("span_id").dtypes[0][1]
    start = F.struct(F.expr("CAST(array() AS array<array<string>>)").alias("seeds"), F.expr(f"CAST(array() AS array<struct<span_id:{kind},group:int>>)").alias("out"))

    def step(acc, s):
        place = F.array_position(F.transform(acc["seeds"], lambda seed: overlap_coefficient(seed, s["words"]) > threshold), F.lit(True)).cast("int")
        group = F.when(place > 0, place - 1).otherwise(F.size(acc["seeds"]))
        seeds = F.when(place > 0, acc["seeds"]).otherwise(F.concat(acc["seeds"], F.array(s["words"])))
        return F.struct(seeds.alias("seeds"), F.concat(acc["out"], F.array(F.struct(s["span_id"].alias("span_id"), group.alias("group")))).alias("out"))

    folded = per_query.select("query_id", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("g"))
    return folded.select("query_id", "g.span_id", "g.group")


def group_winners(spans: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group the span of the highest weight, then the latest effective date, then the first."""
    order = Window.partitionBy("query_id", "group").orderBy(F.desc("precedence_weight"), F.desc_nulls_last("effective_date"), "pos")
    return spans.join(groups, ["query_id", "span_id"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def decode(spans: DataFrame, max_chars: int = 1024) -> DataFrame:
    """(query_id, answer, parts): spans in order that repeat no earlier one, until the first that would exceed max_chars."""
    item = F.struct("pos", F.trim("text").alias("text"), word_set(F.col("text")).alias("words"))
    per_query = spans.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("parts"), F.expr("CAST(array() AS array<array<string>>)").alias("sets"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc, s):
        full = acc["full"] | (acc["n"] + F.length(s["text"]) + 1 > max_chars)
        take = ~full & (s["text"] != "") & ~F.exists(acc["sets"], lambda w: overlap_coefficient(w, s["words"]) > DUPLICATE)
        return F.struct(
            F.when(take, F.concat(acc["parts"], F.array(s["text"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(take, F.concat(acc["sets"], F.array(s["words"]))).otherwise(acc["sets"]).alias("sets"),
            F.when(take, acc["n"] + F.length(s["text"]) + 1).otherwise(acc["n"]).alias("n"),
            full.alias("full"),
        )

    parts = F.aggregate("s", start, step, lambda a: a["parts"])
    decoded = per_query.select("query_id", parts.alias("parts"))
    return decoded.select("query_id", join_coherently(F.col("parts")).alias("answer"), F.size("parts").alias("parts"))


def refusal(summary: DataFrame, min_spans: int = 2, threshold: float = 0.3) -> DataFrame:
    """summary with n_spans and answer -> refusal_code, the first rule that holds, or null."""
    code = (
        F.when(F.col("refusal_recommended"), "verification")
        .when(F.col("average_confidence") < threshold, "low_confidence")
        .when(F.col("refuted_claims") > 0, "refuted_claims")
        .when(F.col("n_spans") < min_spans, "insufficient_evidence")
        .when(F.trim("answer") == "", "empty_answer")
        .when(F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != "")) < 5, "too_short")
        .when(F.col("refuted_claims") / F.greatest("total_claims", F.lit(1)) > 0.3, "high_contradiction")
    )
    return summary.withColumn("refusal_code", code)


def refusal_message(code: Column) -> Column:
    return F.when(code.isNotNull(), F.concat(F.lit("I cannot provide a reliable answer due to: "), F.replace(code, F.lit("_"), F.lit(" ")), F.lit(". Please try rephrasing your question.")))


def evidence(spans: DataFrame, results: DataFrame) -> DataFrame:
    """Spans with their label and confidence, uncertain and 0 without a result."""
    labels = results.groupBy("query_id", "span_id").agg(F.max_by(F.struct("label", "confidence"), "confidence").alias("r"))
    joined = spans.join(labels, ["query_id", "span_id"], "left")
    return joined.withColumns({"label": F.coalesce("r.label", F.lit("uncertain")), "confidence": F.coalesce("r.confidence", F.lit(0.0))}).drop("r")


def cited(spans: DataFrame) -> DataFrame:
    """Evidence numbered by query in order, with its citation."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    key = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))
    text = F.format_string("%s %s, Page %s, Bytes %d-%d (Confidence: %.2f)", key, F.initcap("document_type"), F.coalesce(F.col("page_num").cast("string"), F.lit("unknown")), F.col("byte_start"), F.col("byte_end"), F.col("confidence"))
    return spans.withColumn("number", number).withColumn("citation", text)


def sentence_citations(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, sentence_index, sentence, numbers): evidence that shares min(3, 0.3 of the sentence's) words."""
    rows = answers.select("query_id", F.posexplode(sentences(F.col("answer"))).alias("sentence_index", "sentence"))
    rows = rows.withColumn("_w", word_set(F.col("sentence"))).join(spans.select("query_id", "number", word_set(F.col("text")).alias("_e")), "query_id")
    uses = F.size(F.array_intersect("_w", "_e")) >= F.least(F.lit(3.0), F.size("_w") * 0.3)
    uses = uses & (F.size("_w") > 0) & (F.size("_e") > 0)
    numbers = F.sort_array(F.collect_set(F.when(uses, F.col("number"))))
    return rows.groupBy("query_id", "sentence_index", "sentence").agg(numbers.alias("numbers"))


def annotated(cited_sentences: DataFrame) -> DataFrame:
    marks = F.array_join(F.transform("numbers", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    text = F.when(F.size("numbers") > 0, F.concat(F.regexp_replace("sentence", r"\.+$", ""), F.lit(" "), marks, F.lit("."))).otherwise(F.col("sentence"))
    ordered = F.array_sort(F.collect_list(F.struct("sentence_index", text.alias("t"))))
    return cited_sentences.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("answer"))


def evidence_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, added, removed, retained): sorted span ids of two versions, and whether the answers' hashes differ."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.sort_array(F.collect_set("span_id")).alias(name))
    both = ids(old, "o").join(ids(new, "n"), "query_id", "full_outer")
    o, n = (F.coalesce(c, F.expr("CAST(array() AS array<bigint>)")) for c in ("o", "n"))
    return both.select("query_id", F.array_except(n, o).alias("added"), F.array_except(o, n).alias("removed"), F.array_intersect(o, n).alias("retained"))


def versioned(answers: DataFrame) -> DataFrame:
    return answers.withColumn("answer_hash", answer_hash(F.col("answer")))
