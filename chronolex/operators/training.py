"""Training data for retrievers and claim verifiers, and the metrics of their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import modified_claim, negated_claim
from chronolex.operators.claims import extract, first_claims
from chronolex.operators.order import first_share
from chronolex.operators.scans import spread
from chronolex.staging import staged

NEGATIVES = 5
OFTEN, MOST_OFTEN = 100_000, 1_000  # pairs of a chunk from which on it is sent to them, and how many such chunks at most


def training_pairs(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """qa (question, positives, negatives) -> (question, chunk_id, text, label): all positives, the first five negatives, ids of the corpus only.

    Chunks of very many pairs are sent to them, so that their pairs don't meet in one task."""
    positive = qa.select("question", F.explode("positives").alias("chunk_id"), F.lit(1.0).alias("label"))
    negative = qa.select("question", F.explode(F.slice("negatives", 1, NEGATIVES)).alias("chunk_id"), F.lit(0.0).alias("label"))
    pairs, texts = positive.unionByName(negative), corpus.select("chunk_id", "text")
    counts = staged(pairs.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")), "asked")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = [r["chunk_id"] for r in counts.filter(F.col("n") > max(OFTEN, total // MOST_OFTEN)).collect()]  # MOST_OFTEN at most
    if not often:
        held = spread(pairs, "chunk_id", n=total).join(texts, "chunk_id")
    else:
        known = F.coalesce(F.col("chunk_id").isin(often), F.lit(False))
        held = spread(pairs.filter(~known), "chunk_id", n=total).join(texts, "chunk_id").unionByName(pairs.join(F.broadcast(texts.filter(known)), "chunk_id"))
    return held.select("question", "chunk_id", "text", "label")


def hard_negatives(hits: DataFrame, positives: DataFrame, most: int = 10) -> DataFrame:
    """hits (query_id, chunk_id, rank) that aren't positives, the best `most` of each query."""
    left = hits.join(positives, ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("query_id", "chunk_id", "n")


def retrieval_metrics(hits: DataFrame, positives: DataFrame, recall_at: tuple[int, ...] = (10, 100), map_at: int = 10, ndcg_at: int = 10) -> DataFrame:
    """(query_id, recall_at_k.., map, ndcg): hits (query_id, chunk_id, rank), positives (query_id, chunk_id); the ideal list has all positives first."""
    total = positives.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    found = hits.join(positives, ["query_id", "chunk_id"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = found.withColumn("precision", nth / F.col("rank"))
    recalls = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in recall_at]
    ap = F.sum(F.when(F.col("rank") <= map_at, F.col("precision")).otherwise(0.0)).alias("ap")
    dcg = F.sum(F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    joined = total.join(found.groupBy("query_id").agg(*recalls, ap, dcg), "query_id", "left").fillna(0)
    out = [(F.col(f"hit_{k}") / F.col("total")).alias(f"recall_at_{k}") for k in recall_at]
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return joined.select("query_id", *out, (F.col("ap") / F.least("total", F.lit(map_at))).alias("map"), (F.col("dcg") / ideal).alias("ndcg"))


def nli_pairs(raw: DataFrame) -> DataFrame:
    """premise, hypothesis, label from either spelling of the fields; unknown labels go."""
    known = {"entailment": 0, "supported": 0, "neutral": 1, "uncertain": 1, "contradiction": 2, "refuted": 2}
    either = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in raw.columns])
    mapping = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    label = F.try_element_at(mapping, F.lower(either("label", "gold_label")))
    return raw.select(either("premise", "evidence").alias("premise"), either("hypothesis", "claim").alias("hypothesis"), label.alias("label")).filter("label IS NOT NULL")


def nli_triples(texts: DataFrame, most: int = 3) -> DataFrame:
    """(answer_id, sentence_index, premise, hypothesis, label): the first claims of a text as entailed, negated and modified."""
    claims = first_claims(extract(texts), most)
    rows = claims.select("answer_id", "sentence_index", F.col("claim").alias("premise"), F.explode(F.array(*[F.lit(x) for x in ("entailment", "contradiction", "neutral")])).alias("label"))
    claim = F.col("premise")
    made = F.when(F.col("label") == "entailment", claim).when(F.col("label") == "contradiction", negated_claim(claim)).otherwise(modified_claim(claim))
    return rows.select("answer_id", "sentence_index", "premise", made.alias("hypothesis"), "label")


def ordered_split(rows: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """rows with `part`: train for the first floor(n share) in order of `by`, test for the rest, cut exactly."""
    return first_share(rows, by, share)


def confusion(predictions: DataFrame, labels: list) -> DataFrame:
    """One row a true label with the counts of each predicted one."""
    return predictions.groupBy("label").pivot("predicted", labels).count().fillna(0)


def class_scores(predictions: DataFrame) -> DataFrame:
    """One row accuracy and support-weighted precision, recall and F1."""
    both = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    support, guessed = Window.partitionBy("label"), Window.partitionBy("predicted")
    rows = both.withColumn("support", F.sum("n").over(support)).withColumn("guessed", F.sum("n").over(guessed))
    hit = rows.filter(F.col("label") == F.col("predicted")).select("label", F.col("n").alias("hit"), "guessed")
    per = both.groupBy("label").agg(F.sum("n").alias("support")).join(hit, "label", "left").fillna(0)
    per = per.withColumn("p", F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)).withColumn("r", F.col("hit") / F.col("support"))
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    return per.agg((F.sum("hit") / total).alias("accuracy"), *weighted)
