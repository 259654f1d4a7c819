"""Classification and retrieval metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_union(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.select(F.col(truth).alias("label")).union(df.select(F.col(predicted))).distinct()


def confusion_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n) for every pair of labels, zeros included. One pass over the records; the rest is over labels."""
    labels = label_union(df, truth, predicted)
    counted = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    hit = F.coalesce((F.col(truth) == F.col(predicted)).cast("int"), F.lit(0))
    return df.agg(F.sum(hit).alias("hits"), F.count("*").alias("n")).select("hits", "n", F.round(F.col("hits") / F.nullif(F.col("n"), F.lit(0)), 6).alias("accuracy"))


def class_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support): a row per label, then 'macro avg' and 'weighted avg'; 0 where undefined."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.union(pairs.select(F.col("p"), F.lit(0).cast("bigint"), F.col("n"), F.lit(0).cast("bigint")))
    by = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    by = by.select("label", F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0).alias("precision"), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"), F.when(F.col("called") + F.col("support") > 0, 2 * F.col("tp") / (F.col("called") + F.col("support"))).otherwise(0.0).alias("f1"), "support")
    parts = ["precision", "recall", "f1"]
    macro = by.agg(*[F.avg(c).alias(c) for c in parts], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *parts, "support")
    weighted = by.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in parts], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *parts, "support")
    return by.union(macro).union(weighted).select("label", *[F.round(c, 6).alias(c) for c in parts], "support")


def evaluation_bundle(df: DataFrame, classifier: str, text_column: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row with everything that is kept of an evaluation: classifier, model_text_column, records, accuracy, macro_f1,
    weighted_f1, the report by label and the confusion matrix (rows by truth, columns by prediction, labels in order)."""
    pairs = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    report = class_report(df, truth, predicted)
    of = lambda name: F.max(F.when(F.col("label") == name, F.col("f1")))
    by = F.array_sort(F.collect_list(F.when(~F.col("label").isin("macro avg", "weighted avg"), F.struct("label", "precision", "recall", "f1", "support"))))
    scores = report.agg(of("macro avg").alias("macro_f1"), of("weighted avg").alias("weighted_f1"), by.alias("report"))
    rows = confusion_counts(df, truth, predicted).groupBy("truth").agg(F.transform(F.array_sort(F.collect_list(F.struct("predicted", "n"))), lambda x: x["n"]).alias("row"))
    matrix = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("truth", "row"))), lambda x: x["row"]).alias("confusion"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    total = pairs.agg(F.sum("n").alias("records"), F.round(hit / F.sum("n"), 6).alias("accuracy"))
    one = total.crossJoin(scores).crossJoin(matrix)  # a row each
    return one.select(F.lit(classifier).alias("classifier"), F.lit(text_column).alias("model_text_column"), "records", "accuracy", "macro_f1", "weighted_f1", "report", "confusion")


def precision_at_k(found: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """(src_id, hits, retrieved, precision): share of a query's neighbours that have its label; 0 without neighbours.

    found is (src_id, dst_id, ...), labels (id, label), queries (id)."""
    own = queries.select(F.col("id").alias("src_id")).distinct().join(labels.select(F.col("id").alias("src_id"), F.col("label").alias("mine")), "src_id", "left")
    other = found.join(labels.select(F.col("id").alias("dst_id"), F.col("label").alias("theirs")), "dst_id", "left")
    joined = own.join(other, "src_id", "left").groupBy("src_id").agg(F.sum(F.when(F.col("mine") == F.col("theirs"), 1).otherwise(0)).alias("hits"), F.count("dst_id").alias("retrieved"))
    return joined.withColumn("precision", F.round(F.when(F.col("retrieved") > 0, F.col("hits") / F.col("retrieved")).otherwise(0.0), 6))


def mean_precision(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("num_queries"), F.sum("hits").alias("hits"), F.round(F.avg("precision"), 6).alias("mean_precision"))


def ranking_metrics(found: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg) of ranked results (query_id, item_id, rank) against gold (query_id,
    item_id); queries without gold are skipped, items listed twice count once, results beyond k are ignored."""
    wanted = gold.where("query_id is not null and item_id is not null").select("query_id", "item_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = found.where(F.col("rank") <= k).groupBy("query_id", "item_id").agg(F.min("rank").alias("rank")).join(wanted, ["query_id", "item_id"])
    by = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return total.join(by, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def support_rates(claims: DataFrame) -> DataFrame:
    """Supported-claim rate and citation precision of (claim_id, chunk_id, supported): the share of claims with a
    supporting citation, and the share of citations that support. A claim without citation has a null chunk_id."""
    ok = F.coalesce(F.col("supported"), F.lit(False)) & F.col("chunk_id").isNotNull()
    by = claims.groupBy("claim_id").agg(F.max(ok.cast("int")).alias("ok"))
    return by.agg(F.count("*").alias("claims"), F.round(F.avg("ok"), 6).alias("supported_claim_rate")).crossJoin(claims.where("chunk_id is not null").agg(F.count("*").alias("citations"), F.round(F.avg(ok.cast("int")), 6).alias("citation_precision")))
