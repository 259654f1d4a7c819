"""Queries over labels, metrics, text features and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca.functions import text
from noctiluca.functions.text import TOKEN
from noctiluca.operators import classify, evaluate
from noctiluca.operators.stats import stratified_split
from noctiluca.plans.records import CLEAN, clean
from noctiluca.plans.registry import query

PAIRS = "pairs AS (SELECT paper_id, category AS truth, coalesce(nullif(trim(primary_category), ''), 'unknown') AS predicted FROM clean)"


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Truth is the cleaned category, the prediction the stated primary one."""
    return clean(spark, folder).select("paper_id", F.col("category").alias("truth"), F.coalesce(F.nullif(F.trim("primary_category"), F.lit("")), F.lit("unknown")).alias("predicted"))


@query(f"WITH {CLEAN}, {PAIRS} SELECT count(*) FILTER (truth = predicted) AS hits, count(*) AS n, round(count(*) FILTER (truth = predicted) / count(*), 6) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(pairs(spark, folder))


@query(f"WITH {CLEAN}, {PAIRS} SELECT DISTINCT label FROM (SELECT truth AS label FROM pairs UNION ALL SELECT predicted FROM pairs)")
def label_union(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.label_union(pairs(spark, folder))


@query(f"""WITH {CLEAN}, {PAIRS}, l AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs)
SELECT a.label AS truth, b.label AS predicted, count(paper_id) AS n FROM l a CROSS JOIN l b LEFT JOIN pairs p ON p.truth = a.label AND p.predicted = b.label GROUP BY 1, 2""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_counts(pairs(spark, folder))


@query(f"""WITH {CLEAN}, {PAIRS}, l AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs),
c AS (SELECT label, (SELECT count(*) FROM pairs WHERE truth = label) AS support, (SELECT count(*) FROM pairs WHERE predicted = label) AS called, (SELECT count(*) FROM pairs WHERE truth = label AND predicted = label) AS tp FROM l),
r AS (SELECT label, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, 2 * tp / (called + support) AS f1, support FROM c)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r""")
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.class_report(pairs(spark, folder))


@query(f"""WITH {CLEAN}, {PAIRS}, l AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs),
c AS (SELECT label, (SELECT count(*) FROM pairs WHERE truth = label) AS support, (SELECT count(*) FROM pairs WHERE predicted = label) AS called, (SELECT count(*) FROM pairs WHERE truth = label AND predicted = label) AS tp FROM l),
r AS (SELECT label, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, 2 * tp / (called + support) AS f1, support FROM c),
m AS (SELECT a.label AS t, list(n ORDER BY b.label) AS row FROM l a CROSS JOIN l b LEFT JOIN LATERAL (SELECT count(*) AS n FROM pairs p WHERE p.truth = a.label AND p.predicted = b.label) ON true GROUP BY 1)
SELECT 'majority' AS classifier, 'combined_text' AS model_text_column, (SELECT count(*) FROM pairs) AS records, (SELECT round(count(*) FILTER (truth = predicted) / count(*), 6) FROM pairs) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) AS labels, sum(support)::BIGINT AS support, (SELECT list(row ORDER BY t) FROM m) AS confusion FROM r""")
def evaluation_bundle(spark: SparkSession, folder: str) -> DataFrame:
    one = evaluate.evaluation_bundle(pairs(spark, folder), "majority", "combined_text")
    return one.select("classifier", "model_text_column", "records", "accuracy", "macro_f1", "weighted_f1", F.size("report").cast("bigint").alias("labels"), F.aggregate("report", F.lit(0).cast("bigint"), lambda s, x: s + x["support"]).alias("support"), "confusion")


@query(f"WITH {CLEAN} SELECT category AS label, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT category FROM clean)")
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    return classify.encode_labels(clean(spark, folder))


TOKENS = f"tok AS (SELECT paper_id, regexp_extract_all(strip_accents(lower(title || '. ' || abstract)), '{TOKEN}') AS w FROM clean)"
TERMS = TOKENS + ", terms AS (SELECT paper_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok), per AS (SELECT paper_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"
VOCAB = TERMS + ", vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM per GROUP BY 1 ORDER BY total DESC, term LIMIT 8000)"


@query(f"WITH {CLEAN}, {TOKENS} SELECT paper_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM tok")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    words = clean(spark, folder).select("paper_id", text.tokens(F.col("combined_text")).alias("w"))
    return words.select("paper_id", F.size("w").cast("bigint").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query(f"WITH {CLEAN}, {VOCAB} SELECT * FROM vocab")
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return classify.term_statistics(clean(spark, folder), "paper_id", "combined_text")


@query(f"""WITH {CLEAN}, {VOCAB}, raw AS (SELECT paper_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM clean)) / (1 + df)) + 1) AS w FROM per JOIN vocab USING (term))
SELECT paper_id AS id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)), 6) AS weight FROM raw""")
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    return classify.tfidf(clean(spark, folder), "paper_id", "combined_text")


@query(f"""WITH {CLEAN}, {TOKENS}, v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS number FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM tok) GROUP BY 1 ORDER BY n DESC, word LIMIT 8000)),
p AS (SELECT paper_id, i AS pos, w[i] AS word FROM (SELECT paper_id, w, unnest(range(1, least(len(w), 64) + 1)) AS i FROM tok)),
s AS (SELECT paper_id, list(coalesce(number, 1) ORDER BY pos) AS ids FROM p LEFT JOIN v USING (word) GROUP BY 1)
SELECT tok.paper_id AS id, list_transform(range(1, 65), lambda i: CAST(coalesce(ids[i], 0) AS INTEGER)) AS input_ids, list_transform(range(1, 65), lambda i: CASE WHEN i <= len(w) THEN 1 ELSE 0 END) AS attention_mask FROM tok LEFT JOIN s USING (paper_id)""")
def padded_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return classify.token_sequences(clean(spark, folder), "paper_id", "combined_text", 64)


def _tested(spark: SparkSession, folder: str, version: str) -> DataFrame:
    split = stratified_split(clean(spark, folder).select("paper_id", "category", "combined_text")).persist()
    model = classify.train_classifier(split.where("not is_test"), version)
    split.unpersist()
    return classify.predict(model, split.where("is_test")).select("paper_id", F.col("category").alias("truth"), "predicted")


@query()
def linear_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return _tested(spark, folder, "v1")


@query()
def network_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return _tested(spark, folder, "v2")


@query()
def hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return classify.hashing_embedder(clean(spark, folder))
