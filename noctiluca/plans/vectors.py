"""Queries over vectors. The queries of a search are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import vectors as v
from noctiluca.operators import evaluate, knn
from noctiluca.operators.atlas import atlas_points
from noctiluca.operators.classify import majority_label
from noctiluca.operators.project import covariances, neighbour_graph, pca_map, umap_map
from noctiluca.plans.records import CLEAN, COLOUR, clean
from noctiluca.plans.registry import query, read

K, R, EVERY = schema.TOP_K, schema.RECOMMENDATIONS, 50

UNIT = """usable AS (SELECT DISTINCT paper_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM paper_vectors WHERE len(embedding) = 128 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
unit AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM usable)"""
NEAR = UNIT + f""", near AS (SELECT a.id AS src_id, b.id AS dst_id, max(round(list_dot_product(a.u, b.u), 8)) AS sim FROM unit a JOIN unit b ON a.id <> b.id WHERE a.id % {EVERY} = 0 GROUP BY 1, 2),
ranked AS (SELECT src_id, dst_id, sim, row_number() OVER (PARTITION BY src_id ORDER BY sim DESC, dst_id) AS rank FROM near)"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return knn.vector_table(read(spark, folder, "paper_vectors"))


def neighbours(spark: SparkSession, folder: str, k: int = R) -> DataFrame:
    rows = corpus(spark, folder)
    return knn.nearest(rows.where(F.col("id") % EVERY == 0), rows, k)


@query(f"WITH {UNIT} SELECT id, round(list_dot_product(u, u), 6) AS squared, round(list_sum(u), 6) AS total FROM unit")
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    u = corpus(spark, folder).distinct().select("id", v.unit(F.col("vec")).alias("u"))
    return u.select("id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {NEAR} SELECT src_id, dst_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {K}")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder, K).select("src_id", "dst_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {NEAR}, {CLEAN} SELECT src_id, CAST(rank AS INTEGER) AS rank, dst_id, title, category, url, authors, published, round(least(1, greatest(0, (sim + 1) / 2)) * 100, 1) AS match_pct FROM ranked LEFT JOIN clean ON paper_id = dst_id WHERE rank <= {R} AND sim > -1")
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return knn.recommendations(neighbours(spark, folder), clean(spark, folder))


@query(f"WITH {NEAR} SELECT src_id, list(dst_id ORDER BY rank) AS ids, list(round(least(1, greatest(0, (sim + 1) / 2)) * 100, 1) ORDER BY rank) AS matches FROM ranked WHERE rank <= {R} AND sim > -1 GROUP BY 1")
def nested_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    nested = knn.nested_recommendations(knn.recommendations(neighbours(spark, folder), clean(spark, folder)))
    return nested.select("src_id", F.transform("recommendations", lambda r: r["id"]).alias("ids"), F.transform("recommendations", lambda r: r["match_pct"]).alias("matches"))


@query(f"""WITH {NEAR}, {CLEAN}, top AS (SELECT * FROM ranked WHERE rank <= {K}), l AS (SELECT paper_id AS id, category AS label FROM clean)
SELECT q.id AS src_id, coalesce(sum(CASE WHEN mine.label = theirs.label THEN 1 ELSE 0 END), 0)::BIGINT AS hits, count(dst_id) AS retrieved, round(coalesce(sum(CASE WHEN mine.label = theirs.label THEN 1 ELSE 0 END) / nullif(count(dst_id), 0), 0), 6) AS precision
FROM (SELECT DISTINCT id FROM usable WHERE id % {EVERY} = 0) q LEFT JOIN l mine ON mine.id = q.id LEFT JOIN top ON src_id = q.id LEFT JOIN l theirs ON theirs.id = dst_id GROUP BY 1""")
def precision_at_5(spark: SparkSession, folder: str) -> DataFrame:
    labels = clean(spark, folder).select(F.col("paper_id").alias("id"), F.col("category").alias("label"))
    asked = corpus(spark, folder).where(F.col("id") % EVERY == 0).select("id")
    return evaluate.precision_at_k(neighbours(spark, folder, K), labels, asked)


@query(f"""WITH {NEAR}, {CLEAN}, top AS (SELECT * FROM ranked WHERE rank <= {K}), l AS (SELECT paper_id AS id, category AS label FROM clean),
per AS (SELECT q.id, sum(CASE WHEN mine.label = theirs.label THEN 1 ELSE 0 END)::BIGINT AS hits, round(coalesce(sum(CASE WHEN mine.label = theirs.label THEN 1 ELSE 0 END) / nullif(count(dst_id), 0), 0), 6) AS p
FROM (SELECT DISTINCT id FROM usable WHERE id % {EVERY} = 0) q LEFT JOIN l mine ON mine.id = q.id LEFT JOIN top ON src_id = q.id LEFT JOIN l theirs ON theirs.id = dst_id GROUP BY 1)
SELECT count(*) AS num_queries, sum(hits)::BIGINT AS hits, round(avg(p), 6) AS mean_precision FROM per""")
def mean_precision_at_5(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.mean_precision(precision_at_5(spark, folder))


@query(f"""WITH {UNIT}, {CLEAN}, q AS (SELECT any_value(u) AS q FROM unit WHERE id = (SELECT min(id) FROM usable)), s AS (SELECT id, max(round(list_dot_product(u, q), 8)) AS score FROM unit, q GROUP BY 1), top AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 5)
SELECT id, title, category, round(score, 6) AS score FROM top JOIN clean ON paper_id = id""")
def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    asked = rows.orderBy("id").limit(1).first()
    return knn.semantic_search(asked["vec"] if asked else [1.0] * 128, rows, clean(spark, folder)).select("id", "title", "category", F.round("score", 6).alias("score"))


@query(f"""WITH {NEAR}, {CLEAN}, v AS (SELECT src_id, category AS label, count(*) AS n FROM ranked JOIN clean ON paper_id = dst_id WHERE rank <= {K} GROUP BY 1, 2)
SELECT src_id, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY n DESC, label) = 1""")
def majority_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = clean(spark, folder).select(F.col("paper_id").alias("id"), F.col("category").alias("label"))
    return majority_label(neighbours(spark, folder, K), labels)


@query(f"""WITH {NEAR}, {CLEAN}, n AS (SELECT src_id, count(*) AS n FROM ranked WHERE rank <= {R} AND sim > -1 GROUP BY 1), b AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM atlas_points)
SELECT id, round((x - lx) / greatest(hx - lx, 1e-9), 6) AS x, round((y - ly) / greatest(hy - ly, 1e-9), 6) AS y, c.category, {COLOUR.replace('CASE label', 'CASE c.category')} AS color, coalesce(n, 0) AS n_recommendations
FROM atlas_points a JOIN clean c ON c.paper_id = a.id, b LEFT JOIN n ON n.src_id = a.id""")
def atlas(spark: SparkSession, folder: str) -> DataFrame:
    papers = clean(spark, folder)
    nested = knn.nested_recommendations(knn.recommendations(neighbours(spark, folder), papers))
    points = atlas_points(papers, read(spark, folder, "atlas_points").select("id", "x", "y"), nested)
    return points.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "category", "color", F.size("recommendations").cast("bigint").alias("n_recommendations"))


@query("""WITH u AS (SELECT DISTINCT paper_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM paper_vectors WHERE len(embedding) = 128 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
x AS (SELECT id, unnest(range(0, 128)) AS i, unnest(e) AS v FROM u), m AS (SELECT i, avg(v) AS m FROM x GROUP BY 1), c AS (SELECT id, i, v - m AS d FROM x JOIN m USING (i))
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.d * b.d), 6) AS covariance FROM c a JOIN c b ON a.id = b.id AND a.i <= b.i GROUP BY 1, 2""")
def vector_covariances(spark: SparkSession, folder: str) -> DataFrame:
    return covariances(corpus(spark, folder).dropDuplicates(["id"]), 128).select("i", "j", F.round("covariance", 6).alias("covariance"))


@query()
def all_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """The eight nearest of every paper at any similarity, for the site; approximate in which are found."""
    rows = corpus(spark, folder).select("id", F.col("vec").cast("array<float>").alias("vec")).dropDuplicates(["id"])
    found = neighbour_graph(rows, rows.count(), 128, R)
    return found.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "rank", v.match_percent(F.col("sim").cast("double")).alias("match_pct"))


@query()
def map_by_components(spark: SparkSession, folder: str) -> DataFrame:
    return pca_map(corpus(spark, folder).dropDuplicates(["id"]))


@query()
def map_by_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return umap_map(corpus(spark, folder))
