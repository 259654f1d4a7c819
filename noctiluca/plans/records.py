"""Queries over paper records: cleaning, deduplication, statistics, splits, exploring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text
from noctiluca.functions.text import NA_TOKENS, WS
from noctiluca.operators import explore, stats
from noctiluca.operators.records import clean_papers, fetch_counters, finalize, keep_first, union_of, with_prefix, year_between
from noctiluca.plans.registry import query, read
from noctiluca.sources.paper_api import windows

NA_LIST = ", ".join(f"'{t}'" for t in NA_TOKENS)
OUTER = f"^{WS}+|{WS}+$"


def sql_fill(column: str, default: str = "") -> str:
    return f"regexp_replace(coalesce(CASE WHEN {column} NOT IN ({NA_LIST}) THEN {column} END, '{default}'), '{OUTER}', '', 'g')"


CLEAN = f"""clean AS (
  SELECT * FROM (
    SELECT paper_id, {sql_fill("title")} AS title, {sql_fill("abstract")} AS abstract, {sql_fill("category", "unknown")} AS category, primary_category,
           {sql_fill("authors")} AS authors, {sql_fill("published")} AS published, {sql_fill("updated")} AS updated, {sql_fill("url")} AS url
    FROM papers)
  WHERE title <> '' AND abstract <> '')"""
KEY = f"CASE WHEN regexp_replace(coalesce(url, ''), '{OUTER}', '', 'g') <> '' THEN regexp_replace(url, '{OUTER}', '', 'g') ELSE coalesce(title, '') || '::' || coalesce(published, '') END"
YEAR = "CAST(date_part('year', timezone('UTC', try_cast(CASE WHEN regexp_matches(p, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN p || 'T00:00:00Z' WHEN regexp_matches(p, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9:]+)$') THEN p END AS TIMESTAMPTZ))) AS INTEGER)"


def papers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "papers")


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_papers(papers(spark, folder))


@query(f"WITH {CLEAN} SELECT *, regexp_replace(title || '. ' || abstract, '{OUTER}', '', 'g') AS combined_text FROM clean")
def cleaned_papers(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder)


@query(f"SELECT paper_id, trim(regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(abstract, ''), '{WS}+', ' ', 'g')) AS abstract FROM papers")
def collapsed_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).select("paper_id", text.collapse(F.col("title")).alias("title"), text.collapse(F.col("abstract")).alias("abstract"))


@query("SELECT paper_id, substr(coalesce(published, ''), 1, 4) AS year_text, CASE WHEN coalesce(published, '') <> '' THEN substr(published, 1, 10) ELSE 'Unknown date' END AS date_shown FROM papers")
def shown_dates(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).select("paper_id", text.year_prefix(F.col("published")).alias("year_text"), text.display_date(F.col("published")).alias("date_shown"))


@query(f"WITH y AS (SELECT {YEAR} AS year FROM (SELECT regexp_replace(published, '{OUTER}', '', 'g') AS p FROM papers)) SELECT year, count(*) AS n FROM y WHERE year IS NOT NULL GROUP BY year")
def year_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.year_distribution(papers(spark, folder))


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def order_years(spark: SparkSession, folder: str) -> DataFrame:
    return stats.year_distribution(read(spark, folder, "orders").select(F.col("o_orderdate").cast("string").alias("published")))


@query(f"SELECT paper_id, {YEAR} AS year FROM (SELECT paper_id, regexp_replace(published, '{OUTER}', '', 'g') AS p FROM papers) WHERE {YEAR} BETWEEN 2018 AND 2021")
def papers_of_years(spark: SparkSession, folder: str) -> DataFrame:
    return year_between(papers(spark, folder), 2021, 2018).select("paper_id", text.published_year(F.col("published")).alias("year"))


@query("SELECT CAST(y AS INTEGER) AS window_year, CAST(2024 - y AS INTEGER) AS place FROM range(2015, 2025) t(y)")
def year_windows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(y, i) for i, y in enumerate(windows(2024, 2015))], "window_year int, place int")


@query("SELECT paper_id, coalesce(nullif(primary_category, ''), list_filter(c, lambda x: starts_with(x, 'astro-ph.'))[1], c[1], 'unknown') AS category FROM (SELECT paper_id, primary_category, list_filter([category, primary_category], lambda x: x IS NOT NULL) AS c FROM papers)")
def primary_categories(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.array_compact(F.array("category", "primary_category"))
    return papers(spark, folder).select("paper_id", text.primary_category(F.coalesce("primary_category", F.lit("")), listed).alias("category"))


@query(f"SELECT paper_id, array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> ''), ', ') AS authors, len(list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: regexp_replace(x, '{OUTER}', '', 'g')), lambda x: x <> '')) AS n_authors FROM papers")
def author_lists(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.coalesce("authors", F.lit(""))
    return papers(spark, folder).select("paper_id", text.join_names(F.split(entry, ",")).alias("authors"), F.size(text.split_list(entry)).cast("bigint").alias("n_authors"))


@query("SELECT paper_id, title, category FROM papers WHERE starts_with(category, 'astro-ph.')")
def prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    return with_prefix(papers(spark, folder)).select("paper_id", "title", "category")


@query(f"SELECT paper_id, dedup_key FROM (SELECT paper_id, {KEY} AS dedup_key FROM papers) QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY paper_id) = 1")
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    keyed = papers(spark, folder).select("paper_id", text.dedup_key(F.col("url"), F.col("title"), F.col("published")).alias("dedup_key"))
    return keep_first(keyed, ["dedup_key"], ["paper_id"])


@query(f"""WITH kept AS (SELECT *, {KEY} AS k FROM papers WHERE starts_with(category, 'astro-ph.') QUALIFY row_number() OVER (PARTITION BY k ORDER BY paper_id) = 1),
top AS (SELECT * FROM kept ORDER BY paper_id LIMIT 500)
SELECT row_number() OVER (ORDER BY paper_id) AS paper_id, title, category, url FROM top""")
def finalized_500(spark: SparkSession, folder: str) -> DataFrame:
    return finalize(papers(spark, folder), limit=500).select("paper_id", "title", "category", "url")


@query("""WITH kept AS (SELECT *, coalesce(url, '') AS k FROM papers WHERE starts_with(category, 'astro-ph.') QUALIFY row_number() OVER (PARTITION BY k ORDER BY paper_id) = 1)
SELECT row_number() OVER (ORDER BY paper_id) AS paper_id, title, category, url FROM kept""")
def finalized_by_url(spark: SparkSession, folder: str) -> DataFrame:
    return finalize(papers(spark, folder), by_url_only=True).select("paper_id", "title", "category", "url")


@query(f"""WITH k AS (SELECT coalesce(starts_with(category, 'astro-ph.'), false) AS inside, {KEY} AS key FROM papers)
SELECT count(*) AS raw, count(DISTINCT key) FILTER (inside) AS kept, count(*) FILTER (NOT inside) AS other_category, count(*) FILTER (inside) - count(DISTINCT key) FILTER (inside) AS duplicates FROM k""")
def ingest_counters(spark: SparkSession, folder: str) -> DataFrame:
    return fetch_counters(papers(spark, folder))


@query(f"WITH {CLEAN} SELECT category, count(*) AS n FROM clean GROUP BY category")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_distribution(clean(spark, folder))


@query(f"WITH {CLEAN} SELECT count(DISTINCT category) AS n_labels, list_sort(list(DISTINCT category)) AS labels FROM clean")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_labels(clean(spark, folder))


COLOUR = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.COLORS.items()) + f" ELSE '{schema.DEFAULT_COLOR}' END"


@query(f"WITH {CLEAN} SELECT label, {COLOUR} AS color, n FROM (SELECT category AS label, count(*) AS n FROM clean GROUP BY 1)")
def legend(spark: SparkSession, folder: str) -> DataFrame:
    return stats.legend(clean(spark, folder))


@query(f"WITH {CLEAN} SELECT paper_id, {COLOUR.replace('CASE label', 'CASE category')} AS color FROM clean")
def coloured_papers(spark: SparkSession, folder: str) -> DataFrame:
    return explore.colours(clean(spark, folder)).select("paper_id", "color")


@query("SELECT n_name AS nation, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def nation_regions(spark: SparkSession, folder: str) -> DataFrame:
    region = F.broadcast(read(spark, folder, "region"))  # five rows by definition
    return read(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query(f"WITH {CLEAN}, c AS (SELECT count(*) AS n FROM clean GROUP BY category) SELECT count(*) > 1 AND min(n) >= 2 AS eligible FROM c")
def strata_eligible(spark: SparkSession, folder: str) -> DataFrame:
    return stats.can_stratify(clean(spark, folder))


@query(f"WITH {CLEAN} SELECT count(*) AS papers, count(DISTINCT category) AS categories, 'UMAP' AS projection, CASE WHEN count(*) > 1 THEN least(12, greatest(2, count(*) - 1)) ELSE 0 END AS umap_neighbors, CAST(0.08 AS DOUBLE) AS umap_min_dist, '2026-01-01 00:00 UTC' AS last_updated FROM clean")
def site_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.site_stats(clean(spark, folder), "2026-01-01 00:00 UTC")


@query(f"""WITH {CLEAN}, c AS (SELECT category, count(*) AS n FROM clean GROUP BY 1), t AS (SELECT sum(n) AS total, CAST(ceil(0.25 * sum(n)) AS BIGINT) AS target, count(*) > 1 AND min(n) >= 2 AS eligible FROM c),
s AS (SELECT paper_id, CASE WHEN eligible THEN category ELSE '' END AS stratum, md5(paper_id || '|42') AS h FROM clean, t),
q AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT stratum, CAST(target * n // total AS BIGINT) AS base, row_number() OVER (ORDER BY target * n % total DESC, stratum) AS place FROM q, t),
quota AS (SELECT stratum, base + CASE WHEN place <= (SELECT any_value(target) FROM t) - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS quota FROM r)
SELECT paper_id, row_number() OVER (PARTITION BY s.stratum ORDER BY h, paper_id) <= quota AS is_test FROM s JOIN quota USING (stratum)""")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return stats.stratified_split(clean(spark, folder)).select("paper_id", "is_test")


HAY = "lower(title || ' ' || abstract || ' ' || authors || ' ' || category)"
SEARCH = "accretion survey"
ACTIVE = ["astro-ph.GA", "astro-ph.HE"]
MATCH = " AND ".join(f"contains({HAY}, '{t}')" for t in SEARCH.split())
INSIDE = "category IN ({})".format(", ".join(f"'{c}'" for c in ACTIVE))


@query(f"WITH {CLEAN} SELECT paper_id, title, category FROM clean WHERE {MATCH} AND {INSIDE}")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return explore.search(clean(spark, folder), SEARCH.upper(), ACTIVE).select("paper_id", "title", "category")


@query(f"WITH {CLEAN} SELECT paper_id, title, category FROM clean WHERE {MATCH} ORDER BY paper_id LIMIT 40")
def first_results(spark: SparkSession, folder: str) -> DataFrame:
    return explore.result_list(explore.search(clean(spark, folder), SEARCH)).select("paper_id", "title", "category")


@query(f"WITH {CLEAN} SELECT count(*) FILTER ({MATCH} AND {INSIDE}) AS matched, count(*) AS total FROM clean")
def result_summary(spark: SparkSession, folder: str) -> DataFrame:
    return explore.result_summary(clean(spark, folder), SEARCH, ACTIVE)


@query(f"WITH {CLEAN} SELECT coalesce(max(CASE WHEN paper_id = 7 THEN paper_id END), min(paper_id)) AS selected FROM clean WHERE {MATCH} AND {INSIDE}")
def selection(spark: SparkSession, folder: str) -> DataFrame:
    return explore.selection(clean(spark, folder), 7, SEARCH, ACTIVE)


SCALED = "scaled AS (SELECT id, category, (x - min(x) OVER ()) / greatest(max(x) OVER () - min(x) OVER (), 1e-9) AS x, (y - min(y) OVER ()) / greatest(max(y) OVER () - min(y) OVER (), 1e-9) AS y FROM atlas_points)"


@query(f"WITH {SCALED} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM scaled")
def scaled_points(spark: SparkSession, folder: str) -> DataFrame:
    return explore.min_max_scale(read(spark, folder, "atlas_points").select("id", "x", "y")).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _view(spark: SparkSession, folder: str) -> DataFrame:
    scaled = explore.min_max_scale(read(spark, folder, "atlas_points").select("id", "category", "x", "y")).withColumn("is_match", F.coalesce(F.col("category") == "astro-ph.GA", F.lit(False)))
    return explore.view_position(scaled, 1200.0, 800.0, zoom=1.3924, pan_x=15.0, pan_y=-20.0, focus=True)


PULL = "CASE WHEN category = 'astro-ph.GA' THEN 0.82 ELSE 1.0 END * 1.3924"
VIEW = f"view_ AS (SELECT id, category, CAST(600 + (28 + x * 1144 - 600) * {PULL} + 15 AS DOUBLE) AS px, CAST(400 + (28 + (1 - y) * 744 - 400) * {PULL} - 20 AS DOUBLE) AS py FROM scaled)"


@query(f"WITH {SCALED}, {VIEW} SELECT id, round(px, 4) AS px, round(py, 4) AS py FROM view_")
def view_positions(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder).select("id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(f"""WITH {SCALED}, {VIEW}, probes AS (SELECT id AS probe_id, round(px + 5, 0) AS mx, round(py - 3, 0) AS my FROM view_ WHERE id % 50 = 0),
d AS (SELECT probe_id, id AS point_id, sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) AS distance FROM probes, view_ WHERE abs(mx - px) < 16 AND abs(my - py) < 16)
SELECT probe_id, point_id, round(distance, 6) AS distance FROM d WHERE distance < 16 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY d.distance, point_id) = 1""")
def nearest_points(spark: SparkSession, folder: str) -> DataFrame:
    view = _view(spark, folder)
    probes = view.where("id % 50 = 0").select(F.col("id").alias("probe_id"), F.round(F.col("px") + 5, 0).alias("mx"), F.round(F.col("py") - 3, 0).alias("my"))
    return explore.nearest_points(probes, view)


@query("SELECT id, list_transform(list_slice(recommendations, 1, 6), lambda r: r.id) AS preview FROM atlas_points WHERE recommendations IS NOT NULL")
def neighbour_previews(spark: SparkSession, folder: str) -> DataFrame:
    return explore.previews(read(spark, folder, "atlas_points"))


@query("SELECT a.id, r.id AS rec_id, p.paper_id IS NOT NULL AS known, p.title FROM (SELECT id, unnest(recommendations) AS r FROM atlas_points) a LEFT JOIN papers p ON p.paper_id = a.r.id")
def recommendation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return explore.recommendation_links(read(spark, folder, "atlas_points"), papers(spark, folder))


@query("SELECT paper_id, category, lower(trim(split)) AS split FROM papers JOIN (SELECT DISTINCT paper_id, split FROM paper_splits WHERE source = 'year_window' UNION ALL SELECT DISTINCT paper_id, split FROM paper_splits WHERE source = 'manual_import') USING (paper_id)")
def union_of_feeds(spark: SparkSession, folder: str) -> DataFrame:
    splits = read(spark, folder, "paper_splits")
    feeds = [splits.where(F.col("source") == s).select("paper_id", "split").distinct() for s in ("year_window", "manual_import")]
    return papers(spark, folder).select("paper_id", "category").join(union_of(feeds), "paper_id").select("paper_id", "category", F.lower(F.trim("split")).alias("split"))
