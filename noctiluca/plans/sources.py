"""Queries that go through a source, a sink or a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca.functions.text import WS
from noctiluca.plans.records import CLEAN, KEY, clean
from noctiluca.plans.registry import query, read
from noctiluca.rag.benchmark import read_questions, write_questions
from noctiluca.session import shared_folder
from noctiluca.sources.csv import read_papers, write_papers
from noctiluca.sources.feed import feed_papers, read_feed, write_feed
from noctiluca.sources.synthetic import sample_papers
from noctiluca.streaming.dedup import keyed_stream, run_available


@query(f"WITH {CLEAN} SELECT paper_id, title, abstract, category, authors, url FROM clean")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_folder(spark, "csv")
    write_papers(clean(spark, folder).select("paper_id", "title", "abstract", "category", "authors", "url"), at, single=False)
    return read_papers(spark, at).select("paper_id", "title", "abstract", *[F.coalesce(c, F.lit("")).alias(c) for c in ("category", "authors", "url")])


@query("SELECT id, question, reference_answer, gold_chunks, requires_multi_hop FROM questions")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_folder(spark, "json")
    write_questions(read(spark, folder, "questions"), at)
    return read_questions(spark, at).select("id", "question", "reference_answer", "gold_chunks", "requires_multi_hop")


@query(f"""WITH c AS (SELECT {", ".join(f"coalesce({x}, '') AS {x}" for x in ("title", "abstract", "category", "primary_category", "authors", "published", "updated", "url"))} FROM papers)
SELECT trim(regexp_replace(title, '{WS}+', ' ', 'g')) AS title, trim(regexp_replace(abstract, '{WS}+', ' ', 'g')) AS abstract, coalesce(nullif(primary_category, ''), nullif(category, ''), '') AS category,
array_to_string(list_filter(list_transform(string_split(authors, ','), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> ''), ', ') AS authors, published, updated, url, substr(published, 1, 4) AS year FROM c""")
def feed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_folder(spark, "feed")
    write_feed(read(spark, folder, "papers"), at)
    return feed_papers(read_feed(spark, at)).drop("primary_category")


@query()
def sample_collection(spark: SparkSession, folder: str) -> DataFrame:
    return sample_papers(spark)


@query()
def sample_collection_perfect(spark: SparkSession, folder: str) -> DataFrame:
    return sample_papers(spark, perfect=True)


@query(f"SELECT DISTINCT {KEY} AS dedup_key FROM papers WHERE starts_with(category, 'astro-ph.')")
def streamed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that a stream of the table keeps; which record of a key comes first is up to the order of arrival."""
    out = shared_folder(spark, "stream")
    table = read(spark, folder, "papers")
    path = f"{folder}/papers.parquet"
    pattern = path if os.path.isdir(path) else os.path.join(folder, "papers.parque[t]")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 8).parquet(pattern)
    run_available(keyed_stream(stream), out, out + "-state")
    return spark.read.parquet(out).select("dedup_key")


