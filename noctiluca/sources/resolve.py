"""Choosing a source by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noctiluca.sources.csv import read_papers
from noctiluca.sources.synthetic import sample_papers


def resolve(spark: SparkSession, source: str, path: str | None = None, **options) -> DataFrame:
    """'synthetic', 'perfect', 'csv' (needs a path), 'feed' (needs a path) or 'api' (options of the paper API)."""
    if source in ("synthetic", "perfect"):
        return sample_papers(spark, perfect=source == "perfect", **options)
    if source in ("csv", "feed") and not path:
        raise ValueError(f"source {source} needs a path")
    if source == "csv":
        return read_papers(spark, path)
    if source == "feed":
        from noctiluca.sources.feed import feed_papers, read_feed

        return feed_papers(read_feed(spark, path))
    if source == "api":
        from noctiluca.sources.paper_api import fetch

        return fetch(spark, cache=path, **options)[0]
    raise ValueError(f"unknown source: {source}")


def split_argument(value: str) -> list[str]:
    """Parts of a comma-separated argument, stripped, blank ones dropped."""
    return [p.strip() for p in value.split(",") if p.strip()]
