"""Entries of an Atom feed as paper records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed files through the XML reader, entry by entry, so that files are split over tasks; values come as they stand."""
    return spark.read.format("xml").options(rowTag="entry", ignoreSurroundingSpaces=False).schema(schema.FEED_ENTRY).load(path)


def feed_papers(entries: DataFrame) -> DataFrame:
    """Feed entries as papers (without ids). The category is the stated primary one, else the first of the archive, else
    the first of all."""
    categories = F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: F.coalesce(c["_term"], F.lit("")))
    primary = text.primary_category(F.coalesce(F.col("`arxiv:primary_category`._term"), F.lit("")), categories)
    names = F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entries.select(text.collapse(F.col("title")).alias("title"), text.collapse(F.col("summary")).alias("abstract"), primary.alias("category"), primary.alias("primary_category"), text.join_names(names).alias("authors"), blank("published").alias("published"), blank("updated").alias("updated"), blank("id").alias("url"), text.year_prefix(F.col("published")).alias("year"))


def write_feed(papers: DataFrame, path: str) -> None:
    """Papers as feed files, one a partition and an entry a line, in the form that ``read_feed`` takes."""

    def safe(c: Column) -> Column:
        out = F.coalesce(c, F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
        return out

    def tag(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), safe(c), F.lit(f"</{name}>"))

    def term(name: str, column: str) -> Column:
        return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit(f'<{name} term="'), safe(F.col(column)), F.lit('"/>')))

    names = F.array_join(F.transform(text.split_list(F.coalesce("authors", F.lit(""))), lambda n: F.concat(F.lit("<author>"), tag("name", n), F.lit("</author>"))), "")
    plain = [tag(name, F.col(c)) for name, c in (("id", "url"), ("title", "title"), ("summary", "abstract"), ("published", "published"), ("updated", "updated"))]
    def rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<feed>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</feed>"]})

    entry = F.concat(F.lit("<entry>"), *plain, names, term("category", "category"), term('arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom"', "primary_category"), F.lit("</entry>"))
    papers.select(entry.alias("value")).mapInPandas(rooted, "value string").write.mode("overwrite").text(path)
