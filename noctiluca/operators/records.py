"""Cleaning, filtering and deduplicating paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text
from noctiluca.session import cut

OPTIONAL = ("authors", "published", "updated", "url")


def require(df: DataFrame, columns: tuple[str, ...] = ("title", "abstract", "category")) -> DataFrame:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Missing required column: {c}")
    return df


def with_defaults(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """Add the optional columns that are missing; ids number the rows in ``arrival`` order (1, 2, ...)."""
    for c in OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    if "primary_category" not in df.columns:
        df = df.withColumn("primary_category", F.col("category"))
    if "paper_id" not in df.columns:
        df = dense_ids(df, arrival or F.monotonically_increasing_id(), "paper_id")
    return df


def clean_papers(df: DataFrame, na_tokens: tuple[str, ...] = text.NA_TOKENS) -> DataFrame:
    """Fill, strip and drop: text columns lose outer white space, missing ones become '' ('unknown' for the category),
    records with a blank title or abstract go (ids keep their gaps), combined_text joins title and abstract. The primary
    category is left as it came; other columns pass through."""
    df = with_defaults(require(df))
    for c in ("title", "abstract", *OPTIONAL):
        df = df.withColumn(c, text.fill(F.col(c), "", na_tokens))
    df = df.withColumn("category", text.fill(F.col("category"), "unknown", na_tokens))
    df = df.where("title <> '' and abstract <> ''")
    return df.withColumn("combined_text", text.strip(F.concat(F.col("title"), F.lit(". "), F.col("abstract"))))


def with_prefix(df: DataFrame, prefix: str = schema.PREFIX, column: str = "category") -> DataFrame:
    """Records whose category starts with the prefix; the predicate reaches the Parquet scan."""
    return df.where(F.col(column).startswith(prefix))


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first record of each key in the given order. Ranks are cut to 1 before the shuffle, so a hot key is harmless.
    Null keys are equal."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def dense_ids(df: DataFrame, order: Column | str, name: str = "paper_id") -> DataFrame:
    """Number all rows 1..n in an order, without bringing them into one task: rows are ranged, numbered per range, and the
    sizes of the ranges (one number each) give the offsets."""
    key = order if isinstance(order, Column) else F.col(order)
    ranged = cut(df.withColumn("_order", key).repartitionByRange("_order").sortWithinPartitions("_order").withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offset, total = {}, 0
    for p in sorted(sizes):
        offset[p], total = total, total + sizes[p]
    starts = F.broadcast(df.sparkSession.createDataFrame(list((offset or {0: 0}).items()), "_part int, _before bigint"))  # a row per range
    by = Window.partitionBy("_part").orderBy("_order")
    return ranged.join(starts, "_part").withColumn(name, (F.row_number().over(by) + F.col("_before")).cast("bigint")).drop("_order", "_part", "_before")


def finalize(df: DataFrame, limit: int | None = None, order: str = "paper_id", by_url_only: bool = False, prefix: str = schema.PREFIX) -> DataFrame:
    """Prefix filter, first record per key, the first ``limit`` in arrival order, new dense ids. ``by_url_only`` takes the
    address alone as key, so that at most one record without an address survives."""
    key = F.coalesce(F.col("url"), F.lit("")) if by_url_only else text.dedup_key(F.col("url"), F.col("title"), F.col("published"))
    df = keep_first(with_prefix(df, prefix).withColumn("_key", key), ["_key"], [order]).drop("_key").withColumn("_arrival", F.col(order))
    if limit is not None:
        df = df.orderBy("_arrival").limit(limit)
    return dense_ids(df.drop("paper_id"), "_arrival").drop("_arrival")


def union_of(feeds: list[DataFrame]) -> DataFrame:
    """All records of several feeds, by column name; a column that a feed lacks is null there. Repetitions stay."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def fetch_counters(df: DataFrame, order: str = "paper_id", prefix: str = schema.PREFIX) -> DataFrame:
    """(raw, kept, other_category, duplicates) of a stream of fetched records, in one row."""
    inside = F.coalesce(F.col("category").startswith(prefix), F.lit(False))
    keyed = df.withColumn("_key", text.dedup_key(F.col("url"), F.col("title"), F.col("published")))
    distinct = keyed.where(inside).agg(F.countDistinct("_key").alias("kept"))
    counts = keyed.agg(F.count("*").alias("raw"), F.count_if(inside).alias("inside"))
    return counts.crossJoin(distinct).select("raw", "kept", (F.col("raw") - F.col("inside")).alias("other_category"), (F.col("inside") - F.col("kept")).alias("duplicates"))


def year_between(df: DataFrame, from_year: int | None, to_year: int | None, column: str = "published") -> DataFrame:
    """Records published in a range of years; one bound alone means that single year, reversed bounds are swapped."""
    if from_year is None and to_year is None:
        return df
    lo, hi = from_year if from_year is not None else to_year, to_year if to_year is not None else from_year
    return df.where(text.published_year(F.col(column)).between(min(lo, hi), max(lo, hi)))
