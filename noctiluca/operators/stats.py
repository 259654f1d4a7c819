"""Distributions, site statistics and the stratified split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text
from noctiluca.session import cut


def label_distribution(df: DataFrame, label: str = "category") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def year_distribution(df: DataFrame, column: str = "published") -> DataFrame:
    return df.select(text.published_year(F.col(column)).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def distinct_labels(df: DataFrame, label: str = "category") -> DataFrame:
    return df.agg(F.countDistinct(label).alias("n_labels"), F.array_sort(F.collect_set(label)).alias("labels"))


def legend(df: DataFrame, label: str = "category") -> DataFrame:
    """(label, colour, count), by label."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("color", text.lookup(F.col("label"), schema.COLORS, schema.DEFAULT_COLOR)).select("label", "color", "n").orderBy("label")


def can_stratify(df: DataFrame, label: str = "category") -> DataFrame:
    """One row: whether there are several labels and each has two records at least."""
    return df.groupBy(label).agg(F.count("*").alias("n")).agg(F.coalesce((F.count("*") > 1) & (F.min("n") >= 2), F.lit(False)).alias("eligible"))


def site_stats(df: DataFrame, stamp: str, projection: str = "UMAP", label: str = "category") -> DataFrame:
    """One row with the numbers of the site; the time stamp is a parameter so that a run can be repeated."""
    n = F.count("*")
    neighbours = F.when(n > 1, F.least(F.lit(schema.UMAP_NEIGHBOURS), F.greatest(F.lit(2), n - 1))).otherwise(0)
    return df.agg(n.alias("papers"), F.countDistinct(label).alias("categories"), F.lit(projection).alias("projection"), neighbours.cast("bigint").alias("umap_neighbors"), F.lit(schema.UMAP_MIN_DIST).alias("umap_min_dist"), F.lit(stamp).alias("last_updated"))


def stratified_split(df: DataFrame, id_col: str = "paper_id", label: str = "category", share: float = schema.TEST_SHARE, seed: int = schema.SEED) -> DataFrame:
    """df with is_test: exactly ceil(share n) test records, per label in proportion (largest remainders), in hash order.

    Without eligible labels (a single one, or one with a single record) the split is over all records. Ids, labels and
    hashes are written once; the first bits of the md5 order are counted, and only the records of the bin where a label's
    quota ends are ranked. What comes to the driver is one row per label and bin (at most 4,096 bins), then one threshold
    per label, with which the records are marked in one pass and without a shuffle."""
    spark = df.sparkSession
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    stratum = F.coalesce(F.col(label), F.lit(""))
    light = cut(df.select(F.col(id_col).alias("_id"), stratum.alias("_label"), order.alias("_h")))
    counted: dict[str, dict[str, int]] = {}
    for r in light.groupBy("_label", F.substring("_h", 1, 3).alias("bin")).agg(F.count("*").alias("n")).collect():
        counted.setdefault(r["_label"], {})[r["bin"]] = r["n"]
    eligible = len(counted) > 1 and all(sum(bins.values()) >= 2 for bins in counted.values())
    if not eligible:
        merged: dict[str, int] = {}
        for bins in counted.values():
            for b, n in bins.items():
                merged[b] = merged.get(b, 0) + n
        counted = {"": merged} if merged else {}
    counts = {s: sum(bins.values()) for s, bins in counted.items()}
    total = sum(counts.values())
    target = math.ceil(share * total)
    quota = {s: target * n // total for s, n in counts.items()}
    for s in sorted(counts, key=lambda s: (-(target * counts[s] % total), s))[: target - sum(quota.values())]:
        quota[s] += 1
    edges = []
    for s, q in quota.items():
        before, edge = 0, ""
        for b, n in sorted(counted[s].items()):
            edge = b
            if before + n >= q:
                break
            before += n
        edges.append((s, edge, q - before))
    of = F.col("_label") if eligible else F.lit("")
    bounds = F.broadcast(spark.createDataFrame(edges or [("", "", 0)], "_stratum string, _edge string, _rest int"))
    inside = light.withColumn("_stratum", of).join(bounds, "_stratum").where(F.substring("_h", 1, 3) == F.col("_edge"))
    last = inside.withColumn("_rank", F.row_number().over(Window.partitionBy("_stratum").orderBy("_h", "_id"))).where(F.col("_rank") == F.col("_rest"))
    known = {r["_stratum"]: (r["_h"], r["_id"]) for r in last.select("_stratum", "_h", "_id").collect()}
    # without a last record in the bin the quota ends before it
    ends = [(s, *(known.get(s, (e, None)))) for s, e, _ in edges] or [("", "", None)]
    kind = dict(df.select(F.col(id_col).alias("_id")).dtypes)["_id"]
    limits = F.broadcast(spark.createDataFrame(ends, f"_stratum string, _last_h string, _last_id {kind}"))
    marked = df.withColumn("_stratum", stratum if eligible else F.lit("")).withColumn("_h", order).join(limits, "_stratum")
    tied = F.coalesce((F.col("_h") == F.col("_last_h")) & (F.col(id_col) <= F.col("_last_id")), F.lit(False))
    return marked.withColumn("is_test", (F.col("_h") < F.col("_last_h")) | tied).drop("_stratum", "_h", "_last_h", "_last_id")
