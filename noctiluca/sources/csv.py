"""Paper records from and to CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema

OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}


def read_papers(spark: SparkSession, path: str, columns: str = schema.PAPERS) -> DataFrame:
    """A CSV file with a header; known columns by name with their types, further ones as text. A missing file is an error.

    Quoted cells may hold commas, quotes (doubled) and line ends. The file's own columns are read by name, so their order
    doesn't matter and absent ones stay absent."""
    raw = spark.read.options(**OPTIONS).option("inferSchema", False).csv(path)
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], columns).schema}
    return raw.select(*[(F.try_to_number(F.col(f"`{c}`"), F.lit("9999999999999999999")).cast("bigint") if types.get(c) == "bigint" else F.col(f"`{c}`")).alias(c) for c in raw.columns])


def write_papers(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header, overwriting. A single file is for small exports; larger ones keep their partitions."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)
