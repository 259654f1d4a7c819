"""The registered queries of this package over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca.llm.answers import defective, flag_pairs
from noctiluca.llm.leakage import leaked, leaked_unchanged
from noctiluca.llm.markup import clean_markup, kept_structure, residue
from noctiluca.llm.mixture import mix
from noctiluca.llm.names import link_names, variant_pairs
from noctiluca.llm.near_duplicates import grouped_pairs, near_duplicates
from noctiluca.llm.repetition import repetition, repetitive
from noctiluca.llm.similar_vectors import search_similar, similar_pairs, similar_vectors
from noctiluca.llm.split_overlap import overlap_report, overlapping_pairs, overlapping_records, split_overlap


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(similar_vectors(_read(spark, folder, "paper_vectors")))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "paper_vectors")
    return search_similar(vectors.where("paper_id % 50 = 0"), vectors)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(clean_markup(_read(spark, folder, "papers")))


def p2_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(_read(spark, folder, "papers"))


def p2_structure(spark: SparkSession, folder: str) -> DataFrame:
    return kept_structure(clean_markup(_read(spark, folder, "papers")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return defective(flag_pairs(_read(spark, folder, "questions")))


def p3_all_defects(spark: SparkSession, folder: str) -> DataFrame:
    return flag_pairs(_read(spark, folder, "questions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlapping_pairs(*split_overlap(_read(spark, folder, "papers"), _read(spark, folder, "paper_splits")))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return overlapping_records(*split_overlap(_read(spark, folder, "papers"), _read(spark, folder, "paper_splits")))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    papers, splits = _read(spark, folder, "papers"), _read(spark, folder, "paper_splits")
    return overlap_report(overlapping_records(*split_overlap(papers, splits)), splits, papers)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_pairs(near_duplicates(_read(spark, folder, "papers")))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "papers"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(link_names(_read(spark, folder, "papers")))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(_read(spark, folder, "papers"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_unchanged(leaked(_read(spark, folder, "documents"), _read(spark, folder, "eval_items")))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[1]


def p8_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture in which a document's chance of the further copy grows with its length, so that headers and stubs are rarer
    than in ``p8_mixture``: inclusion probabilities differ from document to document."""
    documents = _read(spark, folder, "documents").withColumn("weight", F.sqrt(F.length("text").cast("double")))
    return mix(documents, _read(spark, folder, "mix_targets"), weight_col="weight")[0]


def p8_weighted_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").withColumn("weight", F.sqrt(F.length("text").cast("double")))
    return mix(documents, _read(spark, folder, "mix_targets"), weight_col="weight")[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetitive(repetition(_read(spark, folder, "documents")))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_clean_text, p2_structure, p3_found, p3_all_defects, p4_found, p4_records, p4_report, p5_found, p5_groups, p6_found, p6_entities, p7_found, p7_leaks, p8_mixture, p8_shares, p8_weighted, p8_weighted_shares, p9_found, p9_shares)}
ORACLES: dict[str, str] = {}
