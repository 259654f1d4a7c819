"""Cutting texts into chunks, and what is known about a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.functions import text

CITATION = r"\[\d+(?:\s*[,;-]\s*\d+)*\]|\([A-Z][^()]*\b\d{4}[a-z]?\)|\bet al\."
EQUATION = r"\$[^$]+\$|\\begin\{(?:equation|align)|\\frac|\\int|[A-Za-z0-9)\]]\s*=\s*[-+]?[A-Za-z0-9\\(]"
HEADING = r"^(?:#{1,6}\s+|\d+(?:\.\d+)*\.?\s+(?=[A-Z]))(.+)$"


def chunk_id(paper: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%03d", paper.cast("string"), index)


def word_list(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text.collapse(c), " "), lambda w: w != "")


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """(paper_id, chunk_id, chunk_index, chunk_text, word_count): runs of ``size`` words, each starting size - overlap
    after the last one; the last chunk ends with the text. Texts without words give no chunk. No shuffle."""
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than size")
    words = df.select(F.col(id_col).cast("string").alias("paper_id"), word_list(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int")))
    cut = words.select("paper_id", "w", F.explode(starts).alias("chunk_index")).withColumn("part", F.slice("w", F.col("chunk_index") * step + 1, size))
    return cut.select("paper_id", chunk_id(F.col("paper_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.array_join("part", " ").alias("chunk_text"), F.size("part").alias("word_count"))


def section_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """As ``fixed_chunks``, but within sections: a line that is a heading opens one, and chunks carry its title."""
    lines = df.select(F.col(id_col).cast("string").alias("paper_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")).alias("line", "body"))
    by = Window.partitionBy("paper_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.nullif(text.strip(F.regexp_extract(F.col("body"), HEADING, 1)), F.lit(""))
    marked = lines.withColumn("title", title).withColumn("section", F.count("title").over(by)).withColumn("section_title", F.last("title", ignorenulls=True).over(by))
    bodies = marked.where("title is null").groupBy("paper_id", "section", "section_title").agg(F.array_sort(F.collect_list(F.struct("line", "body"))).alias("lines"))
    joined = bodies.select("paper_id", "section", "section_title", F.array_join(F.transform("lines", lambda x: x["body"]), " ").alias("body"))
    keyed = joined.withColumn("_key", F.concat_ws(chr(1), "paper_id", F.col("section").cast("string"), F.coalesce("section_title", F.lit(""))))
    parts = fixed_chunks(keyed, "_key", "body", size, overlap)
    key = F.split("paper_id", chr(1))
    numbered = Window.partitionBy("paper").orderBy("section", "chunk_index")
    out = parts.select(key[0].alias("paper"), key[1].cast("bigint").alias("section"), F.nullif(key[2], F.lit("")).alias("section_title"), "chunk_index", "chunk_text", "word_count").withColumn("i", F.row_number().over(numbered) - 1)
    return out.select(F.col("paper").alias("paper_id"), chunk_id(F.col("paper"), F.col("i")).alias("chunk_id"), F.col("i").alias("chunk_index"), "section_title", "chunk_text", "word_count")


def chunk_flags(df: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """df with word_count, token_count (estimated from characters), and whether it cites or holds something like an equation."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("word_count", F.size(word_list(body))).withColumn("token_count", F.ceil(F.length(body) / 4).cast("int")).withColumn("contains_citation_marker", body.rlike(CITATION)).withColumn("contains_equation_like_text", body.rlike(EQUATION))


def topic_balanced(df: DataFrame, quota: int, topic_col: str = "topic_cluster", id_col: str = "paper_id") -> DataFrame:
    """At most ``quota`` papers of each topic, the lowest ids; ranks are cut before the shuffle."""
    papers = df.where(F.col(topic_col).isNotNull()).select(F.col(topic_col).alias("topic"), F.col(id_col).alias("paper_id")).distinct()
    by = Window.partitionBy("topic").orderBy("paper_id")
    return papers.withColumn("place", F.row_number().over(by)).where(F.col("place") <= quota)
