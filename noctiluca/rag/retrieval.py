"""Lexical (BM25) and dense retrieval of chunks, and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.functions import text
from noctiluca.operators.knn import nearest
from noctiluca.rag import scoring
from noctiluca.session import bounded_batches, cut


#: About so many terms of queries (query by query) come to the driver and go to the tasks at a time.
SLICE_TERMS = 1_000_000
#: Most ids of wanted items that are broadcast to the texts.
BROADCAST_IDS = 200_000


def least_texts(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item_id, text): the least text of each of the wanted items; up to ``BROADCAST_IDS`` of them, other items' texts are
    not shuffled."""
    ids = wanted.select("item_id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return items.join(ids, "item_id", "left_semi").groupBy("item_id").agg(F.min("text").alias("text"))


def term_numbers(items: DataFrame, asked: scoring.Asked) -> DataFrame:
    """(item_id, hash, len, held): of each row (item_id, text) its hash, its number of tokens, and its tokens that are asked for, as numbers."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, held = scoring.encoded(batch.column("w"), asked.terms, asked.code)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("hash"), pa.array(lengths), held], ["item_id", "hash", "len", "held"])

    rows = items.select("item_id", F.xxhash64("text").alias("hash"), text.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.mapInArrow(numbers, f"item_id {items.schema['item_id'].dataType.simpleString()}, hash bigint, len bigint, held binary")


def postings(items: DataFrame, asked: scoring.Asked) -> DataFrame:
    """(item_id, len, held): one row an item, of its least text. Texts are shuffled only of ids that come with different ones."""
    found = term_numbers(items, asked).groupBy("item_id").agg(F.min("hash").alias("hash"), F.max("hash").alias("other"), F.first("len").alias("len"), F.first("held").alias("held"))
    found = cut(found)
    several = found.where("hash <> other").select("item_id")
    if several.isEmpty():
        return found.select("item_id", "len", "held")
    least = cut(term_numbers(least_texts(items, several), asked).select("item_id", "len", "held"))
    return found.where("hash = other").select("item_id", "len", "held").unionByName(least)


def bm25(queries: DataFrame, items: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, decimals: int = 6) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items (item_id, text) of every query (query_id, text).

    idf is ln(1 + (n - df + 0.5) / (df + 0.5)); a query term counts once; scores that agree to ``decimals`` are ties, which
    go to the lower item_id. Of repeated items the least text counts. Items are shuffled once, as numbers of the terms that
    occur in a query. Scores are summed in arrays over a block of items for one query after the other, so pairs of a query and
    an item are never rows; k of them a query and block are. Queries are taken in slices of about ``SLICE_TERMS`` terms."""
    bounded_batches(items.sparkSession)
    items = items.where("item_id is not null").select("item_id", "text")
    asked = cut(queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(text.tokens(F.coalesce("text", F.lit(""))))).alias("term")).distinct())
    slices = max(1, -(-asked.count() // SLICE_TERMS))

    def found(j: int) -> DataFrame:
        return _bm25_slice(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == j), items, k, k1, b, decimals)

    out = found(0)
    for j in range(1, slices):
        out = out.unionByName(found(j))
    return cut(out)  # reranking and thresholds read it more than once


def _bm25_slice(pairs: DataFrame, items: DataFrame, k: int, k1: float, b: float, decimals: int) -> DataFrame:
    spark = items.sparkSession
    asked = scoring.asked_of(pairs.toArrow())
    held = postings(items, asked)
    terms = len(asked.terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By term the number of items; after the terms the number of all items and of their tokens."""
        counts = np.zeros(terms + 2, np.int64)
        for batch in batches:
            counts[:terms] += np.bincount(scoring.decoded(batch.column("held"), asked.code)[1], minlength=terms)
            counts[terms:] += batch.num_rows, batch.column("len").to_numpy().sum()
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["term", "n"])

    counts = np.zeros(terms + 2, np.int64)
    summed = held.select("len", "held").mapInArrow(tally, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["term"].to_numpy()] = summed["n"].to_numpy()
    n, df = int(counts[terms]), counts[:terms]
    avg_len = counts[terms + 1] / max(n, 1)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.full(len(asked.groups), -np.inf)
        for block in scoring.blocks(batches, scoring.BLOCK):
            rows, term, tf = scoring.decoded(block.column("held"), asked.code)
            length = block.column("len").to_numpy()[rows]
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
            group, at, score = scoring.best(rows, term, part, block.num_rows, asked.groups, floors, k, decimals)
            yield pa.RecordBatch.from_arrays([pa.array(group), block.column("item_id").take(pa.array(at)), pa.array(score)], ["group", "item_id", "score"])

    cores = spark.sparkContext.defaultParallelism
    few = held.coalesce(cores * max(1, -(-n // (scoring.BLOCK * cores))))  # whole blocks in as many tasks as keep the cores busy
    scored = few.mapInArrow(search, f"group int, item_id {items.schema['item_id'].dataType.simpleString()}, score double")
    by = Window.partitionBy("group").orderBy(F.desc("score"), "item_id")
    top = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    groups = pa.table({"query_id": asked.query_ids, "group": pa.array(asked.group_of)})
    of = spark.createDataFrame(groups, f"query_id {pairs.schema['query_id'].dataType.simpleString()}, group int")
    return top.join(F.broadcast(of), "group").select("query_id", "item_id", "score", "rank")


def dense(queries: DataFrame, items: DataFrame, k: int = 10, dim: int = 128) -> DataFrame:
    """(query_id, item_id, score, rank) by cosine of (id, vec) on either side; an id doesn't find itself."""
    return nearest(queries, items, k, dim).select(F.col("src_id").alias("query_id"), F.col("dst_id").alias("item_id"), F.col("sim").alias("score"), "rank")


def rerank(found: DataFrame, second: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """The k best of each query's results by (1 - weight) x first score, scaled to its best, + weight x second score
    (query_id, item_id, score); pairs without a second score count it as 0."""
    best = Window.partitionBy("query_id")
    mixed = found.withColumn("first", F.col("score") / F.nullif(F.max("score").over(best), F.lit(0.0))).join(second.select("query_id", "item_id", F.col("score").alias("second")), ["query_id", "item_id"], "left")
    scored = mixed.select("query_id", "item_id", F.round((1 - weight) * F.coalesce("first", F.lit(0.0)) + weight * F.coalesce("second", F.lit(0.0)), 6).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def keyword_coverage(pairs: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id, score): share of a question's keywords that stand in the item; the second scorer of ``rerank``.
    questions is (query_id, keywords), items (item_id, text)."""
    texts = least_texts(items, pairs)
    joined = pairs.select("query_id", "item_id").distinct().join(questions.select("query_id", "keywords"), "query_id").join(texts, "item_id")
    held = F.size(F.filter("keywords", lambda w: F.contains(F.lower("text"), F.lower(w))))
    return joined.select("query_id", "item_id", F.when(F.size("keywords") > 0, held / F.size("keywords")).otherwise(0.0).alias("score"))


def with_evidence(found: DataFrame, least: float) -> DataFrame:
    """Results of queries whose best score reaches a threshold; below it there is too little evidence to answer."""
    top = found.groupBy("query_id").agg(F.max("score").alias("_top")).where(F.col("_top") >= least).select("query_id")
    return found.join(top, "query_id", "left_semi")
