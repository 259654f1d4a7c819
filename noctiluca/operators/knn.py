"""Exact nearest neighbours of a query set, recommendations and semantic search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.functions import vectors
from noctiluca.session import cut

#: Similarities that agree to so many decimals are ties, which go to the lower id.
TIE_DECIMALS = 8


def vector_table(df: DataFrame, id_col: str = "paper_id", vec_col: str = "embedding", dim: int = 128) -> DataFrame:
    """(id, vec) of the rows with a usable vector."""
    return df.where(F.col(id_col).isNotNull() & vectors.usable(F.col(vec_col), dim)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, dim: int = 128, block: int = 4096) -> DataFrame:
    """(src_id, dst_id, sim, rank): the k most similar corpus vectors of every query vector, itself excluded; exact, in
    double precision, ties by lower id. Both sides are (id, vec); repeated rows count once.

    The queries are a stated set, taken in blocks of about half ``block``: one at a time comes to the driver and is
    broadcast (block x dim doubles) to one pass over the corpus, every task keeps k per query and batch, and the winners are merged by rank. The corpus isn't shuffled.
    """
    spark = corpus.sparkSession
    asked = queries.select("id", "vec").dropDuplicates(["id"])
    count = asked.count()
    slices = max(1, -(-2 * count // block)) if count > block else 1
    if slices > 1:
        asked = cut(asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")))
    passes = []
    for i in range(slices if count else 0):
        held = (asked.where(F.col("slice") == i) if slices > 1 else asked).select("id", "vec").toArrow()
        if not held.num_rows:
            continue
        shared = spark.sparkContext.broadcast((held.column("id").to_numpy(), _units(held.column("vec").combine_chunks(), dim)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, first = np.unique(batch.column("id").to_numpy(zero_copy_only=False), return_index=True)
                x = _units(batch.column("vec"), dim)[first]
                for at in range(0, len(q), 512):
                    sim = np.round(q[at : at + 512] @ x.T, TIE_DECIMALS)
                    sim[q_ids[at : at + 512, None] == ids[None, :]] = -np.inf
                    m = min(k, sim.shape[1])
                    edge = np.partition(sim, sim.shape[1] - m, axis=1)[:, sim.shape[1] - m]
                    row, col = np.nonzero((sim >= edge[:, None]) & (sim > -np.inf))
                    order = np.lexsort((ids[col], -sim[row, col], row))
                    row, col = row[order], col[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[place < k], col[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + row]), pa.array(ids[col]), pa.array(sim[row, col])], names=["src_id", "dst_id", "sim"])

        passes.append(corpus.select("id", "vec").mapInArrow(search, "src_id bigint, dst_id bigint, sim double"))
    if not passes:
        return spark.createDataFrame([], "src_id bigint, dst_id bigint, sim double, rank int")
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    found = found.groupBy("src_id", "dst_id").agg(F.max("sim").alias("sim"))
    by = Window.partitionBy("src_id").orderBy(F.desc("sim"), "dst_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest_sql(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same by a nested-loop join of array expressions; the cross-check of ``nearest`` for small tables."""
    a = queries.dropDuplicates(["id"]).select(F.col("id").alias("src_id"), vectors.unit(F.col("vec")).alias("a"))
    b = corpus.dropDuplicates(["id"]).select(F.col("id").alias("dst_id"), vectors.unit(F.col("vec")).alias("b"))
    scored = F.broadcast(a).join(b, F.col("src_id") != F.col("dst_id")).select("src_id", "dst_id", F.round(vectors.dot(F.col("a"), F.col("b")), TIE_DECIMALS).alias("sim"))
    by = Window.partitionBy("src_id").orderBy(F.desc("sim"), "dst_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def recommendations(found: DataFrame, papers: DataFrame) -> DataFrame:
    """(src_id, rank, dst_id, title, category, url, authors, published, match_pct): neighbours with what the site shows of
    them. Neighbours at similarity -1 or below are left out, those without a record keep nulls."""
    shown = papers.select(F.col("paper_id").alias("dst_id"), "title", "category", "url", "authors", "published")
    return found.where("sim > -1").join(shown, "dst_id", "left").select("src_id", "rank", "dst_id", "title", "category", "url", "authors", "published", vectors.match_percent(F.col("sim")).alias("match_pct"))


def nested_recommendations(recs: DataFrame) -> DataFrame:
    """(src_id, recommendations): one array per source, in rank order."""
    item = F.struct("rank", F.col("dst_id").alias("id"), "title", "category", "match_pct")
    return recs.groupBy("src_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["category"].alias("category"), x["match_pct"].alias("match_pct"))).alias("recommendations"))


def top_similar(query: list[float], corpus: DataFrame, k: int) -> DataFrame:
    """(id, score): the k ids most similar to a query vector. Every task keeps the k best ids of its rows, repeated ones
    once, so k rows a task are all that is moved."""
    q = np.array(query, np.float64)
    q = q / np.sqrt(q @ q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            if batch.num_rows:
                ids, score = np.r_[ids, batch.column("id").to_numpy()], np.r_[score, np.round(_units(batch.column("vec"), len(q)) @ q, TIE_DECIMALS)]
                order = np.lexsort((-score, ids))
                ids, score = ids[order], score[order]
                first = np.r_[True, ids[1:] != ids[:-1]]
                ids, score = ids[first], score[first]
                top = np.lexsort((ids, -score))[:k]
                ids, score = ids[top], score[top]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score)], names=["id", "score"])

    found = corpus.select("id", "vec").mapInArrow(best, "id bigint, score double")
    return found.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def semantic_search(query: list[float], corpus: DataFrame, papers: DataFrame, k: int = 5) -> DataFrame:
    """The k papers most similar to a query vector, with their records. The k rows found are broadcast to the records, so
    neither the corpus nor the records are shuffled."""
    best = F.broadcast(top_similar(query, corpus, k))
    return papers.join(best, best["id"] == papers["paper_id"]).select("id", "title", "category", "abstract", "combined_text", "authors", "published", "url", "score").orderBy(F.desc("score"), "id")


def text_search(query: str, embed: Callable[..., DataFrame], corpus: DataFrame, papers: DataFrame, k: int = 5) -> DataFrame:
    """``semantic_search`` of a text: ``embed`` is the embedder (df, id_col, text_col) -> (id, vec) that made the corpus
    vectors. A text without a vector (no known words) finds nothing."""
    asked = embed(papers.sparkSession.createDataFrame([(0, query)], "id bigint, text string"), "id", "text").first()
    if asked is None:
        return semantic_search([1.0] * 2, corpus.limit(0), papers, k)
    return semantic_search(list(asked["vec"]), corpus, papers, k)
