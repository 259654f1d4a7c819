"""Queries over chunks and questions. Searches take the questions whose number is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions.text import TOKEN, WS
from noctiluca.operators.evaluate import ranking_metrics, support_rates
from noctiluca.operators.knn import vector_table
from noctiluca.plans.records import OUTER
from noctiluca.plans.registry import query, read
from noctiluca.rag import benchmark, chunks, retrieval

NUMBER = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)"
ASKED = f"asked AS (SELECT id AS query_id, question, keywords, gold_chunks FROM questions WHERE {NUMBER} % 50 = 0)"
BM25 = f"""docs AS (SELECT item_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '{TOKEN}') AS w FROM (SELECT chunk_id AS item_id, min(chunk_text) AS text FROM paper_chunks WHERE chunk_id IS NOT NULL GROUP BY 1)),
size AS (SELECT count(*) AS n, avg(len(w)) AS al FROM docs),
terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(question, ''))), '{TOKEN}')) AS term FROM asked),
post AS (SELECT item_id, len, term, count(*) AS tf FROM (SELECT item_id, len(w) AS len, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
scored AS (SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM terms JOIN post USING (term) JOIN df USING (term), size GROUP BY 1, 2),
found AS (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10)"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "questions").where(F.regexp_extract("id", r"([0-9]+)$", 1).cast("bigint") % 50 == 0)


def lexical(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    items = read(spark, folder, "paper_chunks").select(F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    return retrieval.bm25(asked(spark, folder).select(F.col("id").alias("query_id"), F.col("question").alias("text")), items, k)


@query(f"WITH {ASKED}, {BM25} SELECT * FROM found")
def lexical_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return lexical(spark, folder)


@query(f"""WITH {ASKED}, {BM25}, gold AS (SELECT DISTINCT query_id, unnest(gold_chunks) AS item_id FROM asked), total AS (SELECT query_id, count(*) AS wanted FROM gold GROUP BY 1),
hits AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM found JOIN gold USING (query_id, item_id) GROUP BY 1)
SELECT query_id, round(coalesce(hits, 0) / wanted, 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM total LEFT JOIN hits USING (query_id)""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    gold = asked(spark, folder).select(F.col("id").alias("query_id"), F.explode("gold_chunks").alias("item_id"))
    return ranking_metrics(lexical(spark, folder), gold, 10)


@query(f"""WITH {ASKED}, {BM25}, best AS (SELECT query_id, max(score) AS top FROM found GROUP BY 1),
texts AS (SELECT chunk_id AS item_id, min(chunk_text) AS text FROM paper_chunks GROUP BY 1),
mixed AS (SELECT query_id, item_id, round(0.5 * coalesce(score / nullif(top, 0), 0) + 0.5 * CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) / len(keywords) ELSE 0 END, 6) AS score FROM found JOIN best USING (query_id) JOIN asked USING (query_id) LEFT JOIN texts USING (item_id))
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM mixed QUALIFY rank <= 5""")
def reranked(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical(spark, folder)
    questions = asked(spark, folder).select(F.col("id").alias("query_id"), "keywords")
    items = read(spark, folder, "paper_chunks").select(F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    return retrieval.rerank(found, retrieval.keyword_coverage(found, questions, items), 5)


@query(f"WITH {ASKED}, {BM25}, top AS (SELECT query_id FROM found GROUP BY 1 HAVING max(score) >= 12) SELECT query_id, item_id, rank FROM found WHERE query_id IN (SELECT query_id FROM top)")
def enough_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.with_evidence(lexical(spark, folder), 12.0).select("query_id", "item_id", "rank")


@query("""WITH u AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM u),
s AS (SELECT a.id AS query_id, b.id AS item_id, round(list_dot_product(a.u, b.u), 8) AS score FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 50 = 0)
SELECT query_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def dense_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_table(read(spark, folder, "embeddings"), "vec_id", "embedding", 64)
    return retrieval.dense(rows.where("id % 50 = 0"), rows, 10, 64).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
c AS (SELECT paper_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 60) / 45)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
SELECT paper_id, format('{{}}_chunk_{{:03d}}', paper_id, i) AS chunk_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(list_slice(w, i * 45 + 1, i * 45 + 60), ' ') AS chunk_text, CAST(len(list_slice(w, i * 45 + 1, i * 45 + 60)) AS INTEGER) AS word_count FROM c""")
def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.fixed_chunks(read(spark, folder, "documents"), "doc_id", "text", 60, 15)


@query(f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, unnest(range(1, len(b) + 1)) AS line, unnest(b) AS body FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS b FROM documents)),
t AS (SELECT *, nullif(regexp_replace(coalesce(nullif(regexp_extract(body, '^#{{1,6}}\\s+(.+)$', 1), ''), regexp_extract(body, '^\\d+(?:\\.\\d+)*\\.?\\s+([A-Z].*)$', 1)), '{OUTER}', '', 'g'), '') AS title FROM l),
m AS (SELECT paper_id, line, body, title, count(title) OVER (PARTITION BY paper_id ORDER BY line) AS section, last_value(title IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY line) AS section_title FROM t),
j AS (SELECT paper_id, section, section_title, string_agg(body, ' ' ORDER BY line) AS body FROM m WHERE title IS NULL GROUP BY 1, 2, 3),
w AS (SELECT paper_id, section, section_title, list_filter(string_split(trim(regexp_replace(body, '{WS}+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM j),
c AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(w) - 60) / 45)) AS BIGINT) + 1)) AS k FROM w WHERE len(w) > 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY section, k) - 1 AS INTEGER) AS i FROM c)
SELECT paper_id, format('{{}}_chunk_{{:03d}}', paper_id, i) AS chunk_id, i AS chunk_index, section_title, array_to_string(list_slice(w, k * 45 + 1, k * 45 + 60), ' ') AS chunk_text, CAST(len(list_slice(w, k * 45 + 1, k * 45 + 60)) AS INTEGER) AS word_count FROM n""")
def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.section_chunks(read(spark, folder, "documents"), "doc_id", "text", 60, 15)


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""WITH d AS (SELECT chunk_id, coalesce(chunk_text, '') AS b FROM paper_chunks)
SELECT chunk_id, CAST(len(list_filter(string_split(trim(regexp_replace(b, '{WS}+', ' ', 'g')), ' '), lambda x: x <> '')) AS INTEGER) AS word_count, CAST(ceil(length(b) / 4) AS INTEGER) AS token_count, regexp_matches(b, '{_sql(chunks.CITATION)}') AS contains_citation_marker, regexp_matches(b, '{_sql(chunks.EQUATION)}') AS contains_equation_like_text FROM d""")
def chunk_flags(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunk_flags(read(spark, folder, "paper_chunks").select("chunk_id", "chunk_text")).drop("chunk_text")


@query("SELECT topic, paper_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY paper_id) AS INTEGER) AS place FROM (SELECT DISTINCT topic_cluster AS topic, paper_id FROM paper_chunks WHERE topic_cluster IS NOT NULL) QUALIFY place <= 10")
def balanced_topics(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.topic_balanced(read(spark, folder, "paper_chunks"), 10)


_REQUIRED = [f"SELECT id, '{c}' AS field, 'missing' AS problem FROM questions WHERE {c} IS NULL OR regexp_replace({c}, '{OUTER}', '', 'g') = ''" for c in ("id", "question", "topic", "question_type", "difficulty", "reference_answer")]
_LISTS = [f"SELECT id, '{c}', 'missing' FROM questions WHERE {c} IS NULL" for c in ("gold_papers", "gold_chunks")]
_ENUMS = [f"SELECT id, '{c}', 'not allowed' FROM questions WHERE regexp_replace({c}, '{OUTER}', '', 'g') <> '' AND {c} NOT IN ({', '.join(repr(v) for v in allowed)})" for c, allowed in (("question_type", schema.QUESTION_TYPES), ("difficulty", schema.DIFFICULTIES))]


@query(" UNION ALL ".join([*_REQUIRED, *_LISTS, *_ENUMS]))
def benchmark_violations(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.violations(read(spark, folder, "questions"))


@query("SELECT topic, difficulty, count(*) AS questions, count(*) FILTER (coalesce(requires_multi_hop, false)) AS multi_hop, count(*) FILTER (coalesce(len(gold_chunks), 0) > 0) AS with_gold FROM questions GROUP BY 1, 2")
def benchmark_profile(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.profile(read(spark, folder, "questions"))


@query("""WITH c AS (SELECT q.id AS claim_id, q.chunk_id, contains(lower(t.text), lower(q.keywords[1])) AS supported FROM (SELECT id, keywords, unnest(gold_chunks) AS chunk_id FROM questions) q LEFT JOIN (SELECT chunk_id, min(chunk_text) AS text FROM paper_chunks GROUP BY 1) t USING (chunk_id)
UNION ALL SELECT id, NULL, NULL FROM questions WHERE coalesce(len(gold_chunks), 0) = 0),
per AS (SELECT claim_id, max(coalesce(supported, false)::INT) AS ok FROM c GROUP BY 1)
SELECT count(*) AS claims, round(avg(ok), 6) AS supported_claim_rate, (SELECT count(*) FROM c WHERE chunk_id IS NOT NULL) AS citations, (SELECT round(avg(coalesce(supported, false)::INT), 6) FROM c WHERE chunk_id IS NOT NULL) AS citation_precision FROM per""")
def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    questions = read(spark, folder, "questions")
    cited = questions.select(F.col("id").alias("claim_id"), "keywords", F.explode_outer("gold_chunks").alias("chunk_id"))
    items = read(spark, folder, "paper_chunks").select(F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    texts = retrieval.least_texts(items, cited.select(F.col("chunk_id").alias("item_id"))).withColumnRenamed("item_id", "chunk_id")
    cited = cited.join(texts, "chunk_id", "left")
    return support_rates(cited.select("claim_id", "chunk_id", F.contains(F.lower("text"), F.lower(F.get("keywords", 0))).alias("supported")))
