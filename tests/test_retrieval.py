import math
import time
from collections import Counter

import numpy as np
import pytest

from noctiluca.plans import catalog
from noctiluca.rag import retrieval, scoring


def by_hand(queries, items, k):
    """BM25 of every query and item, one after the other; items are (id, text) with one row an id."""
    docs = {i: Counter(w for w in (t or "").split() if len(w) > 1) for i, t in items}
    n, avg = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(w for d in docs.values() for w in d)
    rows = set()
    for q, t in queries:
        scores = {}
        for i, d in docs.items():
            if own := [w for w in sorted(set(t.split())) if w in d]:
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / avg)) for w in own), 6)
        rows |= {(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return rows


def rows_of(df):
    return {(r["query_id"], r["item_id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


def test_many_queries_by_many_items(spark):
    """Every query shares words with nearly every item: 90 million pairs, of which none may become a row of its own."""
    random = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(40)])
    items = [(f"i{i}", " ".join(words[random.integers(0, 40, 30)])) for i in range(30_000)]
    queries = [(f"q{i}", " ".join(words[random.choice(40, 8, replace=False)])) for i in range(3_000)]
    began = time.time()
    got = rows_of(retrieval.bm25(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), 10))
    assert time.time() - began < 45
    assert len(got) == 30_000
    assert {r for r in got if r[0] in ("q0", "q2999")} == by_hand([queries[0], queries[-1]], items, 10)


def test_bm25_ties_repeats_and_slices(spark, monkeypatch):
    texts = ["star dust", "star", "gas dust dust", "dust", "", "a b", None]
    items = [(i, texts[i % len(texts)]) for i in range(60)]
    queries = [(1, "star dust"), (2, "dust star star"), (3, "nothing"), (4, "gas"), (5, "a")]
    repeated = [*items, *items[:9], (3, "dust gas"), (7, None), (None, "dust")]  # of item 3 "dust" is less, of item 7 there is one text
    for terms in (1_000_000, 2):
        monkeypatch.setattr(retrieval, "SLICE_TERMS", terms, raising=False)
        df = retrieval.bm25(spark.createDataFrame([*queries, (1, "star"), (None, "dust")], "query_id bigint, text string"), spark.createDataFrame(repeated, "item_id bigint, text string"), 4)
        assert rows_of(df) == by_hand(queries, items, 4)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert retrieval.bm25(spark.createDataFrame(queries, "query_id bigint, text string"), empty).count() == 0
    assert retrieval.bm25(spark.createDataFrame([], "query_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_blocks_keep_the_best():
    """Floors, bounds from the first rows, and terms kept as whole arrays leave out nothing: as sorting all scores."""
    random = np.random.default_rng(5)
    n, blocks, k = 3 * scoring.FIRST, 3, 5
    groups = [np.array([0, 2]), np.array([1]), np.array([0, 1, 2, 3]), np.array([3])]
    floors, found, scores = np.full(4, -np.inf), [[] for _ in groups], np.zeros((4, n * blocks))
    for block in range(blocks):
        there = random.random((n, 4)) < [0.9, 0.02, 0.4, 0.0001]
        part = np.where(there, random.integers(1, 9, (n, 4)) / 8, 0)
        rows, terms = np.nonzero(there)
        for g, at, s in zip(*scoring.best(rows, terms, part[rows, terms], n, groups, floors, k, 6), strict=True):
            found[g].append((-s, block * n + at))
        for g, own in enumerate(groups):
            scores[g, block * n : block * n + n] = part[:, own].sum(1)
    for g in range(4):
        want = sorted((-s, i) for i, s in enumerate(scores[g]) if s)[:k]
        assert sorted(found[g])[:k] == [(round(s, 6), i) for s, i in want]
        assert len(found[g]) <= blocks * k


def test_texts_of_wanted_items_only(spark):
    """Up to a bound, texts of items that aren't wanted go into no shuffle, however the session joins."""
    items = spark.createDataFrame([("a", "dust"), ("a", "Cold dust"), ("b", "gas"), ("c", None)], "item_id string, text string")
    wanted = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "item_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = retrieval.least_texts(items, wanted)
        assert "SortMergeJoin" not in texts._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in texts.collect()} == {("a", "Cold dust"), ("c", None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder of 3,000 questions that are asked and 30,000 chunks, most of which share words with each of them, and its rows."""
    random = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(40)])
    items = [(f"i{i}", " ".join([*words[random.integers(0, 40, 30)], *[f"r{i}"] * (i < 3_000)])) for i in range(30_000)]
    queries = [(f"q{50 * i}", " ".join([*words[random.choice(40, 8, replace=False)], *[f"r{i}"] * (i % 2)])) for i in range(1, 3_001)]
    folder = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(items, "chunk_id string, chunk_text string").write.parquet(f"{folder}/paper_chunks.parquet")
    asked = [(q, t, t.split()[:3], [f"i{n}", f"i{n + 1}"]) for n, (q, t) in enumerate(queries)]
    spark.createDataFrame(asked, "id string, question string, keywords array<string>, gold_chunks array<string>").write.parquet(f"{folder}/questions.parquet")
    some = queries[40:46]
    return folder, {q: t for q, t in some}, dict(items), by_hand(some, items, 10)


def test_reranked_many(spark, many):
    folder, asked, texts, found = many
    began = time.time()
    got = catalog.QUERIES["reranked"](spark, folder).collect()
    assert time.time() - began < 45
    assert len(got) == 15_000
    for q, t in asked.items():
        own = [(i, s) for x, i, s, _ in found if x == q]
        top = max(s for _, s in own)
        mixed = sorted((-round(0.5 * s / top + 0.5 * sum(w in texts[i] for w in t.split()[:3]) / 3, 6), i) for i, s in own)[:5]
        assert sorted((-round(r["score"], 6), r["item_id"]) for r in got if r["query_id"] == q) == mixed


def test_enough_evidence_many(spark, many):
    folder, asked, _, found = many
    began = time.time()
    got = catalog.QUERIES["enough_evidence"](spark, folder).collect()
    assert time.time() - began < 45
    best = {q: max(s for x, _, s, _ in found if x == q) for q in asked}
    assert {s >= 12 for s in best.values()} == {True, False}
    assert {tuple(r) for r in got if r["query_id"] in asked} == {(q, i, r) for q, i, _, r in found if best[q] >= 12}


def test_retrieval_metrics_many(spark, many):
    folder, asked, _, found = many
    began = time.time()
    got = catalog.QUERIES["retrieval_metrics"](spark, folder).collect()
    assert time.time() - began < 45
    assert len(got) == 3_000
    ranks = {(q, i): r for q, i, _, r in found}
    for row in (r for r in got if r["query_id"] in asked):
        n = int(row["query_id"][1:]) // 50 - 1
        hits = sorted(ranks[row["query_id"], i] for i in (f"i{n}", f"i{n + 1}") if (row["query_id"], i) in ranks)
        ndcg = sum(1 / math.log2(r + 1) for r in hits) / (1 + 1 / math.log2(3))
        assert (row["recall"], row["reciprocal_rank"], row["ndcg"]) == pytest.approx((len(hits) / 2, 1 / hits[0] if hits else 0, ndcg), abs=1e-6)
    assert any(r["recall"] > 0 for r in got if r["query_id"] in asked)
