import numpy as np
import pytest
from pyspark.sql import functions as F

from noctiluca.functions import vectors as v
from noctiluca.operators import classify, evaluate, knn
from noctiluca.operators.atlas import atlas_points, write_site
from noctiluca.operators.project import layout, pca_map, umap_map

DIM = 8
SCHEMA = "paper_id bigint, embedding array<float>, id string, vec string"


def table(spark, rows):
    return knn.vector_table(spark.createDataFrame([(i, x, "clash", "clash") for i, x in rows], SCHEMA), dim=DIM)


def random_rows(n, seed=0):
    return [(i, [float(a) for a in x]) for i, x in enumerate(np.random.default_rng(seed).standard_normal((n, DIM)).astype(np.float32))]


def test_two_implementations_agree(spark):
    rows = table(spark, random_rows(150))
    few = rows.where("id % 10 = 0")
    a = {(r["src_id"], r["rank"]): r["dst_id"] for r in knn.nearest(few, rows, 5, DIM, block=4).collect()}
    b = {(r["src_id"], r["rank"]): r["dst_id"] for r in knn.nearest_sql(few, rows, 5).collect()}
    assert a == b and len(a) == 75


@pytest.mark.parametrize(("n", "want"), [(1, 0), (2, 1), (5, 4), (8, 7), (9, 8)])
def test_few_neighbours(spark, n, want):
    rows = table(spark, random_rows(n, 3))
    assert knn.nearest(rows.where("id = 0"), rows, 8, DIM).count() == want


def test_ties_repeats_and_unusable(spark):
    x = [1.0] * DIM
    rows = table(spark, [(3, x), (1, x), (2, x), (2, x), (4, None), (5, [0.0] * DIM), (6, [1.0]), (None, x)])
    assert [(r["src_id"], r["dst_id"], r["rank"]) for r in knn.nearest(rows, rows, 2, DIM).orderBy("src_id", "rank").collect()] == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]
    assert knn.nearest(rows.limit(0), rows, 2, DIM).count() == 0


def test_search_and_recommendations(spark, tmp_path):
    rows = table(spark, random_rows(20))
    papers = spark.createDataFrame([(i, f"t{i}", "a", "astro-ph.GA" if i % 2 else "other", f"t{i}. a", "", "2020-01-01", "u") for i in range(15)], "paper_id bigint, title string, abstract string, category string, combined_text string, authors string, published string, url string")
    best = knn.semantic_search(rows.where("id = 7").first()["vec"], rows, papers, 3).collect()
    assert best[0]["id"] == 7 and abs(best[0]["score"] - 1) < 1e-6
    recs = knn.recommendations(knn.nearest(rows, rows, 8, DIM), papers)
    assert recs.count() == 160 and all(0 <= r["match_pct"] <= 100 for r in recs.collect())
    points = atlas_points(papers, pca_map(rows, DIM), knn.nested_recommendations(recs).where("src_id < 10"))
    got = points.orderBy("id").collect()
    assert len(got) == 15 and len(got[0]["recommendations"]) == 8 and got[12]["recommendations"] == []
    assert all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in got)
    page = write_site(points, str(tmp_path), "now")
    import json

    data = json.loads((tmp_path / "data.js").read_text().removeprefix("window.ATLAS = ").rstrip().removesuffix(";"))
    assert len(data["points"]) == 15 and data["stats"]["papers"] == 15 and data["colors"]["other"] == "#94a3b8" and page.exists()


def test_match_percent(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (1.0,), (0.245,)], "s double")
    assert [r["m"] for r in df.select(v.match_percent(F.col("s")).alias("m")).collect()] == [0.0, 50.0, 100.0, 62.3]


def test_pca_is_exact(spark):
    rows = random_rows(60, 5)
    x = np.array([r for _, r in rows], np.float64)
    x -= x.mean(axis=0)
    want = np.sort(np.linalg.svd(x, compute_uv=False) ** 2)[::-1][:2] / 60
    got = pca_map(table(spark, rows), DIM).toPandas()
    assert np.allclose([got["x"].var(ddof=0), got["y"].var(ddof=0)], want)


def test_layout_keeps_neighbours(spark):
    rng = np.random.default_rng(2)
    centre = np.eye(DIM)[:4]
    x = np.repeat(centre, 30, axis=0) + 0.05 * rng.standard_normal((120, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = layout(x, x[:, :2], 10)
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    assert (near // 30 == (np.arange(120) // 30)[:, None]).mean() > 0.95
    assert layout(x[:1], x[:1, :2]).shape == (1, 2)
    rows = table(spark, [(i, [float(a) for a in r]) for i, r in enumerate(x)])
    assert umap_map(rows, DIM, anchors=40).count() == 120
    assert umap_map(rows.limit(0), DIM).count() == 0


def test_large_maps_keep_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((100, DIM)).repeat(4, axis=0) + 0.3 * rng.standard_normal((400, DIM))
    y = umap_map(table(spark, [(i, [float(a) for a in r]) for i, r in enumerate(x)]), DIM, anchors=40).orderBy("id").toPandas()[["x", "y"]].to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    far, d = 1 - u @ u.T, np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(d, np.inf)
    want, got = np.argsort(far, axis=1)[:, :6], np.argsort(d, axis=1)[:, :6]
    assert (want[:, :, None] == got[:, None, :]).any(axis=2).mean() > 0.5


PAIRS = "truth string, predicted string"


def test_metrics_with_labels_on_one_side(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], PAIRS)
    report = {r["label"]: r for r in evaluate.class_report(df).collect()}
    assert report["b"]["f1"] == 0 and report["c"]["f1"] == 0 and report["a"]["f1"] == 0.5
    assert report["macro avg"]["f1"] == round(0.5 / 3, 6) and report["weighted avg"]["support"] == 3
    confusion = {(r["truth"], r["predicted"]): r["n"] for r in evaluate.confusion_counts(df).collect()}
    assert len(confusion) == 9 and confusion["a", "c"] == 1 and sum(confusion.values()) == 3
    assert evaluate.accuracy(df).first()["accuracy"] == 0.333333
    assert evaluate.accuracy(df.limit(0)).first()["accuracy"] is None


def test_ranking_metrics(spark):
    found = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)], "query_id string, item_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b"), ("s", "x")], "query_id string, item_id string")
    got = {r["query_id"]: r for r in evaluate.ranking_metrics(found, gold, 10).collect()}
    assert set(got) == {"q", "s"}
    assert got["q"]["recall"] == 0.5 and got["q"]["reciprocal_rank"] == 0.5
    assert got["q"]["ndcg"] == round((1 / np.log2(3)) / (1 + 1 / np.log2(3)), 6)
    assert got["s"]["recall"] == 0


def test_support_rates(spark):
    claims = spark.createDataFrame([("a", "c1", True), ("a", "c2", False), ("b", None, None)], "claim_id string, chunk_id string, supported boolean")
    got = evaluate.support_rates(claims).first()
    assert (got["claims"], got["supported_claim_rate"], got["citations"], got["citation_precision"]) == (2, 0.5, 2, 0.5)


def test_classifiers(spark, tmp_path):
    from noctiluca.sources.sinks import load_model, save_model
    from noctiluca.sources.synthetic import sample_papers

    df = sample_papers(spark, 20, perfect=True).where("category in ('cs.CL', 'cs.CV')").withColumn("combined_text", F.concat_ws(". ", "title", "abstract")).persist()
    model = classify.train_classifier(df, "v1", limit=500, rounds=5)
    out = classify.predict(model, df)
    assert out.where("predicted = category").count() == df.count()
    save_model(model, str(tmp_path / "m"), {"version": "v1"})
    assert classify.predict(load_model(str(tmp_path / "m")), df).where("predicted = category").count() == df.count()
    net = classify.train_classifier(df, "v2", hashed=64, hidden=8, rounds=20)
    assert classify.predict(net, df).where("predicted = category").count() >= 0.9 * df.count()
    with pytest.raises(ValueError):
        classify.train_classifier(df, "v3")


def test_embedder(spark):
    df = spark.createDataFrame([(1, "stars and dust"), (2, "stars and dust"), (3, "")], "paper_id bigint, combined_text string")
    rows = {r["id"]: r["vec"] for r in classify.hashing_embedder(df, dim=16).collect()}
    assert rows[1] == rows[2] and 3 not in rows and abs(sum(x * x for x in rows[1]) - 1) < 1e-9


def test_text_search_with_an_embedder(spark):
    """Any function from texts to vectors can stand behind a search from a text to results."""
    words = ["dust", "halo", "jet"]
    embed = classify.encode_with(lambda texts: np.array([[t.count(w) for w in words] for t in texts], float), 3)
    rows = [(1, "dust and dust"), (2, "a halo of dust"), (3, "jet jet"), (4, None)]
    papers = spark.createDataFrame([(i, f"t{i}", t or "", "c", t or "", "", "", "") for i, t in rows], "paper_id bigint, title string, abstract string, category string, combined_text string, authors string, published string, url string")
    corpus = embed(papers).where("vec[0] + vec[1] + vec[2] > 0")
    assert [r["id"] for r in knn.text_search("where is the dust", embed, corpus, papers, 2).collect()] == [1, 2]
    assert [r["id"] for r in knn.text_search("jet", embed, corpus, papers, 1).collect()] == [3]


def test_term_vectors_and_losses(spark, tmp_path):
    rows = [(i, ("dust cloud dust" if i % 2 else "halo mass halo") + f" w{i % 3}", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "paper_id bigint, combined_text string, category string")
    vectors = classify.fit_term_vectors(df, "combined_text", 50)
    weights = {(r["id"], r["term"]): r["weight"] for r in classify.tfidf(df, "paper_id", "combined_text", 50).collect()}
    terms = vectors.getOrDefault(vectors.terms)
    for r in vectors.transform(df).collect():
        assert {terms[i]: round(v, 5) for i, v in zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)} == {t: round(w, 5) for (i, t), w in weights.items() if i == r["paper_id"]}
    model = classify.train_classifier(df, "v1")
    losses = classify.loss_history(model)
    assert {label for label, *_ in losses} == {"a", "b"} and losses[0][2] >= losses[-1][2]
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = classify.predict(PipelineModel.load(str(tmp_path / "m")), df)
    assert all(r["predicted"] == r["category"] for r in again.collect())
    with pytest.raises(NotImplementedError):
        classify.train_network(df, backbone="some-model")
