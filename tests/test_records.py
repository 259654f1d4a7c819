import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noctiluca.functions import text
from noctiluca.operators import explore, stats
from noctiluca.operators.records import clean_papers, dense_ids, fetch_counters, finalize, keep_first, require, with_defaults, year_between

PAPERS = "paper_id bigint, title string, abstract string, category string, primary_category string, authors string, published string, updated string, url string, extra string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, t, a, c, c, "", d, "", u, "e") for i, (t, a, c, d, u) in enumerate(rows, 1)], PAPERS)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_whitespace(spark):
    assert one(spark, "\xa0 a\tb c\n\x1f d \x85", text.collapse) == "a b c d"
    assert one(spark, "  x y　", text.strip) == "x y"
    assert one(spark, None, text.collapse) == ""


def test_whitespace_class_is_pythons(spark):
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c,) for c in every], "v string").where(F.col("v").rlike(f"^{text.WS}$")).collect()
    assert {r["v"] for r in got} == {c for c in every if c.isspace()}


@pytest.mark.parametrize(("value", "want"), [("NA", "unknown"), ("null", "unknown"), ("", "unknown"), (None, "unknown"), ("  ", ""), (" astro-ph.GA ", "astro-ph.GA")])
def test_missing_tokens(spark, value, want):
    assert one(spark, value, lambda c: text.fill(c, "unknown")) == want


def test_clean(spark):
    df = papers(spark, (" A ", "b", "NA", "", ""), (None, "b", "x", "", ""), ("t", " ", "x", "", ""), ("t", "a", "  ", "", ""))
    rows = clean_papers(df).collect()
    assert [(r["paper_id"], r["title"], r["category"], r["combined_text"], r["extra"]) for r in rows] == [(1, "A", "unknown", "A. b", "e"), (4, "t", "", "t. a", "e")]
    assert clean_papers(clean_papers(df)).count() == 2


def test_required_and_defaults(spark):
    with pytest.raises(ValueError, match="Missing required column: abstract"):
        require(spark.createDataFrame([("t", "c")], "title string, category string"))
    df = with_defaults(spark.createDataFrame([("b", "a", "c"), ("a", "a", "c")], "title string, abstract string, category string"), "title")
    assert {(r["title"], r["paper_id"], r["primary_category"], r["url"]) for r in df.collect()} == {("a", 1, "c", ""), ("b", 2, "c", "")}


@pytest.mark.parametrize(("value", "year"), [("2020-01-01T00:00:00Z", 2020), ("2021-05-01", 2021), ("bad", None), ("", None), (None, None), ("2019-12-31T23:30:00-05:00", 2020)])
def test_years(spark, value, year):
    assert one(spark, value, text.published_year) == year


def test_year_between(spark):
    df = papers(spark, ("a", "a", "c", "2020-01-01", ""), ("a", "a", "c", "2021-01-01", ""), ("a", "a", "c", "x", ""))
    assert year_between(df, 2021, 2020).count() == 2
    assert year_between(df, None, 2020).count() == 1
    assert year_between(df, None, None).count() == 3


def test_dedup_modes(spark):
    df = papers(spark, ("a", "a", "astro-ph.GA", "d", ""), ("b", "a", "astro-ph.GA", "d", ""), ("c", "a", "astro-ph.GA", "d", "u"), ("d", "a", "astro-ph.GA", "d", " u "), ("e", "a", "hep-th", "d", "v"))
    assert [r["title"] for r in finalize(df).orderBy("paper_id").collect()] == ["a", "b", "c"]
    assert [r["title"] for r in finalize(df, by_url_only=True).orderBy("paper_id").collect()] == ["a", "c", "d"]
    assert [(r["paper_id"], r["title"]) for r in finalize(df, limit=2).orderBy("paper_id").collect()] == [(1, "a"), (2, "b")]
    counters = fetch_counters(df).first()
    assert (counters["raw"], counters["kept"], counters["other_category"], counters["duplicates"]) == (5, 3, 1, 1)
    assert finalize(df.limit(0)).count() == 0


def test_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, o int")
    assert {(r["k"], r["o"]) for r in keep_first(df, ["k"], ["o"]).collect()} == {(None, 1), ("a", 3)}


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    rows = dense_ids(df, "k", "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in rows) and len(rows) == 1000


def test_primary_category_and_key(spark):
    df = spark.createDataFrame([("", ["hep-th", "astro-ph.GA"]), ("", ["cs.LG"]), ("", []), ("astro-ph.SR", ["x"])], "p string, c array<string>")
    assert [r["r"] for r in df.select(text.primary_category(F.col("p"), F.col("c")).alias("r")).collect()] == ["astro-ph.GA", "cs.LG", "unknown", "astro-ph.SR"]
    assert one(spark, "a, b,, c ", text.split_list) == ["a", "b", "c"]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 7, "c": 2}, {"a": 5}, {"a": 9, "b": 1}, {"a": 401, "b": 399}])
def test_split(spark, sizes):
    rows = [(i, k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))]
    got = stats.stratified_split(spark.createDataFrame(rows, "paper_id bigint, category string")).collect()
    total = len(rows)
    assert len(got) == total and sum(r["is_test"] for r in got) == math.ceil(0.25 * total)
    if len(sizes) > 1 and min(sizes.values()) >= 2:
        for k, n in sizes.items():
            assert abs(sum(r["is_test"] for r in got if r["category"] == k) - math.ceil(0.25 * total) * n / total) < 1


def test_split_of_nothing(spark):
    assert stats.stratified_split(spark.createDataFrame([], "paper_id bigint, category string")).count() == 0


@pytest.mark.parametrize(("x", "want"), [(62.25, 62.3), (62.45, 62.5), (0.05, 0.1), (0.15, 0.2)])
def test_rounding(spark, x, want):
    assert spark.range(1).select(F.round(F.lit(x), 1).alias("r")).first()["r"] == want


def test_search(spark):
    df = clean_papers(papers(spark, ("Dark Halo", "of dust", "astro-ph.GA", "", ""), ("Halo", "of gas", "astro-ph.HE", "", "")))
    assert explore.search(df, "").count() == 2
    assert explore.search(df, "  DUST halo ").count() == 1
    assert explore.search(df, "halo", ["astro-ph.HE"]).first()["paper_id"] == 2
    assert explore.result_summary(df, "halo gas").first()["matched"] == 1
    assert explore.selection(df, 2, "dust").first()["selected"] == 1
    assert explore.selection(df, 2, "halo").first()["selected"] == 2
    assert explore.selection(df, 2, "nothing").first()["selected"] is None


def test_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id bigint, x double, y double")
    assert {(r["id"], r["x"], r["y"]) for r in explore.min_max_scale(df).collect()} == {(1, 0.0, 0.0), (2, 1.0, 0.0)}


def test_nearest_point_against_brute_force(spark):
    import random

    rng = random.Random(1)
    points = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(400)]
    probes = [(i, rng.uniform(-220, 220), rng.uniform(-220, 220)) for i in range(60)]
    got = {r["probe_id"]: r["point_id"] for r in explore.nearest_points(spark.createDataFrame(probes, "probe_id bigint, mx double, my double"), spark.createDataFrame(points, "id bigint, px double, py double")).collect()}
    want = {}
    for i, x, y in probes:
        d, j = min((math.hypot(x - a, y - b), j) for j, a, b in points)
        if d < 16:
            want[i] = j
    assert got == want
    with pytest.raises(ValueError):
        explore.nearest_points(None, None, radius=30)


def test_distributions(spark):
    df = papers(spark, ("a", "a", "x", "2020-01-01", ""), ("a", "a", "y", "2020-05-01", ""), ("a", "a", "x", "bad", ""))
    assert [(r["category"], r["n"]) for r in stats.label_distribution(df).collect()] == [("x", 2), ("y", 1)]
    assert [(r["year"], r["n"]) for r in stats.year_distribution(df).collect()] == [(2020, 2)]
    assert stats.site_stats(df, "s").first()["umap_neighbors"] == 2
    assert not stats.can_stratify(df).first()["eligible"]
    assert Counter(r["color"] for r in explore.colours(df).collect()) == {"#94a3b8": 3}
