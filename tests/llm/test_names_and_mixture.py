import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noctiluca.llm.mixture import mix
from noctiluca.llm.names import bands_for, distance, fold, link_names, monge_elkan, normal_form, variant_pairs

GIVEN = frozenset("francisco lucia zacharias michael hannes alexander robert margaret".split())


def alike(a, b):
    return monge_elkan(normal_form(a, GIVEN)[:4], normal_form(b, GIVEN)[:4])


@pytest.mark.parametrize("variant", ["F Skimbivarovin", "F. Skimbivarovin", "Skimbivarovin F.", "Skimbivarovin Francisco", "FRANCISCO SKIMBIVAROVIN", "Dr. Francisco Skimbivarovin", "Fran. Skimbivarovin", "Paco Skimbivarovin", "Francsico Skimbivarovin", "Francisco Skimbivarvoin", "Francisco P. Skimbivarovin", "Skimbivarovin FP", "Francisco Skimbívarovin", "F.P. Skimbivarovin"])
def test_variants(variant):
    assert alike("Francisco Skimbivarovin", variant) >= 0.8


@pytest.mark.parametrize(("a", "b"), [("Francisco Skimbivarovin", "Lucia Skimbivarovin"), ("Francisco P. Skimbivarovin", "Francisco D. Skimbivarovin"), ("Francisco Svalmottal", "Francisco Svalmottalburg"[:-8] + "xgard"), ("L. Skimbivarovin", "Francisco Skimbivarovin")])
def test_others(a, b):
    assert alike(a, b) < 0.8


@pytest.mark.parametrize("variant", ["The Heron Fibre Programme Collaboration", "Heron Fibre Programme Collab.", "HERON FIBRE PROGRAMME COLLABORATION", "Collaboration Heron Fibre Programme", "HFPC Collaboration", "Heron Fibre Programme Team", "Hern Fibre Programme Collaboration"])
def test_collaborations(variant):
    assert alike("Heron Fibre Programme Collaboration", variant) >= 0.8
    assert alike("Marrow Echelle Survey Collaboration", variant) < 0.8


def plain(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(1, 3))
def test_distance(a, b, most):
    assert distance(a, b, most) == min(plain(a, b), most + 1)


def test_bands_follow_the_curve():
    b = bands_for(0.5, 3, 0.995)
    assert 1 - (1 - 0.5**3) ** b >= 0.995 > 1 - (1 - 0.5**3) ** (b - 1)


def test_link_names(spark):
    persons = ["Francisco Skimbivarovin", "F. Skimbivarovin", "Skimbivarovin Francisco", "Francisco Skimbivarvoin", "Lucia Skimbivarovin", "L Skimbivarovin", "Lucia Zentengardal", "Lucia Woveskar-Glarbel", "L. Woveskar-Glarbel", "Lucia Woveskar"]
    groups = ["Heron Fibre Programme Collaboration", "HFPC Collaboration", "Heron Fibre Programme Team"]
    rows = [(", ".join(persons[:5]) + " ,  et al.", 1, "x", "k")] * 3 + [(", ".join(persons), 1, "x", "k"), (", ".join(groups), 1, "x", "k"), (None, 1, "x", "k"), ("", 1, "x", "k"), (" , ,", 1, "x", "k"), ("a" * 50_000, 1, "x", "k"), ("., -, 7", 1, "x", "k")]
    df = spark.createDataFrame(rows, "authors string, times int, name string, key string")
    linked = link_names(df, sure=0)
    assert linked.select("name").distinct().count() == linked.count()
    of = {r["name"]: r["entity"] for r in linked.collect()}
    assert len({of[n] for n in persons[:4]}) == 1
    assert of["L Skimbivarovin"] == of["Lucia Skimbivarovin"] != of["Francisco Skimbivarovin"]
    assert len({of[n] for n in persons[7:]}) == 1
    assert len({of[n] for n in groups}) == 1
    pairs = [tuple(r) for r in variant_pairs(linked).collect()]
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))
    assert link_names(df.limit(0)).count() == 0


def test_misspelt_families_of_many_spellings_are_linked(spark):
    right = ["Tariq Snunörranmar", "T. Snunörranmar", "Susanna Snunörranmar", "S. Snunörranmar", "Victoria Snunörranmar", "V. Snunörranmar", "Dr. Victoria Snunörranmar"]
    typed = ["Tariq Snunoerranmar", "S. Snunoerranmar", "V. Snunoerranmar", "Oliver Snunoerranmar", "O. Snunoerranmar"]
    chain = ["Tariq Snunoerrnmar"]
    part = ["Lucia Woveskar", "L. Woveskar", "Lucia P. Woveskar", "Kenji Woveskar"]
    names = right + typed + chain + part + ["Lucia Woveskar-Glarbel"]
    df = spark.createDataFrame([(", ".join(names), 1, "x", "k")], "authors string, times int, name string, key string")
    of = {r["name"]: r["entity"] for r in link_names(df, sure=0).collect()}
    assert of["Tariq Snunoerranmar"] == of["Tariq Snunörranmar"] == of["Tariq Snunoerrnmar"]
    assert of["S. Snunoerranmar"] == of["Susanna Snunörranmar"] and of["V. Snunoerranmar"] == of["Victoria Snunörranmar"]
    assert of["Oliver Snunoerranmar"] == of["O. Snunoerranmar"]
    assert len({of[n] for n in ("Tariq Snunörranmar", "Susanna Snunörranmar", "Victoria Snunörranmar", "Oliver Snunoerranmar")}) == 4
    assert len({of[n] for n in [*part[:3], "Lucia Woveskar-Glarbel"]}) == 1 and of["Kenji Woveskar"] != of["Lucia Woveskar"]


def test_fold():
    assert fold("Łukasz STRAẞE Beckín\u200b") == "lukasz strasse beckin"


TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, sizes):
    rows = [(i, "star " * n, s, 1, 2) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows + [(9000, None, "a", 1, 2), (9001, " ", "a", 1, 2), (9002, "x", None, 1, 2), (None, "x", "a", 1, 2)], "doc_id bigint, text string, source string, tokens int, copies int")


def test_shares_and_repeats(spark):
    df = documents(spark, [("a", 10 + i % 7) for i in range(300)] + [("b", 8) for _ in range(40)] + [("c", 30)] * 20 + [("untargeted", 5)] * 10)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.15, 2), ("missing", 0.05, 3), (None, 0.1, 1)], TARGETS)
    chosen, report = mix(df, targets)
    rows = chosen.collect()
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    most = {"a": 1, "b": 5, "c": 2}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in rows)
    by = {r["source"]: r for r in report.collect()}
    used = sum(by[s]["used_tokens"] for s in "abc")
    for s in "abc":
        assert abs(by[s]["used_tokens"] - by[s]["wanted_tokens"]) <= 40
        assert by[s]["used_tokens"] == sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
        assert abs(by[s]["actual_share"] - by[s]["used_tokens"] / used) < 1e-9
    assert by["missing"]["used_tokens"] == 0 and by["untargeted"]["target_share"] is None
    again = {(r["doc_id"], r["copies"]) for r in mix(df.repartition(3), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_total_beyond_what_there_is(spark):
    df = documents(spark, [("a", 10)] * 10 + [("b", 10)] * 10)
    chosen, report = mix(df, spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS), total_tokens=10**6)
    assert {(r["source"], r["copies"]) for r in chosen.collect()} == {("a", 2), ("b", 1)}
    assert all(r["used_tokens"] < r["wanted_tokens"] for r in report.collect() if r["target_share"])


def test_weights_make_documents_more_likely(spark):
    rows = [(i, "star " * 10, "a", 3.0 if i % 2 else 1.0) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, w double")
    target = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    chosen = mix(df, target, total_tokens=3000, weight_col="w")[0].collect()
    heavy = sum(r["doc_id"] % 2 for r in chosen)
    assert 2.2 < heavy / max(1, len(chosen) - heavy) < 4.2


def test_empty(spark):
    df = documents(spark, [])
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    chosen, report = mix(df.limit(0), targets)
    assert chosen.count() == 0 and report.count() == 1
    assert mix(documents(spark, [("a", 3)]), targets.limit(0))[0].count() == 0


def test_a_family_of_very_many_forms():
    """Time stays near the number of forms, and those of one given name still meet."""
    import random

    from noctiluca.llm.names import stars

    rng = random.Random(4)
    given = sorted({"".join(rng.choice("abcdeilmnorst") for _ in range(7)) for _ in range(4000)})
    forms = [(("p|wang", g, "", False), 5, 1, True) for g in given] + [(("p|wang", g[:4], "", True), 1, 1, True) for g in given[:50]]
    out = stars(forms)
    assert all(sim > 0 for _, sim in out)
    # a beginning that is cut off belongs to the star of a name that begins so
    starts = {g[:4]: {out[i][0] for i, h in enumerate(given) if h.startswith(g[:4])} for g in given[:50]}
    assert all(out[len(given) + i][0] in starts[given[i][:4]] for i in range(50))


def test_misspelt_family_names_of_any_number_of_spellings(spark):
    first = ["Tariq", "Maria", "Wei", "Johanna", "Pedro"]
    rows = [(f"{g} Klokulard",) for g in first for _ in range(5)] + [(f"{g} Klokulrad",) for g in first]
    of = {r["name"]: r["entity"] for r in link_names(spark.createDataFrame(rows, "authors string"), sure=0).collect()}
    assert all(of[f"{g} Klokulard"] == of[f"{g} Klokulrad"] for g in first)
    assert len(set(of.values())) == 5
