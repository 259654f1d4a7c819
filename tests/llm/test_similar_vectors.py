import numpy as np
import pytest

from noctiluca.llm.similar_vectors import Cells, collision_threshold, fit_codebook, neighbours_in_cell, search_similar, similar_pairs, similar_vectors

DIM = 16
SCHEMA = "paper_id bigint, embedding array<float>, sim double, cell int, id string"


def clusters(rng, groups=30, each=6, spread=0.12):
    centre = rng.standard_normal((groups, DIM))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.repeat(centre, each, axis=0) + spread / np.sqrt(DIM) * rng.standard_normal((groups * each, DIM))
    return (x * rng.uniform(0.5, 3, (len(x), 1))).astype(np.float32)


def brute(ids, x, k, least):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        sim = x @ x[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i] and sim[j] >= least), key=lambda j: (-round(sim[j], 12), ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 3, "x") for i, v in rows], SCHEMA)


def test_against_brute_force(spark):
    x = clusters(np.random.default_rng(1))
    ids = [int(i) for i in np.random.default_rng(2).permutation(1000)[: len(x)]]
    rows = [(i, [float(a) for a in v]) for i, v in zip(ids, x, strict=True)]
    bad = [(5001, None), (5002, [0.0] * DIM), (5003, [1.0] * 4), (5004, [float("nan")] * DIM), (5005, [1.0] * (DIM - 1) + [None]), (None, rows[0][1])]
    got = {}
    for r in similar_vectors(frame(spark, rows + bad + rows[:20]), dim=DIM, k=3, cell_rows=40).collect():
        got.setdefault(r["src_id"], {})[r["rank"]] = r["dst_id"]
    want = {k: v for k, v in brute(ids, x, 3, 0.8).items() if v}
    found = sum(len(set(got.get(i, {}).values()) & set(v)) for i, v in want.items())
    assert found >= 0.98 * sum(map(len, want.values()))
    assert set(got) <= set(ids)


def test_equal_vectors_keep_the_lowest_ids(spark):
    v = [1.0] * DIM
    rows = [(i, v) for i in range(40, 0, -1)] + [(i, v) for i in range(1, 5)]
    got = similar_pairs(similar_vectors(frame(spark, rows), dim=DIM, k=3))
    pairs = {(r["paper_id_a"], r["paper_id_b"]) for r in got.collect()}
    assert pairs == {(min(a, b), max(a, b)) for a in range(1, 41) for b in [x for x in (1, 2, 3, 4) if x != a][:3]}


def test_empty(spark):
    assert similar_vectors(frame(spark, []), dim=DIM).count() == 0
    assert similar_vectors(frame(spark, [(1, [1.0] * DIM)]), dim=DIM).count() == 0
    assert search_similar(frame(spark, []), frame(spark, []), dim=DIM).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, DIM)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = frame(spark, rows)
    found = {(r["src_id"], r["dst_id"]) for r in search_similar(df.where("paper_id % 50 = 0"), df, dim=DIM, k=8).collect()}
    want = {(i, j) for i, v in brute(list(range(1500)), x, 8, -1).items() if i % 50 == 0 for j in v}
    assert len(found & want) >= 0.9 * len(want)
    assert len(found) <= len(want)


def test_search_with_a_hot_id(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, DIM)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    hot = brute(list(range(600)), x, 1, -1)[0][0]
    df = frame(spark, rows + [rows[hot]] * 300)
    found = {(r["src_id"], r["dst_id"]) for r in search_similar(df.where("paper_id % 50 = 0"), df, dim=DIM, k=8).collect()}
    want = {(i, j) for i, v in brute(list(range(600)), x, 8, -1).items() if i % 50 == 0 for j in v}
    assert len(found & want) >= 0.9 * len(want)
    assert sum(i == 0 for i, _ in found) == 8


def test_narrow_windows_agree_with_wide_ones():
    rng = np.random.default_rng(4)
    x = clusters(rng, 20, 10).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    lines = rng.standard_normal((64, DIM)).astype(np.float32)
    all_rows, least = np.ones(len(x), bool), np.full(len(x), 0.8)
    few = neighbours_in_cell(ids, x, all_rows, all_rows, lines, 4, least)
    one = neighbours_in_cell(ids, x, all_rows, all_rows, lines, 4, least, steps=1)
    assert set(zip(*few[:2], strict=True)) == set(zip(*one[:2], strict=True))
    assert len(few[0])


@pytest.mark.parametrize("recall", [0.9, 0.97])
def test_threshold_follows_from_the_collision_curve(recall):
    from math import comb
    from statistics import NormalDist

    p, low = 2 * NormalDist().cdf(1.0) - 1, collision_threshold(48, 1.0, recall)
    assert sum(comb(48, i) * p**i * (1 - p) ** (48 - i) for i in range(low, 49)) >= recall - 0.02


def test_codebook():
    centre = fit_codebook(clusters(np.random.default_rng(5)).astype(np.float64), 7)
    assert centre.shape == (7, DIM)


def test_cells_of_two_levels():
    x = clusters(np.random.default_rng(7), 60, 20).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = Cells(x, 36, flat=8)
    assert cells.count == 36
    at = cells.nearest(x, 3)
    whole = (cells.first[:, None, :] + cells.second[None, :, :]).reshape(-1, DIM)
    best = np.argmin(((x[:, None, :] - whole[None, :, :]) ** 2).sum(axis=2), axis=1)
    assert (at[:, 0] == best).mean() > 0.95
    assert np.array_equal(np.sort(at, axis=1), np.sort([np.unique(r) for r in at], axis=1))


def test_a_crowded_cell_is_cut_into_chunks(spark):
    x = clusters(np.random.default_rng(8), 4, 60, 0.05)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    found = {(r["src_id"], r["dst_id"]) for r in similar_vectors(frame(spark, rows), dim=DIM, k=3, cell_rows=10, sample_rows=4, probes=4).collect()}
    want = {(i, j) for i, v in brute(list(range(len(x))), x, 3, 0.8).items() for j in v}
    assert len(found & want) >= 0.95 * len(want)


def test_an_id_with_several_vectors(spark):
    rng = np.random.default_rng(9)
    a, b = ([float(v) for v in rng.standard_normal(DIM)] for _ in range(2))
    got = {(r["src_id"], r["dst_id"]): r["sim"] for r in similar_vectors(frame(spark, [(1, a), (1, b), (2, a), (3, b), (1, a)]), dim=DIM, k=3).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3), (3, 1)}
    assert all(abs(v - 1) < 1e-6 for v in got.values())


def test_two_rows_meet_in_any_cell_that_is_near_both(spark):
    # many cells for few rows, fitted on other rows than those of the pairs, as in a very large table
    rng = np.random.default_rng(12)
    alone = rng.standard_normal((4000, DIM))
    one = rng.standard_normal((300, DIM))
    other = one + 0.55 * np.linalg.norm(one, axis=1, keepdims=True) / np.sqrt(DIM) * rng.standard_normal((300, DIM))
    x = np.concatenate([alone, one, other])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = Cells(alone, 1500, flat=4096, level=True)
    assert cells.second is None and cells.count == 1500
    assert np.allclose(np.linalg.norm(cells.first, axis=1), 1, atol=1e-5)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    found = {(r["src_id"], r["dst_id"]) for r in similar_vectors(frame(spark, rows), dim=DIM, cell_rows=3, sample_rows=1500, k=8).collect()}
    want = {(i, j) for i, v in brute(list(range(len(x))), x, 8, 0.8).items() for j in v}
    assert len(found & want) >= 0.85 * len(want)
    assert found <= {(i, j) for i, v in brute(list(range(len(x))), x, 64, 0.8).items() for j in v}


def test_each_two_rows_are_counted_once_and_found_both_ways():
    rng = np.random.default_rng(13)
    x = clusters(rng, 50, 10).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, lines = rng.permutation(len(x)), rng.standard_normal((64, DIM)).astype(np.float32)
    all_rows, least = np.ones(len(x), bool), np.full(len(x), 0.8)
    src, dst, _ = neighbours_in_cell(ids, x, all_rows, all_rows, lines, 4, least, steps=1)
    want = {(i, j) for i, v in brute(ids.tolist(), x, 4, 0.8).items() for j in v}
    assert len(set(zip(src.tolist(), dst.tolist(), strict=True)) & want) >= 0.97 * len(want)
