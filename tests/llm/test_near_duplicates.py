import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noctiluca.llm.components import components
from noctiluca.llm.near_duplicates import grouped_pairs, near_duplicates
from noctiluca.llm.sketches import Forest, lanes_within, near_in_block, planes_of, radius
from noctiluca.llm.split_overlap import in_map, overlap_report, overlapping_pairs, overlapping_records, split_overlap
from noctiluca.llm.words import mixed, words

SCHEMA = "paper_id bigint, title string, abstract string, category string, key string, side int, component int, id string, f0 string"


def collection(rng, bases=25, copies=4):
    vocabulary = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.randint(30, 60))
        for c in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 6) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            n += 1
            rows.append((n * 3, " ".join(w[:6]), " ".join(w[6:]), "c"))
    rows.append((9001, rows[0][1].upper(), "<b>" + rows[0][2] + "</b>", "c"))
    rows += [rows[2], (9002, None, "x y z", "c"), (9003, " ", "x y z", "c"), (9004, "a", "b", "c"), (None, rows[0][1], rows[0][2], "c"), (9005, "long " * 5, " ".join(rng.choices(vocabulary, k=40_000)), "c")]
    return rows


def sets(rows):
    out = {}
    for i, t, a, *_ in rows:
        if i is not None and t and a and t.strip() and a.strip():
            w = words(t + ". " + a.replace("<b>", "").replace("</b>", ""))
            s = frozenset(zip(w, w[1:], w[2:], strict=False))
            if s:
                out[i] = s
    return out


def likeness(a, b):
    return len(a & b) / len(a | b)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "i", "f") for r in rows], SCHEMA)


def test_groups_against_brute_force(spark):
    rows = collection(random.Random(5))
    s = sets(rows)
    ids = sorted(s)
    forest = Forest(len(ids))
    links = dict.fromkeys(ids, 0)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            if likeness(s[ids[x]], s[ids[y]]) >= 0.55:
                forest.join(x, y)
    want = {(ids[x], ids[y]) for x in range(len(ids)) for y in range(x + 1, len(ids)) if forest.root(x) == forest.root(y)}
    plain = near_duplicates(frame(spark, rows))
    assert plain.columns == ["id", "class_id", "group_id"]
    assert {(r["paper_id_a"], r["paper_id_b"]) for r in grouped_pairs(plain).collect()} == want
    found = near_duplicates(frame(spark, rows), links=True).cache()
    assert {(r["paper_id_a"], r["paper_id_b"]) for r in grouped_pairs(found).collect()} == want
    assert sorted(r["id"] for r in found.collect()) == ids
    for r in found.collect():
        others = {s[i] for i in ids if s[i] != s[r["id"]] and likeness(s[i], s[r["id"]]) >= 0.55}
        links[r["id"]] = len(others)
        assert r["links"] == len(others)


def test_chunks_of_a_large_component(spark, monkeypatch):
    import noctiluca.llm.near_duplicates as nd

    rows = collection(random.Random(6), bases=8, copies=9)
    pairs = lambda **k: {(r["paper_id_a"], r["paper_id_b"]) for r in grouped_pairs(near_duplicates(frame(spark, rows), **k)).collect()}
    whole = pairs()
    assert pairs(links=True) == whole
    for name, links in (("compare_components", True), ("verified_links", False)):
        plain = getattr(nd, name)
        monkeypatch.setattr(nd, name, lambda *a, plain=plain, **k: plain(*a, **k, chunk=2))
        assert pairs(links=links) == whole


def test_parts_of_a_large_component_are_joined(spark):
    """Edges that don't hold leave a component in parts; what links the parts is found, within one task and in chunks."""
    import struct

    import noctiluca.llm.near_duplicates as nd

    base = [frozenset(range(100 * g, 100 * g + 60)) for g in range(3)]
    sets = [b | {1000 + 10 * g + i} for g, b in enumerate(base) for i in range(5)] + [frozenset(list(base[0])[:55] + [5000, 5001])]
    rows = [(i, struct.pack(f"{len(x)}I", *sorted(x))) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "key bigint, set binary")
    edges = spark.createDataFrame([(i, i + 1) for i in range(len(sets) - 1)], "a bigint, b bigint")
    want = {i: (0 if i == 15 else i // 5 * 5) for i in range(16)}
    for chunk in (2, 100):
        links = nd.verified_links(edges, components(edges), table, 0.8, chunk)
        assert {r["node"]: r["component"] for r in components(links).collect()} == want


def test_empty(spark):
    none = frame(spark, []).limit(0)
    assert near_duplicates(none).count() == 0
    splits = spark.createDataFrame([], "paper_id bigint, split string, source string")
    members, overlaps = split_overlap(none, splits)
    assert members.count() == 0 and overlapping_pairs(members, overlaps).count() == 0


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    rows = collection(rng, bases=30)
    names = ["train", " Train ", "TEST", "validation", "dev", None, "train\u00a0"]
    split_rows = [(r[0], rng.choice(names), "s", 5, "x") for r in rows if r[0]]
    split_rows += split_rows[:10] + [(None, "train", "s", 5, "x"), (77777, "test", None, 5, "x")]
    splits = spark.createDataFrame(split_rows, "paper_id bigint, split string, source string, side int, id string")
    s = sets(rows)
    of = {}
    for i, name, *_ in split_rows:
        if name and name.strip().lower() in ("train", "test", "validation"):
            of.setdefault(i, set()).add("t" if name.strip().lower() == "train" else "e")
    want = {(min(a, b), max(a, b)) for a in s for b in s if a != b and "e" in of.get(a, ()) and "t" in of.get(b, ()) and likeness(s[a], s[b]) >= 0.85}
    members, overlaps = split_overlap(frame(spark, rows), splits)
    assert {(r["paper_id_a"], r["paper_id_b"]) for r in overlapping_pairs(members, overlaps).collect()} == want
    records = overlapping_records(members, overlaps)
    report = overlap_report(records, splits, frame(spark, rows)).collect()
    assert sum(r["records"] for r in report) >= len({i for i, n in of.items() if "e" in n and i in s})
    assert all(0 <= r["share"] <= 1 for r in report)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(0, 256), st.integers(0, 2**32 - 1))
def test_sliced_distance(n, limit, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
    a &= rng.integers(0, 2**63, (n, 4)).astype(np.uint64) if n % 2 else np.uint64(2**64 - 1)
    want = np.bitwise_count(a).sum(axis=1) <= limit
    assert (lanes_within(planes_of(a), limit, n) == want).all()


def test_crowded_runs_connect_the_same_rows():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    sketch = base[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 60, (300, 4)).astype(np.uint64))
    token, row, size = np.zeros(300, np.int64), np.arange(300), np.full(300, 50)
    groups = []
    for crowded in (10, 1000):
        forest = Forest(300)
        edges = list(near_in_block(token, row, size, sketch, 0.55, crowded=crowded))
        assert len(edges) < 300
        for a, b in edges:
            forest.join(a, b)
        groups.append([forest.root(i) for i in range(300)])
    assert [[g.index(x) for x in g] for g in groups][0] == [[g.index(x) for x in g] for g in groups][1]
    assert radius(0.55) < 100


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_a_short_record_inside_a_long_one(spark):
    short = " ".join(f"s{i}" for i in range(40))
    rows = [(1, "a b c", short), (2, "other words here", "a b c " + short + " " + " ".join(f"t{i}" for i in range(400))), (3, "x y z", "nothing of it at all")]
    df = spark.createDataFrame(rows, "paper_id bigint, title string, abstract string")
    splits = spark.createDataFrame([(1, "test"), (2, "train"), (3, "train")], "paper_id bigint, split string")
    members, overlaps = split_overlap(df, splits)
    row = overlaps.first()
    assert overlaps.count() == 1 and row["containment"] == 1.0 and row["likeness"] < 0.2
    assert [tuple(r)[:2] for r in overlapping_records(members, overlaps).collect()] == [(1, 1)]
    assert overlapping_pairs(members, overlaps).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(16, 20))
def test_a_bit_map_loses_nothing(values, bits):
    x = np.array(values, np.uint64)
    held = np.zeros(1 << (bits - 3), np.uint8)
    at = mixed(x) >> np.uint64(64 - bits)
    np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    assert in_map(held, x).all()
