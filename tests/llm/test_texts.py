"""Repetition and leakage."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noctiluca.llm.leakage import leaked, leaked_unchanged, myers_within
from noctiluca.llm.repetition import later_occurrences, repetition, repetitive
from noctiluca.llm.words import WordIds, words


def covered_by_hand(ws, n):
    seen, out = set(), set()
    for i in range(len(ws) - n + 1):
        key = tuple(ws[i : i + n])
        if key in seen:
            out |= set(range(i, i + n))
        seen.add(key)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=4), st.integers(1, 5))
def test_later_occurrences(docs, n):
    flat = [w for d in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = later_occurrences(WordIds().of(flat), owner, n)
    at = 0
    for d in docs:
        assert set(np.flatnonzero(got[at : at + len(d)])) == covered_by_hand(d, n)
        at += len(d)


def test_repetition_table(spark):
    schema = "doc_id bigint, text string, words int, repeated_words_5 string"
    sentence = "the bright stars of the old halo move slowly"
    rows = [(1, f"{sentence}. {sentence}. {sentence}.", 0, ""), (2, sentence, 0, ""), (3, None, None, None), (4, "", 0, ""), (5, "\u200b ", 0, ""), (6, "a b c d e f g " * 20_000, 0, ""), (7, "one <b>two</b> three four five. one two three four <i>five</i>", 0, ""), (2, sentence, 0, ""), (None, f"{sentence} {sentence}", 0, "")]
    out = repetition(spark.createDataFrame(rows, schema))
    assert out.count() == len(rows)
    one = out.where("doc_id = 1").first()
    assert one["words"] == 27 and one["repeated_words_5"] == 18 and abs(one["repeated_sentences"] - 2 / 3) < 1e-9
    assert {r["doc_id"] for r in repetitive(out).collect()} == {1, 6, 7}
    assert repetition(spark.createDataFrame([], schema)).count() == 0


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_myers(p, t):
    assert myers_within(p, t, len(p)) == plain_distance(p, t)
    assert (myers_within(p, t, 1) is not None) == (plain_distance(p, t) <= 1)


def test_leakage_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            source = items[rng.randrange(25)][1].split()
            at, n = rng.randrange(max(1, len(source) - 5)), rng.randint(8, 25)
            part = source[at : at + n]
            if d % 3 == 0 and part:
                part[rng.randrange(len(part))] = "other"
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((d, ", ".join(w.upper() if d % 5 == 0 else w + "\u00ad" for w in body), 1, "z"))
    docs += [(d + 1000, text.replace(" ", " <b>", 1).replace(", ", "</b>, ", 1), 1, "z") for d, text, *_ in docs[:40]]
    docs += [docs[1], (500, None, 1, "z"), (501, "", 1, "z"), (None, items[0][1], 1, "z")]
    schema, item_schema = "doc_id bigint, text string, item_id int, edits string", "item_id bigint, text string, doc_id int"
    item_rows = [(i, t, 7) for i, t in items] + [(900, None, 7), (901, "", 7), (None, "a b", 7), (items[0][0], items[0][1], 7)]
    df, it = spark.createDataFrame(docs, schema), spark.createDataFrame(item_rows, item_schema)
    exact, near = set(), set()
    for d, text, *_ in docs:
        w = words((text or "").replace("<b>", "").replace("</b>", ""))
        for i, t in items:
            p = words(t)
            if len(p) < 12 and any(w[a : a + len(p)] == p for a in range(len(w) - len(p) + 1)):
                near.add((d, i))
            for s in range(len(p) - 11):
                q = p[s : s + 12]
                if any(w[a : a + 12] == q for a in range(len(w) - 11)):
                    exact.add((d, i))
                if w and plain_distance(q, w) <= 1:
                    near.add((d, i))
    for size in (20_000_000, 300):  # one slice, and many
        out = leaked(df, it, slice_chars=size)
        assert {(r["doc_id"], r["item_id"]) for r in leaked_unchanged(out).collect()} == {x for x in exact if x[0] is not None}
        assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {x for x in near if x[0] is not None}
    assert leaked(df.limit(0), it).count() == 0 and leaked(df, it.limit(0)).count() == 0


def test_short_items_must_stand_whole(spark):
    docs = spark.createDataFrame([(1, "see the red giant branch of this cluster"), (2, "the red giant is here"), (3, "red giant branch")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "The red giant branch"), (2, "red giant branch"), (3, "the red giant branch of that cluster")], "item_id bigint, text string")
    out = leaked(docs, items)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 4, 0)}
    assert leaked_unchanged(out).count() == 0


def test_a_piece_that_many_items_share():
    from noctiluca.llm.leakage import find_passages, split_items

    common = "a b c d e f g h i j k l".split()
    p = split_items(list(range(300)), [" ".join([*common, f"x{i}"]) for i in range(300)], 12, 1)
    docs = [WordIds().of(common * 3), WordIds().of([*common, "x7"])]
    starts = np.r_[0, np.cumsum([len(d) for d in docs])]
    whole = sorted(find_passages(np.concatenate(docs), starts, p))
    object.__setattr__(p, "hits", 50)
    assert sorted(find_passages(np.concatenate(docs), starts, p)) == whole
    assert {(d, i) for d, i, *_ in whole} == {(d, i) for d in (0, 1) for i in range(300)}
