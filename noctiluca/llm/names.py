"""Variant spellings of the names of persons and collaborations.

Names are put into a normal form (accents, case, titles, order of the parts). The family names, and the names of
collaborations, are banded by minima over their padded q-grams; the number of bands follows from the collision curve,
so that one typing error is missed with a stated probability. Pairs of banded forms a typing error apart bring the names
of both together; names are verified by Monge-Elkan similarity over their parts (initials, short forms, nicknames and
typing errors count as likenesses of parts) and clustered by stars: the best attested full name of those alike is the
centre, the others are its leaves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.components import components
from noctiluca.llm.near_duplicates import tasks_for
from noctiluca.llm.words import INVISIBLE, mixed
from noctiluca.session import cut, spread

# Everyday short forms of given names (several full names are possible for some).
NICKNAMES = """
aga agnieszka|alec alexander|alex alexander alexandra alexis|andy andrew andrea|annie anna anne|art arthur|barb barbara|becca rebecca|becky rebecca|bella isabella arabella|ben benjamin benedict|benny benjamin
beppe giuseppe|bert albert robert herbert|bess elizabeth|beth elizabeth bethany|betsy elizabeth|betty elizabeth|bill william|billy william|bob robert|bobby robert|cathy catherine katharina|charlie charles charlotte|chris christopher christina christian
chuck charles|cindy cynthia|dan daniel|dani daniela daniel|danny daniel|dave david|deb deborah|dick richard|dora dorothea theodora|dot dorothea dorothy|drew andrew|ed edward edwin edmund|eddie edward|ella eleanor isabella
etta henrietta|fran francisco frances francis|frank francis franklin|fred frederick alfred|freddy frederick|gabi gabriela gabriel|gabe gabriel|greg gregory|greta margaret|hank henry|hannes johannes|harry henry harold|hattie henrietta
hettie henrietta|hans johannes|ike isaac|isa isabella|jack john|jan johannes|jeff jeffrey|jen jennifer|jenny jennifer|jerry gerald jerome|jim james|jo josephine joanna joseph|joe joseph|johnny john|jon jonathan|josie josephine|kat katharina katherine ekaterina
kate katharina katherine ekaterina|kathi katharina|kathy katharina katherine|katya ekaterina|katie katharina katherine|ken kenneth kenji|kit christopher katharina|klaus nicholas nikolaus|larry lawrence|leo leonardo leonard leopold|lena helena magdalena|leon leonardo|libby elizabeth|lisa elizabeth|liz elizabeth|liza elizabeth
lou louis louise|lucy lucia|maggie margaret|mandy amanda|marge margaret|mat matthew|matt matthew|max maximilian maxwell|meg margaret|mick michael|mike michael|mina wilhelmina|minnie wilhelmina|misha michael mikhail|nat nathan nathaniel natalie|ned edward|nick nicholas
nico nicholas|nina antonina|ollie oliver|paco francisco|pancho francisco|pat patricia patrick|patty patricia|peggy margaret|penny penelope|pepe jose giuseppe|pete peter|phil philip|ray raymond|rick richard frederick|ricky richard|rita margarita margaret|rob robert|robbie robert|ron ronald
sally sarah|sam samuel samantha|sandy alexander alexandra|sasha alexander alexandra|sepp josef|steve stephen steven|sue susanna susan|susi susanna|ted edward theodore|terry terence theresa|thea dorothea theodora|theo theodore|tim timothy|tina christina|toby tobias|tom thomas|tommy thomas|tony anthony|trish patricia|ursi ursula|uschi ursula
vicky victoria|vic victor victoria|vlad vladimir|volodya vladimir|vova vladimir|wes wesley|will william wilhelmina|willy william|xavi xavier|zach zacharias zachary|zack zacharias zachary|zhenya yevgeny yevgenia|zeke ezekiel
"""  # fmt: skip
FULL_NAMES = {short: frozenset(full) for short, *full in (entry.split() for line in NICKNAMES.strip().split("\n") for entry in line.split("|"))}
TITLES = frozenset("dr prof professor mr mrs ms sir dame jr sr phd ii iii iv".split())
GROUP_WORDS = frozenset("collaboration collab team consortium".split())
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})


def fold(name: str) -> str:
    """Lower case without accents, compatibility forms and invisible characters."""
    name = unicodedata.normalize("NFKD", INVISIBLE.sub("", name).casefold().translate(_LETTERS))
    return "".join(c for c in name if not unicodedata.combining(c))


def distance(a: str, b: str, most: int = 1) -> int:
    """Typing errors between two words: insertions, omissions, replacements and swapped neighbours; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def grams(word: str, q: int = 2) -> set[str]:
    padded = "#" * (q - 1) + word + "#" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def bands_for(likeness: float, rows: int, recall: float) -> int:
    """The least number of bands for which 1 - (1 - likeness**rows)**bands reaches the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - likeness**rows))


def split_name(name: str) -> tuple[bool, list[str], list[str]]:
    """(is a collaboration, long parts, the parts as written and folded) of one name."""
    folded = fold(name)
    parts = re.findall(r"[^\W_]+(?:['’-]+[^\W_]+)*\.?", folded)
    bare = [p.rstrip(".") for p in parts]
    if GROUP_WORDS & set(bare):
        return True, [p for p in bare if p not in GROUP_WORDS and p != "the"], parts
    return False, [p for p in bare if len(p) >= 3 and p not in TITLES], parts


def normal_form(name: str, given_names: frozenset[str]) -> tuple[str, str, str, bool, list[str]]:
    """(key, given, initials, cut off, parts): the family name or the collaboration's words as one key, the given name if
    it is written out, further or single initials, whether the given name ends in a full stop, and the parts of a
    compound family name."""
    group, long, parts = split_name(name)
    if group:
        if len(long) == 1 and 2 <= len(long[0]) <= 6:
            return f"a|{long[0]}", "", "", False, []
        return "c|" + " ".join(long), "", "", False, []
    parts = [p for p in parts if p.rstrip(".") not in TITLES]
    if not parts:
        return "p|", "", "", False, []
    marks = []
    # two or three capitals in a name that isn't all capitals are initials, even where they spell a short name
    capitals = set() if name.upper() == name else {c.lower() for c in re.findall(r"\b[A-Z]{2,3}\b", name)}
    for p in parts:
        bare = p.rstrip(".")
        short = len(bare) == 1 or bare in capitals or len(bare) == 2 and bare not in FULL_NAMES and bare not in given_names and not p.endswith(".") or "." in bare
        marks.append("i" if short else "g" if bare in given_names or p.endswith(".") or bare in FULL_NAMES else "w")
    rest = [i for i, m in enumerate(marks) if m != "i"]
    given = -1
    if len(rest) >= 2:
        known = [i for i in rest if marks[i] == "g"]
        # the given name stands first, or last if the family name comes first
        given = rest[0] if rest[0] in known or rest[-1] not in known else rest[-1]
    elif len(rest) == 1 and marks[rest[0]] == "g" and len(parts) == 1:
        given = -1
    family = [parts[i].rstrip(".") for i in rest if i != given]
    letters = "".join(re.sub(r"[^a-z]", "", parts[i]) for i, m in enumerate(marks) if m == "i" and i != given)
    word = parts[given] if given >= 0 else ""
    compound = [p for f in family for p in re.split(r"['’-]", f) if len(p) >= 4]
    return "p|" + re.sub(r"[^\w]", "", "".join(family)), word.rstrip("."), letters, word.endswith("."), compound if len(compound) > 1 else []


def given_likeness(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> float:
    """Likeness of two given names, each (written out or '', initials, cut off), by the best match of their parts."""
    (x, i, x_cut), (y, j, y_cut) = a, b
    further_x, further_y = (i if x else i[1:]), (j if y else j[1:])
    if further_x and further_y and further_x[0] != further_y[0]:
        return 0.0
    middle = 1.0 if further_x == further_y else 0.95
    first_x, first_y = (x or i)[:1], (y or j)[:1]
    if not first_x or not first_y:
        return 0.0
    full_x, full_y = FULL_NAMES.get(x, frozenset()) | {x}, FULL_NAMES.get(y, frozenset()) | {y}
    if x and y:
        if x == y:
            return middle
        if (x_cut or y_cut) and (x.startswith(y) and y_cut or y.startswith(x) and x_cut):
            return 0.95 * middle
        if full_x & full_y:
            return 0.93 * middle
        if min(len(x), len(y)) >= 3 and max(len(x), len(y)) >= 4 and distance(x, y) == 1:
            return 0.9 * middle
        if min(len(x), len(y)) >= 2 and (x.startswith(y) or y.startswith(x)):
            return 0.85 * middle
        return 0.0
    if x or y:
        letter = (i if not x else j)[:1]
        if any(n.startswith(letter) for n in (full_x if x else full_y)):
            return 0.88 * middle
        return 0.0
    return 0.9 * middle if first_x == first_y else 0.0


def monge_elkan(a: tuple[str, str, str, bool], b: tuple[str, str, str, bool]) -> float:
    """Mean over the parts of a name of their likeness to the best part of the other; 0 if a part has no counterpart."""
    if a[0][:1] == "p" and b[0][:1] == "p":
        short, long = sorted((a[0][2:], b[0][2:]), key=len)
        family = 1.0 if short == long else 0.9 if distance(short, long) == 1 else 0.8 if len(short) >= 4 and (long.startswith(short) or long.endswith(short)) else 0.0
        given = given_likeness(a[1:], b[1:])
        return (family + given) / 2 if family and given else 0.0
    if "a" in (a[0][:1], b[0][:1]):
        if a[0][:1] == b[0][:1]:
            return 1.0 if a[0] == b[0] else 0.0
        short, words = (a, b) if a[0][:1] == "a" else (b, a)
        letters = "".join(w[0] for w in words[0][2:].split())
        return 0.9 if short[0][2:] in (letters, letters + "c", letters + "t") else 0.0
    x, y = a[0][2:].split(), b[0][2:].split()
    if not x or len(x) != len(y):
        return 0.9 if distance("".join(x), "".join(y)) <= 1 and x else 0.0
    best = [max(1.0 if p == q else 0.9 if min(len(p), len(q)) >= 3 and distance(p, q) == 1 else 0.0 for q in y) for p in x]
    return sum(best) / len(best) if min(best) > 0 else 0.0


def meeting_keys(form: tuple[str, str, str, bool]) -> tuple[set[str], set[str]]:
    """(held, asked): two given names can only be alike if one of them asks for a key that the other holds. Names hold
    themselves, their full names, first letters, beginnings and forms with one letter left out; so comparing the names of
    one family takes time near their number, not its square."""
    _, given, initials, _ = form
    if form[0][:1] != "p":
        return {"*"}, {"*"}
    if not given:
        letter = "i" + initials[:1]
        return {letter, "j" + initials[:1]}, {letter, "l" + initials[:1]}
    full = FULL_NAMES.get(given, frozenset()) | {given}
    less = {"d" + given[:i] + given[i + 1 :] for i in range(len(given))} | {"d" + given} if len(given) >= 3 else set()
    letters = {n[:1] for n in full}
    held = {"f" + n for n in full} | less | {"b" + given[:i] for i in range(1, len(given) + 1)} | {"l" + c for c in letters}
    asked = {"f" + n for n in full} | less | {"b" + given, "j" + given[:1]} | {"w" + given[:i] for i in range(1, len(given))} | {"j" + c for c in letters}
    return held | {"w" + given}, asked


def stars(forms: list[tuple[tuple[str, str, str, bool], int, int, bool]], least: float = 0.8) -> list[tuple[int, float]]:
    """Star clustering of the forms that met under one key: (form, weight, spellings, own), where forms of another key
    (typing errors, short names) can only become leaves. Returns for each form its centre and likeness, or (-1, 0)."""
    order = sorted(range(len(forms)), key=lambda i: (not forms[i][3], not forms[i][0][1], forms[i][0][3], -forms[i][1], forms[i][0]))
    rank: dict[int, int] = {}
    holders: dict[str, list[int]] = {}
    keys = [meeting_keys(f[0]) for f in forms]
    out = [(-1, 0.0)] * len(forms)
    for i in order:
        form, _, _, own = forms[i]
        near = {c for k in keys[i][1] for c in holders.get(k, ())}
        best = max(((monge_elkan(form, forms[c][0]), forms[c][1], -rank[c], c) for c in near), default=(0.0, 0, 0, -1))
        if best[0] >= least:
            out[i] = (best[3], best[0])
        elif own:
            rank[i] = len(rank)
            out[i] = (i, 1.0)
            for k in keys[i][0]:
                holders.setdefault(k, []).append(i)
    # stars whose leaves are alike are one, unless some of their initials contradict each other: a centre may be a nickname
    # or hold a typing error itself
    leaves: dict[int, list[int]] = {}
    for i in order:
        if forms[i][3]:
            leaves.setdefault(out[i][0], []).append(i)
    first = {c: (forms[c][0][1] or forms[c][0][2])[:1] for c in rank}
    further = {c: {(forms[i][0][2] if forms[i][0][1] else forms[i][0][2][1:])[:1] for i in group} - {""} for c, group in leaves.items()}
    star_of: dict[str, list[tuple[int, int]]] = {}
    joined: dict[int, int] = {}
    for c in rank:
        met: dict[int, bool] = {}
        for i in leaves.get(c, ()):
            for k in keys[i][1]:
                for d, j in star_of.get(k, ()):
                    if not met.get(d) and first[c] == first[d] and not (further[c] and further[d] and further[c] != further[d]):
                        met[d] = monge_elkan(forms[i][0], forms[j][0]) >= least
        to = min((d for d, yes in met.items() if yes), key=rank.__getitem__, default=c)
        if to != c:
            joined[c] = to
            further[to] = further[to] | further[c]
        for i in leaves.get(c, ()):
            for k in keys[i][0]:
                star_of.setdefault(k, []).append((to, i))
    return [(joined.get(c, c), sim) for c, sim in out]


def author_names(records: DataFrame, authors_col: str = "authors") -> DataFrame:
    """(name, times): the distinct names between the commas, outer blanks removed; 'et al.' and empty entries are none."""
    name = F.regexp_replace(F.col("name"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    entry = records.select(F.explode(F.split(F.col(f"`{authors_col}`").cast("string"), ",")).alias("name")).select(name.alias("name"))
    return entry.where(~F.lower("name").rlike(r"^(et\.? al\.?|and others|u\. ?a\.|)$")).groupBy("name").agg(F.count("*").alias("times"))


def words_of_names(names: DataFrame) -> DataFrame:
    """(name, times, word, first, last): the long words of each name, and whether a word opens or ends one of several; a
    name without long words has one row without a word."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, times in zip(batch["name"], batch["times"], strict=True):
                group, long, _ = split_name(name)
                some = [] if group else long
                rows += [(name, times, w, int(len(some) > 1 and i == 0), int(len(some) > 1 and i == len(some) - 1)) for i, w in enumerate(some)] or [(name, times, None, 0, 0)]
            yield pd.DataFrame(rows, columns=["name", "times", "word", "first", "last"])

    return names.select("name", "times").mapInPandas(each, "name string, times bigint, word string, first int, last int")


def given_names(words: DataFrame, sure: float = 2.0) -> DataFrame:
    """(word): the words that open names more often than they end them, by so many standard deviations of a fair coin. How
    much evidence that takes doesn't depend on the size of the table, and all such words are taken."""
    counted = words.where("word is not null").groupBy("word").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    return counted.where(F.col("first") - F.col("last") > sure * F.sqrt(F.col("first") + F.col("last"))).select("word")


def similar_keys(keys: DataFrame, likeness: float, rows: int, recall: float, blocks: int) -> DataFrame:
    """(a, b): keys a typing error apart, found in bands of minima over their padded q-grams."""
    bands = bands_for(likeness, rows, recall)
    rng = np.random.default_rng(29)
    factors = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            key = batch.column("key").to_pylist()
            sets = []
            for k in key:
                g = grams(k[2:])
                for x in g - known.keys():
                    known[x] = xxhash.xxh3_64_intdigest(x)
                sets.append(np.array([known[x] for x in g], np.uint64))
            if not sets:
                continue
            starts = np.r_[0, np.cumsum([len(s) for s in sets])][:-1].astype(np.int64)
            flat = np.concatenate(sets)
            m = np.stack([np.minimum.reduceat(flat * f, starts) for f in factors], 1)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (mixed(flat) & np.uint64(63)), starts)
            token = np.zeros((len(key), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                token = mixed(token * np.uint64(0x9E3779B97F4A7C15) + m[:, r::rows])
            each = np.repeat(np.arange(len(key)), bands)
            token = token.ravel()
            yield pa.RecordBatch.from_arrays([pa.array((token % np.uint64(blocks)).astype(np.int32)), pa.array(token.view(np.int64)), pa.array(mask[each].view(np.int64)), pa.array(key, pa.string()).take(pa.array(each))], names=["block", "token", "mask", "key"])

    def compare(group: pa.Table) -> pa.Table:
        words, row = np.unique(group.column("key").to_numpy(zero_copy_only=False), return_inverse=True)
        token, mask = group.column("token").to_numpy(), group.column("mask").to_numpy().view(np.uint64)
        order = np.lexsort((row, token))
        token, row, mask = token[order], row[order], mask[order]
        seen: list[np.ndarray] = []
        ends = np.searchsorted(token, token, "right")
        gap, at = 1, np.arange(len(token))
        while len(at := at[at + gap < ends[at]]):
            # one typing error changes at most three q-grams on either side
            near = at[np.bitwise_count(mask[at] ^ mask[at + gap]) <= 6]
            seen.append(np.unique(np.minimum(row[near], row[near + gap]) * len(words) + np.maximum(row[near], row[near + gap])))
            gap += 1
        a, b = np.divmod(np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64), max(1, len(words)))
        near = [(words[x], words[y]) for x, y in zip(a, b, strict=True) if x != y and words[x][0] == words[y][0] and distance(words[x], words[y]) == 1]
        return pa.table({"a": pa.array([x for x, _ in near], pa.string()), "b": pa.array([y for _, y in near], pa.string())})

    return keys.mapInArrow(band, "block int, token bigint, mask bigint, key string").groupBy("block").applyInArrow(compare, "a string, b string").distinct()


FORMS = "name string, times bigint, key string, given string, initials string, cut boolean, parts array<string>"


def link_names(records: DataFrame, authors_col: str = "authors", likeness: float = 0.5, rows: int = 3, recall: float = 0.995, least: float = 0.8, sure: float = 2.0) -> DataFrame:
    """(name, times, entity): every distinct name with the centre of its star, a person or collaboration.

    The forms of a family name or collaboration that is a typing error away from a better attested one, or a part of a
    compound one, visit that one's stars, however many spellings there are; so do short names of initials. A star joins
    another if its centre found one there, that is, if the given names and initials agree, and takes its leaves along.
    Null, empty and blank entries and 'et al.' are no names; repeated rows only raise a name's weight; other columns are
    not read; an empty table gives no rows. Spellings of one normal form are taken together before names are compared,
    and are then compared with the centres of their key only, and of these with those whose given names can be alike, so
    a family name of very many forms takes time near their number. Which words are given names follows from how surely
    (``sure`` standard deviations) they open names rather than end them.
    """
    names = author_names(records, authors_col)
    words = cut(words_of_names(spread(cut(names))))
    known = words.join(given_names(words, sure).withColumn("is_given", F.lit(True)), "word", "left").groupBy("name").agg(F.first("times").alias("times"), F.array_compact(F.collect_set(F.when(F.col("is_given"), F.col("word")))).alias("given_words"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [normal_form(n, frozenset(g)) for n, g in zip(batch["name"], batch["given_words"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "times": batch["times"], "key": [f[0] for f in forms], "given": [f[1] for f in forms], "initials": [f[2] for f in forms], "cut": [f[3] for f in forms], "parts": [f[4] for f in forms]})

    parsed = cut(known.mapInPandas(parse, FORMS))
    forms = parsed.groupBy("key", "given", "initials", "cut").agg(F.sum("times").alias("weight"), F.count("*").alias("spellings"))
    keys = cut(parsed.groupBy("key").agg(F.count("*").alias("names"), F.sum("times").alias("weight")))
    distinct = keys.count()
    blocks, tasks = tasks_for(distinct, bands_for(likeness, rows, recall) * 40), tasks_for(parsed.count(), 200)
    near = similar_keys(keys.where(F.length("key") > 5).where(~F.col("key").startswith("a|")).select("key"), likeness, rows, recall, blocks)
    both = near.union(near.select("b", "a"))
    small, large = keys.select(F.col("key").alias("a"), F.col("names").alias("small"), F.col("weight").alias("small_w")), keys.select(F.col("key").alias("b"), F.col("names").alias("large"), F.col("weight").alias("large_w"))
    typed = both.join(small, "a").join(large, "b").where((F.col("large") > F.col("small")) | (F.col("large") == F.col("small")) & (F.struct("large_w", "b") > F.struct("small_w", "a"))).select(F.col("a").alias("key"), F.col("b").alias("at"))
    words = F.split(F.expr("substring(key, 3)"), " ")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    whole = keys.where(F.col("key").startswith("c|")).select(F.col("key").alias("at"), F.explode(F.array(*[F.concat(F.lit("a|"), initials, F.lit(x)) for x in ("", "c", "t")])).alias("key"))
    short = keys.where(F.col("key").startswith("a|")).join(whole, "key").select("key", "at")
    part = parsed.select(F.col("key").alias("at"), F.explode("parts").alias("part")).distinct().select("at", F.concat(F.lit("p|"), "part").alias("key"))
    lone = keys.where(F.col("key").startswith("p|")).join(part, "key").select("key", "at")
    visits = typed.union(short).union(lone).distinct()
    there = forms.withColumn("at", F.col("key")).withColumn("own", F.lit(True)).unionByName(forms.join(visits, "key").withColumn("own", F.lit(False)))

    def cluster(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        frame = group.to_pandas()
        for at, own in frame.groupby("at", sort=False):
            rows = [((k, g, i, bool(c)), int(w), int(s), bool(o)) for k, g, i, c, w, s, o in zip(own["key"], own["given"], own["initials"], own["cut"], own["weight"], own["spellings"], own["own"], strict=True)]
            for (form, weight, _, mine), (centre, sim) in zip(rows, stars(rows, least), strict=True):
                if centre >= 0:
                    c = rows[centre][0]
                    out.append((*form, f"{c[0]}|{c[1]}|{c[2]}", mine, sim, rows[centre][1]))
        names = ["key", "given", "initials", "cut", "entity", "own", "sim", "centre_weight"]
        types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.float64(), pa.int64()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    form = ["key", "given", "initials", "cut"]
    stars_of = cut(there.withColumn("task", F.pmod(F.xxhash64("at"), F.lit(tasks)).cast("int")).select("task", "at", *form, "weight", "spellings", "own").groupBy("task").applyInArrow(cluster, "key string, given string, initials string, cut boolean, entity string, own boolean, sim double, centre_weight bigint"))
    at_home = stars_of.where("own").select(*form, "entity")
    # of several centres that a centre found elsewhere the most alike, then the best attested
    centres = at_home.where(F.col("entity") == F.concat_ws("|", "key", "given", "initials"))
    away = stars_of.where("NOT own").select(*form, "sim", "centre_weight", F.col("entity").alias("b"))
    moves = cut(centres.join(away, form).groupBy(F.col("entity").alias("a")).agg(F.max(F.struct("sim", "centre_weight", "b")).alias("best")).select("a", F.col("best.b").alias("b"), F.col("best.centre_weight").alias("w")))
    # a centre found elsewhere may itself have moved on; the end of the chain gives the name
    weights = moves.select(F.col("b").alias("node"), "w").groupBy("node").agg(F.max("w").alias("w"))
    ends = components(moves).join(moves.select(F.col("a").alias("node"), F.lit(True).alias("moved")), "node", "left").join(weights, "node", "left")
    last = ends.groupBy("component").agg(F.max(F.struct(F.col("moved").isNull(), "w", "node")).alias("end")).select("component", F.col("end.node").alias("end"))
    ended = ends.join(last, "component").select(F.col("node").alias("entity"), "end")
    settled = at_home.join(ended, "entity", "left").select(*form, F.coalesce("end", "entity").alias("entity"))
    return parsed.join(settled, form, "left").select("name", "times", F.coalesce("entity", "key").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), a < b by code point: all pairs of different names of one entity."""
    own = linked.select("entity", "name").distinct()
    return own.withColumnRenamed("name", "name_a").join(own.withColumnRenamed("name", "name_b"), "entity").where("name_a < name_b").select("name_a", "name_b")
