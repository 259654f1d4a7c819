"""Groups of near-duplicate records, by bit-sliced comparison of sketches and exact verification.

1. Each text becomes its set of distinct word sequences, a 256-bit sketch (one bit of each of 256 minima) and tokens:
   hashes of bands of minima, of which similar sets share at least one. Equal sets are taken together within each batch
   before anything is shuffled, and once more per block.
2. The postings of a block of tokens are compared in one task: sketches stand vertically as bit planes, distances of all
   lanes grow together in carry-save counters, and blocks of lanes that all exceed the radius are abandoned. What is left
   connects sets to candidate components.
3. The sets and edges of each candidate component meet in one place, and the edges are verified exactly. Only where that
   leaves a component in several parts are sets of different parts compared. Edges of components too large for one task
   are verified by a join, and their smaller parts are compared with the rest in chunks; the largest part, which after a
   verified spanning tree needs no more comparing, is never compared with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.components import components
from noctiluca.llm.markup import without_markup
from noctiluca.llm.sketches import BITS, Forest, band_tokens, minima, near_in_block, one_bit_sketches, sequence_sets, set_keys
from noctiluca.llm.words import WordIds, mixed
from noctiluca.session import bounded_batches, cut, spread

#: Largest number of sets of one component that one task compares; larger ones are compared chunk against chunk.
CHUNK = 4096
#: Bytes that one task of postings or sets should hold, and what a posting and a set take.
TASK_BYTES, POSTING, SET_BYTES = 32 << 20, 56, 1500
BLANK = r"^[\s\p{Z}\p{Cf}\p{Cc}]*$"


def whole_texts(records: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, the fields as f0, f1, ...) of the records that have an id and no null or blank field."""
    some = F.col(f"`{id_col}`").isNotNull()
    for f in fields:
        some &= F.col(f"`{f}`").isNotNull() & ~F.col(f"`{f}`").rlike(BLANK)
    return spread(records.where(some).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]))


def parsed_sets(texts: DataFrame, fields: int, n: int, wide: bool = False) -> DataFrame:
    """(id, key, set[, side]): each text's distinct n-word sequences as packed hashes of 32 bits, or of 64 if ``wide``, and a
    64-bit key of the whole set; texts too short for a sequence are left out. Written to the shared folder, so that texts
    are parsed once."""
    bounded_batches(texts.sparkSession)
    side = ["side"] if "side" in texts.columns else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            parts = [batch.column(f"f{i}").to_pylist() for i in range(fields)]
            tokens, starts = sequence_sets([". ".join(map(without_markup, row)) for row in zip(*parts, strict=True)], n, known)
            key = set_keys(tokens, starts).view(np.int64)
            full = np.flatnonzero(starts[1:] > starts[:-1])
            short = tokens if wide else (tokens >> np.uint64(16)).astype(np.uint32)
            mark = b"\1" if wide else b""
            take = pa.array(full)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), pa.array(key[full]), pa.array([mark + short[starts[i] : starts[i + 1]].tobytes() for i in full], pa.binary()), *[batch.column(c).take(take) for c in side]], names=["id", "key", "set", *side])

    return cut(texts.mapInArrow(each, "id bigint, key bigint, set binary" + ", side int" * bool(side)))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts) of packed sets; 32-bit ones are spread over 64 bits."""
    held = column.to_pylist()
    if held and len(held[0]) % 4:  # a leading byte marks hashes of 64 bits
        return np.frombuffer(b"".join(x[1:] for x in held), np.uint64), np.r_[0, np.cumsum([len(x) // 8 for x in held])].astype(np.int64)
    return mixed(np.frombuffer(b"".join(held), np.uint32).astype(np.uint64)), np.r_[0, np.cumsum([len(x) // 4 for x in held])].astype(np.int64)


def _pick(tokens: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = (starts[1:] - starts[:-1])[rows]
    out = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return tokens[np.repeat(starts[rows] - out[:-1], sizes) + np.arange(out[-1])], out


def postings(parsed: DataFrame, blocks: int, tokens_of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], side: bool = False) -> DataFrame:
    """(block, data): per batch and block one record with the sets, sketches and tokens that fall into the block."""
    columns = ["key", "set"] + (["side"] if side else [])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, starts = unpacked(batch.column("set"))
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            mine = batch.column("side").to_numpy(zero_copy_only=False).astype(np.uint64) if side else np.zeros(len(key), np.uint64)
            first = np.unique(np.stack([key, mine], 1), axis=0, return_index=True)[1]
            tokens, starts = _pick(tokens, starts, first)
            key, mine, sizes = key[first], mine[first], np.diff(starts)
            m = minima(tokens, starts, BITS)
            sketch = one_bit_sketches(m)
            lists = tokens_of(tokens, starts, m)
            token = np.concatenate(lists)
            row = np.repeat(np.arange(len(key)), [len(x) for x in lists])
            block = (token % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            token, row, block = token[order], row[order], block[order]
            edges = np.searchsorted(block, np.arange(blocks + 1))
            data, which = [], []
            for b in range(blocks):
                lo, hi = edges[b], edges[b + 1]
                if lo == hi:
                    continue
                rows, local = np.unique(row[lo:hi], return_inverse=True)
                head = np.array([len(rows), hi - lo], np.int64)
                data.append(b"".join([head.tobytes(), key[rows].tobytes(), (sizes[rows].astype(np.uint64) << np.uint64(1) | mine[rows]).tobytes(), sketch[rows].tobytes(), (token[lo:hi] >> np.uint64(32)).astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes()]))
                which.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    return parsed.select(*columns).mapInArrow(each, "block int, data binary")


def tasks_for(count: int, each: int) -> int:
    """Number of tasks so that one holds about TASK_BYTES of ``count`` things of ``each`` bytes."""
    return max(12, -(-count * each // TASK_BYTES))


def candidate_edges(posted: DataFrame, likeness: float, side: bool = False) -> DataFrame:
    """(a, b): keys of sets whose sketches are near and that share a token; enough pairs to connect all such sets."""
    width = BITS // 64

    def each(group: pa.Table) -> pa.Table:
        keys, sizes, sketches, tokens, rows, base = [], [], [], [], [], 0
        for data in group.column("data").to_pylist():
            count, many = np.frombuffer(data, np.int64, 2)
            at = 16
            keys.append(np.frombuffer(data, np.uint64, count, at))
            sizes.append(np.frombuffer(data, np.uint64, count, at + 8 * count))
            at += 16 * count
            sketches.append(np.frombuffer(data, np.uint64, count * width, at).reshape(-1, width))
            at += 8 * width * count
            tokens.append(np.frombuffer(data, np.uint32, many, at))
            rows.append(np.frombuffer(data, np.uint32, many, at + 4 * many).astype(np.int64) + base)
            base += count
        key, packed, sketch = np.concatenate(keys), np.concatenate(sizes), np.concatenate(sketches)
        _, first, same = np.unique(np.stack([key, packed & np.uint64(1)], 1), axis=0, return_index=True, return_inverse=True)
        key, packed, sketch = key[first], packed[first], sketch[first]
        found = list(near_in_block(np.concatenate(tokens), same.ravel()[np.concatenate(rows)], (packed >> np.uint64(1)).astype(np.int64), sketch, likeness, (packed & np.uint64(1)).astype(np.int8) if side else None))
        a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"a": key[a].view(np.int64), "b": key[b].view(np.int64)})

    return posted.groupBy("block").applyInArrow(each, "a bigint, b bigint")


def sets_of(parsed: DataFrame) -> DataFrame:
    """(key, set): each distinct set once per batch, so that a key of very many records is not a key of very many rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True)[1]
            yield batch.take(pa.array(first))

    return parsed.select("key", "set").mapInArrow(each, "key bigint, set binary")


def shared_counts(sets: list[np.ndarray], only: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, sizes of all sets, members shared with every set) for some rows at a time, of the first ``only`` rows."""
    only = len(sets) if only is None else only
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if len(sets) * len(values) <= 4_000_000:
        matrix = np.zeros((len(sets), len(values)), np.float32)
        matrix[owner, column] = 1
        yield np.arange(only), sizes, (matrix[:only] @ matrix.T).astype(np.int64)
        return
    order = np.argsort(column, kind="stable")
    holders, at = owner[order], np.searchsorted(column[order], np.arange(len(values) + 1))
    begin = np.r_[0, np.cumsum(sizes)]
    for i in range(only):
        mine = column[begin[i] : begin[i + 1]]
        yield np.array([i]), sizes, np.bincount(np.concatenate([holders[at[c] : at[c + 1]] for c in mine]), minlength=len(sets))[None, :]


def compare_components(comps: DataFrame, sets: DataFrame, compare: Callable[[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray], list[tuple]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """Bring the sets of each component together and call ``compare(keys, sets, part, flag)``, where part is 0 for the rows
    of one chunk and 1 for those of another it is compared with (all 0 when a component fits in one chunk), and flag is
    the column of that name in ``comps``, if there is one.

    Components are spread over a fixed number of tasks each of which gets many small ones; one of more than ``chunk`` sets
    is cut into chunks, and every two chunks meet in a task of their own."""
    names = [x.split()[0] for x in schema.split(",")]
    comps = comps if "flag" in comps.columns else comps.withColumn("flag", F.lit(0))
    counted = comps.groupBy("component").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    placed = comps.join(counted, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = placed.withColumn("other", partner).select(F.col("node").alias("key"), "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "flag")
    tasks = tasks_for(comps.count(), SET_BYTES)
    rows = sets.join(met, "key").withColumn("task", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "i", "j")))

    def each(group: pa.Table) -> pa.Table:
        frame = group.select(["component", "i", "j", "chunk", "key", "set", "flag"]).to_pandas().drop_duplicates(["component", "i", "j", "key"]).sort_values(["component", "i", "j", "chunk", "key"], kind="stable")
        out: list[tuple] = []
        for (_, i, _), own in frame.groupby(["component", "i", "j"], sort=False):
            out += compare(own["key"].to_numpy(), [np.frombuffer(s, np.uint32) for s in own["set"]], (own["chunk"].to_numpy() != i).astype(np.int8), own["flag"].to_numpy())
        return pa.table(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}, schema=pa.schema([(x.split()[0], {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]]) for x in schema.split(",")]))

    return rows.groupBy("task").applyInArrow(each, schema)


def _links(likeness: float) -> Callable[[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray], list[tuple]]:
    def compare(keys: np.ndarray, sets: list[np.ndarray], part: np.ndarray, flag: np.ndarray) -> list[tuple]:
        """Links that connect what is alike, and per set its number of links here (as a link to itself)."""
        forest, out = Forest(len(sets)), []
        count = np.zeros(len(sets), np.int64)
        across = part.any()
        for rows, sizes, common in shared_counts(sets):
            both = sizes[rows][:, None] + sizes[None, :] - common
            for a, b in zip(*np.nonzero(common >= likeness * both - 1e-9), strict=True):
                x = int(rows[a])
                if x != b and not (across and part[x] == part[b]):
                    count[x] += 1
                    if x < b and forest.join(x, int(b)):
                        out.append((int(keys[x]), int(keys[b]), 0))
        return out + [(int(keys[x]), int(keys[x]), int(count[x])) for x in np.flatnonzero(count)]

    return compare


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def _join_parts(sets: list[np.ndarray], part: np.ndarray, left: int, likeness: float) -> Iterator[tuple[int, int]]:
    """Pairs of rows, one of them among the first ``left``, of different parts and at least that like each other, as many
    as it takes to join the parts that are."""
    forest = Forest(len(sets))
    first: dict[int, int] = {}
    for i, p in enumerate(part.tolist()):
        forest.join(first.setdefault(p, i), i)
    for rows, sizes, common in shared_counts(sets, left):
        both = sizes[rows][:, None] + sizes[None, :] - common
        for a, b in zip(*np.nonzero((common >= likeness * both - 1e-9) & (part[rows][:, None] != part[None, :])), strict=True):
            if forest.join(int(rows[a]), int(b)):
                yield int(rows[a]), int(b)


def _packed(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def verified_links(edges: DataFrame, comps: DataFrame, sets: DataFrame, likeness: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links of at least that likeness that connect whatever is connected by such links within a component.

    ``edges`` (a, b) connect each component of ``comps`` (node, component); ``sets`` is (key, set)."""
    sized = comps.groupBy("component").agg(F.count("*").alias("n"))
    comps = cut(comps.join(sized, "component"))
    tasks = tasks_for(comps.count(), SET_BYTES)
    task = F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("int").alias("task")
    few = comps.where(F.col("n") <= chunk)
    nodes = few.select(F.col("node").alias("key"), "component", task)
    lines = edges.join(few.select(F.col("node").alias("a"), "component", task), "a")

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, first = np.unique(left.column("key").to_numpy(), return_index=True)
        held, of = _packed(left.column("set").take(pa.array(first))), left.column("component").to_numpy()[first]
        forest, out = Forest(len(keys)), []
        for a, b in zip(np.searchsorted(keys, right.column("a").to_numpy()).tolist(), np.searchsorted(keys, right.column("b").to_numpy()).tolist(), strict=True):
            if forest.root(a) != forest.root(b) and _likeness(held[a], held[b]) >= likeness - 1e-9:
                forest.join(a, b)
                out.append((a, b))
        root = np.array([forest.root(i) for i in range(len(keys))])
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            if len(np.unique(root[rows])) > 1:
                out += [(int(rows[x]), int(rows[y])) for x, y in _join_parts([held[i] for i in rows], root[rows], len(rows), likeness)]
        return pa.table({"a": pa.array(keys[[x for x, _ in out]] if out else [], pa.int64()), "b": pa.array(keys[[y for _, y in out]] if out else [], pa.int64())})

    found = sets.join(nodes, "key").select("task", "component", "key", "set").groupBy("task").cogroup(lines.select("task", "a", "b").groupBy("task")).applyInArrow(within, "a bigint, b bigint")
    large = comps.where(F.col("n") > chunk)
    if not large.limit(1).count():
        return found
    known = cut(sets.join(large.select(F.col("node").alias("key")), "key", "left_semi").dropDuplicates(["key"]))
    pairs = edges.join(large.select(F.col("node").alias("a")), "a", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_likeness(x, y) >= likeness - 1e-9 for x, y in zip(_packed(batch.column("x")), _packed(batch.column("y")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(known.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(known.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    sure = cut(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))
    parts = large.select("node", "component").join(components(sure).withColumnRenamed("component", "part"), "node", "left").select("component", "node", F.coalesce("part", "node").alias("part"))
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("component").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("main_size"), F.sum("size").alias("all"), F.count("*").alias("parts"))
    split = cut(parts.join(main.where("parts > 1"), "component").select("component", "node", "part", (F.col("part") == F.col("main")).alias("is_main"), F.ceil(F.col("main_size") / chunk).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("main_size")) / chunk).cast("int").alias("others")))
    # every chunk of other parts meets every chunk of the main part, and every two chunks of other parts meet
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    asks = split.where("not is_main").withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))).where("j >= own").select("component", F.col("own").alias("i"), "j", F.lit(True).alias("asks"), "node", "part")
    meets = split.withColumn("own", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("j", F.when(F.col("is_main"), F.col("others") + F.col("own")).otherwise(F.col("own"))).where("j > i").select("component", "i", "j", F.lit(False).alias("asks"), "node", "part")

    def across(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        order = np.argsort(~asks, kind="stable")
        group = group.take(pa.array(order))
        keys = group.column("key").to_numpy()
        out = list(_join_parts(_packed(group.column("set")), group.column("part").to_numpy(), int(asks.sum()), likeness))
        return pa.table({"a": pa.array(keys[[x for x, _ in out]] if out else [], pa.int64()), "b": pa.array(keys[[y for _, y in out]] if out else [], pa.int64())})

    met = known.join(asks.unionByName(meets).withColumnRenamed("node", "key"), "key").select("component", "i", "j", "asks", "key", "part", "set")
    return found.unionByName(sure).unionByName(met.groupBy("component", "i", "j").applyInArrow(across, "a bigint, b bigint"))


def near_duplicates(records: DataFrame, id_col: str = "paper_id", fields: tuple[str, ...] = ("title", "abstract"), n: int = 3, likeness: float = 0.55, bands: int = 48, rows: int = 3, links: bool = False) -> DataFrame:
    """(id, class_id, group_id[, links]): one row per record that takes part.

    class_id is common to records with the same word sequences; group_id to records joined by a likeness of at least
    ``likeness`` (shared distinct n-word sequences over those in either), directly or through others. With ``links`` all
    sets of a candidate component are compared, and the number of other classes that the record's class is that much like
    is given. Records with a null id, a null or blank field or fewer than n words take no part; repeated rows count once;
    other columns are not read; an empty table gives no rows.

    A pair at the very threshold shares none of 48 bands of 3 with probability 2e-4 (2e-7 at a likeness of 0.65) and
    leaves the sketch radius with 1e-5; whatever is found is verified exactly (sequences are 32-bit hashes).
    """

    def tokens_of(tokens: np.ndarray, starts: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        return list(band_tokens(m, bands, rows))

    parsed = parsed_sets(whole_texts(records, id_col, fields), len(fields), n)
    members = parsed.select("id", "key").distinct()
    edges = cut(candidate_edges(postings(parsed, tasks_for(parsed.count(), bands * POSTING), tokens_of), likeness).distinct())
    comps = components(edges)
    if not links:
        groups = components(verified_links(edges, comps, sets_of(parsed), likeness))
        return members.join(groups.withColumnRenamed("node", "key"), "key", "left").select("id", F.col("key").alias("class_id"), F.coalesce("component", "key").alias("group_id"))
    found = cut(compare_components(comps, sets_of(parsed), _links(likeness), "a bigint, b bigint, links int"))
    groups = components(found.where("a <> b"))
    counted = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "key")
    return members.join(groups.withColumnRenamed("node", "key"), "key", "left").join(counted, "key", "left").select("id", F.col("key").alias("class_id"), F.coalesce("component", "key").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def grouped_pairs(found: DataFrame) -> DataFrame:
    """(paper_id_a, paper_id_b), a < b: all pairs of records in one group."""
    own = found.select("group_id", "id").distinct()
    several = own.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    own = own.join(several, "group_id")
    return own.select("group_id", F.col("id").alias("paper_id_a")).join(own.select("group_id", F.col("id").alias("paper_id_b")), "group_id").where("paper_id_a < paper_id_b").select("paper_id_a", "paper_id_b")
