"""The most similar vectors of every vector, by collision counting over sorted projections.

Every vector is projected onto a few random lines. Per line the values of the indexed vectors stand in a sorted array,
and around a query's own value a window is opened; a vector inside the window collides with the query on that line.
The members of a window are the difference of two prefixes of the sorted array, held as bit sets, so a line is counted
for a whole block of vectors at once in carry-save counters. The window starts narrow and grows by a constant factor
(virtual rehashing: the arrays stay, only the flanks that are new are counted) until the query has its k neighbours or
its radius is reached. Vectors that collide on enough lines are compared exactly.

A window on one line holds a fixed share of all rows, so counting over a whole table would be quadratic. The rows are
therefore first sent to cells of similar vectors (fitted on a bounded sample, every row assigned); arrays and
windows are kept per cell. Where all rows ask (``similar_vectors``), each is sent to its nearest cells and compared with all
that were sent there, so two rows meet if any of their nearest cells is the same; their radius is one and the same, so
each two are counted once, at the full window. Where queries ask a table (``search_similar``), each of its rows has a home
cell only, the queries visit many, and their windows grow. The number of cells follows the number of rows: beyond
``SINGLE`` or ``FLAT`` of them a cell is a centroid together with a centroid of the residuals, which is less exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.llm.sketches import SlicedCounter
from noctiluca.llm.words import mixed
from noctiluca.session import bounded_batches, spread

PAIRS = "src_id bigint, dst_id bigint, sim double"
#: Most centroids of one codebook; two of them make up to LEAF * LEAF cells.
LEAF = 4096
#: Places of a sorted array, and places per unit of length on a line; unit vectors lie within 6 of zero but for 2e-9 of them.
PLACES, STEP = 384, 32
#: Beyond so many cells, cells are pairs of centroids: where queries visit many cells, and where all rows ask.
FLAT, SINGLE = 1024, 32_768
#: Lanes of one plane of a block, few enough to stay in a core's cache.
PLANE = 1 << 20
#: Most scores held at once when rows are assigned.
SCORES = 1 << 22


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec, class) of the rows that have an id and a finite, non-zero vector of ``dim`` values; equal vectors have one
    class."""
    v = F.col(f"`{vec_col}`")
    size = F.coalesce(F.size(v), F.lit(-1)) == dim
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    kept = vectors.where(F.col(f"`{id_col}`").isNotNull() & size & finite & F.exists(v, lambda x: x != 0))
    return kept.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.cast("array<float>").alias("vec")).withColumn("class", F.xxhash64("vec"))


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = values.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of very large or small values finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half, block = (centre**2).sum(axis=1) / 2, max(64, min(8192, SCORES // len(centre)))
    return np.concatenate([np.argmax(x[i : i + block] @ centre.T - half, axis=1) for i in range(0, len(x), block)])


def fit_codebook(sample: np.ndarray, size: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """At most ``size`` centroids (k-means) of the sample rows."""
    x = sample.astype(np.float32)
    size = max(1, min(size, len(x)))
    centre = x[np.random.default_rng(seed).choice(len(x), size, replace=False)].copy()
    for _ in range(rounds):
        best = _nearest(x, centre)
        order = np.argsort(best, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
        centre[best[order][at]] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.r_[at, len(x)])[:, None]
    return centre


class Cells:
    """Cells of similar unit vectors: the centroids of one codebook, or pairs of a centroid and a centroid of residuals."""

    def __init__(self, sample: np.ndarray, wanted: int, seed: int = 7, flat: int = FLAT, level: bool = False):
        x = sample.astype(np.float32)
        first = wanted if wanted <= flat else int(np.ceil(np.sqrt(wanted)))
        # so few rows of the sample belong to each of very many centroids that two rounds settle them
        self.first = fit_codebook(x, first if wanted <= flat else min(first, LEAF), rounds=6 if first <= LEAF else 2, seed=seed)
        self.second = None
        if level and wanted <= flat:  # means of many rows are shorter and would draw still more of them
            self.first /= np.maximum(np.linalg.norm(self.first, axis=1, keepdims=True), 1e-6)
        if wanted > flat:
            self.second = fit_codebook(x - self.first[_nearest(x, self.first)], min(first, LEAF), seed=seed + 1)
            self.cross = self.first @ self.second.T
        self.count = len(self.first) * (1 if self.second is None else len(self.second))

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes): numbers of each row's nearest cells, the nearest first."""
        x, block = x.astype(np.float32), max(64, SCORES // len(self.first))
        return np.concatenate([self._nearest(x[i : i + block], probes) for i in range(0, max(1, len(x)), block)])

    def _nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        score = x @ self.first.T - (self.first**2).sum(axis=1) / 2
        if self.second is None:
            return self._best(score, min(probes, self.count))
        beam = min(len(self.first), max(4, probes))
        top = self._best(score, beam)
        # the score of a pair is x (a + b) - |a + b|^2 / 2, and so that of the parts less a b
        inner = x @ self.second.T - (self.second**2).sum(axis=1) / 2
        whole = np.take_along_axis(score, top, axis=1)[:, :, None] + inner[:, None, :] - self.cross[top]
        best = self._best(whole.reshape(len(x), -1), min(probes, whole[0].size))
        return np.take_along_axis(top, best // len(self.second), axis=1) * len(self.second) + best % len(self.second)

    @staticmethod
    def _best(score: np.ndarray, k: int) -> np.ndarray:
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def collision_threshold(lines: int, reach: float, recall: float) -> int:
    """The most collisions that a pair at the very radius still reaches with probability ``recall`` (normal quantile)."""
    p = 2 * NormalDist().cdf(reach) - 1
    return max(1, int(np.floor(lines * p - NormalDist().inv_cdf(recall) * np.sqrt(lines * p * (1 - p)) + 0.5)))


def sorted_prefixes(places: np.ndarray) -> np.ndarray:
    """The sorted array of one line as bit sets: row r holds the rows whose place on the line is below r. The members of a
    window are the exclusive or of the rows at its two ends."""
    one = np.zeros((PLACES + 1, -(-len(places) // 64)), np.uint64)
    row = np.arange(len(places))
    np.bitwise_or.at(one, (places + 1, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
    return np.bitwise_xor.accumulate(one, axis=0)


def neighbours_in_cell(ids: np.ndarray, x: np.ndarray, home: np.ndarray, asked: np.ndarray, lines: np.ndarray, k: int, least: np.ndarray, reach: float = 1.0, recall: float = 0.97, growth: float = 2.0, steps: int = 2, mutual: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src id, dst id, similarity): up to k partners of each asked row among the cell's home rows with a similarity of at
    least the row's own ``least``, best first, ties by lower id; with ``mutual`` what a visitor found is a partner for the
    home row, too. ``x`` holds unit vectors; an id may have several rows and is no partner of itself. With a single step in
    which every row is both home and asked, each two rows are counted once."""
    mine, queries = np.flatnonzero(home), np.flatnonzero(asked)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(mine) or not len(queries):
        return none
    low = collision_threshold(len(lines), reach, recall)
    h = x @ lines.T.astype(np.float64)
    y, own = x[mine], ids[mine]
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    radius = np.sqrt(np.maximum(0, 2 - 2 * least)).astype(np.float32)
    # places on a line in steps of 1 / STEP; windows are rounded outwards, so rounding loses nothing
    place = lambda v, up: np.clip((np.ceil if up else np.floor)(v * STEP) + PLACES // 2, 0, PLACES - 1 + up).astype(np.intp).T.copy()
    at = place(h[mine], 0)
    arrays = [sorted_prefixes(at[j]) for j in range(len(lines))] if len(mine) <= 32_768 else None
    once = mutual and steps == 1 and len(mine) == len(queries) == len(x)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [none]
    block, word = max(64, min(1024, PLANE // len(mine))), 0
    for start in range(0, len(queries), block):
        rows = queries[start : start + block]
        counter = SlicedCounter()
        before = None
        if once and ((start >> 6) - word) * 8 > (len(mine) >> 6) - word:
            # what comes before this block has already been compared with it; the arrays are cut now and then
            if arrays:
                arrays = [np.ascontiguousarray(a[:, (start >> 6) - word :]) for a in arrays]
            word = start >> 6
        y_left, own_left = y[word << 6 :], own[word << 6 :]
        for step in range(steps):
            width = (reach * radius[rows] / growth ** (steps - 1 - step))[:, None]
            left, right = place(h[rows] - width, 0), place(h[rows] + width, 1)
            for j in range(len(lines)):
                prefix = arrays[j] if arrays else np.ascontiguousarray(sorted_prefixes(at[j])[:, word:])
                inside = prefix.take(left[j], axis=0, mode="clip")
                inside ^= prefix.take(right[j], axis=0, mode="clip")
                if before:
                    inside ^= prefix.take(before[0][j], axis=0, mode="clip")
                    inside ^= prefix.take(before[1][j], axis=0, mode="clip")
                counter.add(inside)
            lanes = counter.exceeds(low - 1)
            q, p = np.nonzero(lanes)
            bit, lane = np.nonzero(np.unpackbits(lanes[q, p].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            q, p = q[bit], (p[bit] << 6) + lane
            if len(q) > len(rows) * len(own_left) / 64:  # so many are left that one product of matrices, nearly exact, goes first
                close = (x32[rows] @ y32[word << 6 :].T >= (least[rows, None] - 1e-4).astype(np.float32))[q, p]
                q, p = q[close], p[close]
            sim = np.concatenate([np.einsum("ij,ij->i", x[rows[q[i : i + 65_536]]], y_left[p[i : i + 65_536]]) for i in range(0, len(q), 65_536)] or [np.empty(0)])
            keep = (sim >= least[rows[q]]) & (ids[rows[q]] != own_left[p])
            q, p, sim = q[keep], p[keep], sim[keep]
            # a query is done at a narrow window once k partners lie within that window's own radius
            sure = np.bincount(q[sim >= 1 - (radius[rows[q]] / growth ** (steps - 1 - step)) ** 2 / 2], minlength=len(rows))
            done = np.ones(len(rows), bool) if step == steps - 1 else sure >= k
            keep = done[q]
            found.append((ids[rows[q[keep]]], own_left[p[keep]], sim[keep]))
            left_over = np.flatnonzero(~done)
            if not len(left_over):
                break
            rows, before = rows[left_over], (left[:, left_over], right[:, left_over])
            counter.keep(left_over)
    q, p, s = (np.concatenate(part) for part in zip(*found, strict=True))
    if mutual:
        q, p, s = np.r_[q, p], np.r_[p, q], np.r_[s, s]
    order = np.lexsort((-s, p, q))
    q, p, s = q[order], p[order], s[order]
    first = np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1])] if len(q) else np.empty(0, bool)
    q, p, s = q[first], p[first], s[first]
    order = np.lexsort((p, -s, q))
    q, p, s = q[order], p[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], p[top], s[top]


def _best(links: DataFrame, k: int) -> DataFrame:
    """(src_id, dst_id, sim, rank): the k best of each source; both steps share one shuffle by source."""
    best = links.repartition("src_id").groupBy("src_id", "dst_id").agg(F.max("sim").alias("sim"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("sim"), "dst_id"))).where(F.col("rank") <= k)


def _sample(rows: DataFrame, total: int, wanted: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of about ``wanted`` rows chosen by a hash of their ids, one row an id."""
    parts = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)) < int(np.ceil(parts * min(1.0, 1.2 * wanted / max(1, total))))).select("id", "vec").dropDuplicates(["id"]).limit(2 * wanted).toArrow()
    if not some.num_rows:
        return np.empty(0, np.int64), np.empty((0, dim))
    ids = some.column("id").to_numpy()
    order = np.argsort(mixed(ids.view(np.uint64)))[:wanted]
    return ids[order], _unit(some.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)[order]


def _search(rows: DataFrame, queries: DataFrame | None, total: int, dim: int, k: int, least: float, lines: int, cell_rows: int, probes: int | None, sample_rows: int, seed: int) -> DataFrame:
    """Links (src_id, dst_id, sim) of the rows among themselves, or of the queries among the rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    wanted = max(1, total // cell_rows)
    some_ids, some = _sample(rows, total, min(sample_rows, 32 * min(wanted, LEAF)), dim, seed)
    if not len(some):
        return spark.createDataFrame([], PAIRS)
    few, mutual = slice(0, 8192), queries is None
    cells = Cells(some, wanted, seed, SINGLE if mutual else FLAT, level=mutual)
    near = min(cells.count, probes if probes is not None else 3 * int(np.ceil(np.sqrt(cells.count))))
    # cells that hold far more than others are cut into chunks by rows; every two chunks meet in a task of their own
    crowd, rows_in = np.unique(cells.nearest(some, near if mutual else 1), return_counts=True)
    chunks = np.maximum(1, np.round(rows_in / len(some) * total / (8 * cell_rows))).astype(np.int64)
    crowd, chunks = crowd[chunks > 1], chunks[chunks > 1]
    bound = (some_ids[few], some[few].astype(np.float32)) if queries is not None else None
    shared = spark.sparkContext.broadcast((cells, crowd, chunks, bound))
    directions = np.random.default_rng(seed).standard_normal((lines, dim)).astype(np.float32)

    def least_of(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The k-th best similarity among the sampled ids: none of the k best of all rows is less similar."""
        known, some = shared.value[3]
        sim = x.astype(np.float32) @ some.T
        sim[ids[:, None] == known[None, :]] = -1
        return np.partition(sim, -k, axis=1)[:, -k].astype(np.float64) - 1e-5 if sim.shape[1] > k else np.full(len(ids), -1.0)

    def assign(as_home: bool, as_query: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, crowd, chunks, bound = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, kind = batch.column("id").to_numpy(), batch.column("class").to_numpy()
                once = np.unique(np.stack([ids, kind], 1), axis=0, return_index=True)[1]
                if len(once) < len(ids):  # a row repeated very often is sent on once a batch
                    batch, ids, kind = batch.take(pa.array(once)), ids[once], kind[once]
                values = np.ascontiguousarray(batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.float32)
                x = _unit(values, dim)
                floor = least_of(ids, x) if bound is not None and as_query else np.full(len(ids), least)
                at = cells.nearest(x, near if as_query else 1)
                row, cell = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
                times = np.ones(len(cell), np.int64)
                if len(crowd):
                    place = np.minimum(np.searchsorted(crowd, cell), len(crowd) - 1)
                    times = np.where(crowd[place] == cell, chunks[place], 1)
                own = (mixed(ids.view(np.uint64))[row] % times.astype(np.uint64)).astype(np.int64)
                entry = np.repeat(np.arange(len(row)), times)
                other = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
                mine = own[entry]
                if mutual:  # every two chunks meet once, the rows of the lower one ask
                    i, j = np.minimum(mine, other), np.maximum(mine, other)
                    home, asked = mine == j, mine == i
                else:  # a query meets the home rows of every chunk, a home row the queries of every chunk
                    i, j = (mine, other) if as_query else (other, mine)
                    home, asked = np.full(len(entry), as_home), np.full(len(entry), as_query)
                raw = values.tobytes()
                vec = [raw[a : a + 4 * dim] for a in range(0, len(raw), 4 * dim)]
                of = row[entry]
                yield pa.RecordBatch.from_arrays([pa.array(cell[entry]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(home), pa.array(asked), pa.array(ids[of]), pa.array(kind[of]), pa.array(floor[of]), pa.array([vec[a] for a in of], pa.binary())], names=["cell", "i", "j", "home", "asked", "id", "class", "least", "vec"])

        return each

    def search(group: pa.Table) -> pa.Table:
        ids, kind = group.column("id").to_numpy(), group.column("class").to_numpy()
        home, asked = (group.column(c).to_numpy(zero_copy_only=False) for c in ("home", "asked"))
        # an id's equal vectors count once; as they are in the same cells, a home row and a query may stand for each other
        _, first, same = np.unique(np.stack([ids, kind], 1), axis=0, return_index=True, return_inverse=True)
        is_home, is_asked = np.zeros(len(first), bool), np.zeros(len(first), bool)
        np.logical_or.at(is_home, same.ravel(), home)
        np.logical_or.at(is_asked, same.ravel(), asked)
        floor = np.full(len(first), -np.inf)
        np.maximum.at(floor, same.ravel(), group.column("least").to_numpy())
        held = group.column("vec").take(pa.array(first)).to_pylist()
        q, p, s = neighbours_in_cell(ids[first], _unit(np.frombuffer(b"".join(held), np.float32), dim), is_home, is_asked, directions, k, floor, steps=1 if mutual else 2, mutual=mutual)
        return pa.table({"src_id": pa.array(q, pa.int64()), "dst_id": pa.array(p, pa.int64()), "sim": pa.array(s, pa.float64())})

    form = "cell bigint, i int, j int, home boolean, asked boolean, id bigint, class bigint, least double, vec binary"
    sent = spread(rows).mapInArrow(assign(True, queries is None), form)
    if queries is not None:
        sent = sent.unionByName(spread(queries).mapInArrow(assign(False, True), form))
    return sent.groupBy("cell", "i", "j").applyInArrow(search, PAIRS)


def similar_vectors(vectors: DataFrame, id_col: str = "paper_id", vec_col: str = "embedding", dim: int = 128, k: int = 8, least: float = 0.8, lines: int = 48, cell_rows: int = 2000, probes: int = 4, sample_rows: int = 65_536, seed: int = 11) -> DataFrame:
    """(src_id, dst_id, sim, rank): for each id its k most similar other ids with cosine >= ``least``; ties by lower id.

    Approximate in which partners are found (windows and cells), exact in the similarity of those returned. Null, all-zero,
    non-finite vectors and those of another length are left out, repeated rows count once, the length of a vector is
    ignored, an empty table gives no rows, other columns are not read. Where one id has several different vectors the
    best similarity counts. Classes of equal vectors take part with their k + 1 lowest ids, which is exact: no more of
    them can be among the first k of anyone, and the others' first k are the k lowest ids of their own class.
    The cells are fitted on at most ``sample_rows`` rows; all rows are indexed, each in its ``probes`` nearest cells, so
    ``cell_rows`` rows a cell mean ``probes`` times as many in each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, dim)
    light = rows.select("id", "class").distinct()
    classes = light.groupBy("class").agg(F.count("*").alias("n"))
    total, large = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total < 2:
        return spark.createDataFrame([], PAIRS + ", rank int")
    excess_links = None
    if large > k + 1:
        salts = 32
        heads = light.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("place") <= k + 1)
        big = classes.where(F.col("n") > k + 1).select("class").join(heads, "class").groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("heads"))
        salted = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        excess = light.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["class", "salt"]).where(~F.array_contains("heads", F.col("id")))
        excess_links = excess.select(F.col("id").alias("src_id"), F.explode(F.slice("heads", 1, k)).alias("dst_id"), F.lit(1.0).alias("sim"))
        rows = rows.join(excess.select("id", "class"), ["id", "class"], "left_anti")
    links = _search(rows, None, total, dim, k, least, lines, cell_rows, probes, sample_rows, seed)
    return _best(links if excess_links is None else links.unionByName(excess_links), k)


def search_similar(queries: DataFrame, vectors: DataFrame, id_col: str = "paper_id", vec_col: str = "embedding", dim: int = 128, k: int = 8, lines: int = 48, cell_rows: int = 400, probes: int | None = None, sample_rows: int = 65_536, seed: int = 13) -> DataFrame:
    """(src_id, dst_id, sim, rank): for each query id its k most similar other ids at any similarity; ties by lower id.

    The index is that of ``similar_vectors``: every vector in its home cell. Without a least similarity a neighbour may be
    hardly nearer than the rest, so a query visits more cells, three times the square root of their number unless
    ``probes`` says otherwise. How far its windows reach follows from a bounded sample: the k-th best similarity among at
    most 8,192 distinct ids is a lower bound of the k-th best of all. Queries and vectors meet in a shuffle by cell;
    neither comes to the driver and none is broadcast but the sample. Unusable and repeated rows as in ``similar_vectors``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, dim)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], PAIRS + ", rank int")
    return _best(_search(rows, usable(queries, id_col, vec_col, dim), total, dim, k, -1.0, lines, cell_rows, probes, sample_rows, seed), k)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(paper_id_a, paper_id_b), a < b: every pair in which one is a neighbour of the other."""
    return neighbours.select(F.least("src_id", "dst_id").alias("paper_id_a"), F.greatest("src_id", "dst_id").alias("paper_id_b")).distinct()
