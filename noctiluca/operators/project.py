"""Two-dimensional maps of vectors: principal components, and a neighbour-graph layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.session import cut, spread


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of (id, vec). Each task adds up its rows; the sums of the tasks are added by place on the
    executors, so dim x dim + dim + 1 numbers come to the driver whatever the number of tasks."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_list()).astype(np.float64)
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        yield pd.DataFrame({"place": np.arange(1 + dim + dim * dim), "value": np.r_[n, total, square.ravel()]})

    added = vectors.select("vec").mapInPandas(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(1 + dim + dim * dim)
    sums[added["place"].to_numpy()] = added["value"].to_numpy()
    n, total, square = int(sums[0]), sums[1 : dim + 1], sums[dim + 1 :].reshape(dim, dim)
    mean = total / max(n, 1)
    return n, mean, square / max(n, 1) - np.outer(mean, mean)


def covariances(vectors: DataFrame, dim: int) -> DataFrame:
    """(i, j, covariance) for i <= j, of (id, vec): what the principal components are made from."""
    _, _, cov = moments(vectors, dim)
    i, j = np.triu_indices(dim)
    return vectors.sparkSession.createDataFrame(pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "covariance": cov[i, j]}))


def principal_axes(vectors: DataFrame, dim: int, count: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the directions of largest variance; the sign makes each axis' largest entry positive."""
    _, mean, cov = moments(vectors, dim)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:count]]
    return mean, axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(count)])


def pca_map(vectors: DataFrame, dim: int = 128) -> DataFrame:
    """(id, x, y) by principal components; exact for any number of rows."""
    mean, axes = principal_axes(vectors, dim)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xy = (np.stack(b["vec"].to_list()) - mean) @ axes if len(b) else np.empty((0, 2))
            yield pd.DataFrame({"id": b["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return vectors.select("id", "vec").mapInPandas(place, "id bigint, x double, y double")


def _curve(min_dist: float) -> tuple[float, float]:
    """a, b for which 1 / (1 + a d^2b) follows exp(-(d - min_dist)) beyond min_dist, by least squares on a grid."""
    d = np.linspace(0, 3, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist)))
    best = min(((np.sum((1 / (1 + a * d ** (2 * b)) - want) ** 2), a, b) for a in np.linspace(0.5, 3, 51) for b in np.linspace(0.5, 1.5, 41)), key=lambda t: t[0])
    return best[1], best[2]


def _smooth(dist: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the distance to the nearest neighbour and the width at which the memberships sum to log2(neighbours)."""
    rho = dist[:, 0].copy()
    lo, hi = np.zeros(len(dist)), np.full(len(dist), np.inf)
    sigma, want = np.ones(len(dist)), np.log2(max(2, neighbours))
    for _ in range(64):
        total = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
        high = total > want
        hi, lo = np.where(high, sigma, hi), np.where(high, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    return rho, np.maximum(sigma, 1e-3 * dist.mean())


def layout(x: np.ndarray, start: np.ndarray, neighbours: int = schema.UMAP_NEIGHBOURS, min_dist: float = schema.UMAP_MIN_DIST, rounds: int = 200, seed: int = schema.SEED) -> np.ndarray:
    """Positions of unit vectors: fuzzy neighbour graph (union a + b - ab), then attraction along edges and repulsion from
    random points, after the published method (arXiv:1802.03426)."""
    n = len(x)
    if n <= 1:
        return np.zeros((n, 2))
    k = min(neighbours, max(2, n - 1), n - 1)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for at in range(0, n, 1024):
        d = 1 - x[at : at + 1024] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist[at : at + 1024] = np.take_along_axis(d, near[at : at + 1024], axis=1)
    return arrange(near, np.maximum(dist, 0), start, min_dist, rounds, seed)


def arrange(near: np.ndarray, dist: np.ndarray, start: np.ndarray, min_dist: float = schema.UMAP_MIN_DIST, rounds: int = 200, seed: int = schema.SEED) -> np.ndarray:
    """Positions from every row's neighbours, nearest first, and their distances; a place without a neighbour is -1."""
    n, k = near.shape
    rho, sigma = _smooth(dist, k + 1)
    weight = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None])
    some = near.ravel() >= 0
    a, b, w = np.repeat(np.arange(n), k)[some], near.ravel()[some].astype(np.int64), weight.ravel()[some]
    edges, at = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
    there, back = np.bincount(at[: len(w)], w, len(edges)), np.bincount(at[len(w) :], w, len(edges))
    a, b = np.divmod(edges, n)
    w = there + back - there * back
    del edges, at, there, back
    rng = np.random.default_rng(seed)
    scale = np.abs(start - start.mean(axis=0)).max() or 1.0
    y = 10 * (start - start.mean(axis=0)) / scale + rng.normal(0, 1e-4, (n, 2))
    ca, cb = _curve(min_dist)
    for t in range(rounds):
        step = 1.0 - t / rounds
        use = rng.random(len(w)) < w
        i, j = a[use], b[use]
        d = y[i] - y[j]
        r = np.maximum((d * d).sum(axis=1), 1e-12)
        pull = (-2 * ca * cb * r ** (cb - 1)) / (1 + ca * r**cb)
        move = np.clip(pull[:, None] * d, -4, 4)
        for c in range(2):
            y[:, c] += step * (np.bincount(i, move[:, c], n) - np.bincount(j, move[:, c], n))
        other = rng.integers(0, n, len(i))
        d = y[i] - y[other]
        r = (d * d).sum(axis=1)
        push = (2 * cb) / ((0.001 + r) * (1 + ca * r**cb))
        away = np.clip(np.where(other != i, push, 0)[:, None] * d, -4, 4)
        for c in range(2):
            y[:, c] += step * np.bincount(i, away[:, c], n)
    return y


def neighbour_graph(rows: DataFrame, total: int, dim: int, k: int, seed: int = schema.SEED, cell_rows: int = 1000, probes: int = 3, most_cells: int = 4096) -> DataFrame:
    """(src, dst, sim): for every one of the ``total`` rows (id, vec of floats, distinct by id) its k most similar others.

    Rows go to cells of similar vectors (spherical k-means, fitted on a bounded sample, every row assigned), each to its
    home cell and as a visitor to the next nearest ones, and are compared there with all rows at home. Approximate in
    which neighbours are found, exact in their similarity.
    """

    def unit(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    cells = int(min(most_cells, max(1, total // cell_rows)))
    x = unit(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(32 * cells).select("vec").toArrow().column("vec").combine_chunks())
    centre = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(6):
        best = np.argmax(x @ centre.T, axis=1)
        for c in np.unique(best):
            mean = x[best == c].sum(axis=0)
            centre[c] = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else centre[c]
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        near = min(probes, len(centre))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column("vec"))
                top = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :near]
                row = np.repeat(np.arange(len(x)), near)
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near) == 0, len(x))), batch.column("id").take(pa.array(row)), pa.array([raw[i] for i in row], pa.binary())], names=["cell", "home", "id", "vec"])

    def search(group: pa.Table) -> pa.Table:
        ids, home = group.column("id").to_numpy(), np.flatnonzero(group.column("home").to_numpy(zero_copy_only=False))
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(ids[:0], ids[:0], x[:0, 0])]
        m = min(k, len(home))
        for at in range(0, len(ids) if m else 0, 1024):
            sim = x[at : at + 1024] @ x[home].T
            sim[ids[at : at + 1024, None] == ids[home][None, :]] = -np.inf
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            best = np.take_along_axis(sim, top, axis=1).ravel()
            keep = best > -np.inf
            out.append((np.repeat(ids[at : at + 1024], m)[keep], ids[home][top.ravel()][keep], best[keep]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("src", "dst", "sim"))})

    found = spread(rows).mapInArrow(assign, "cell int, home boolean, id bigint, vec binary").groupBy("cell").applyInArrow(search, "src bigint, dst bigint, sim float")
    by = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def umap_map(vectors: DataFrame, dim: int = 128, anchors: int = 5000, neighbours: int = schema.UMAP_NEIGHBOURS, seed: int = schema.SEED) -> DataFrame:
    """(id, x, y): every row is in the neighbour graph and is laid out. Up to ``anchors`` rows the graph is made from all
    pairs; beyond, it is found by a distributed search over cells. The driver lays the graph out; its memory and time grow
    with the rows (neighbours, distances and positions, never the vectors)."""
    spark = vectors.sparkSession
    total = vectors.select("id").distinct().count()
    if total == 0:
        return spark.createDataFrame([], "id bigint, x double, y double")
    if total <= anchors:
        some = vectors.select("id", "vec").dropDuplicates(["id"]).orderBy("id").toPandas()
        ids, x = some["id"].to_numpy(), np.stack(some["vec"].to_list()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        mean, axes = principal_axes(vectors.dropDuplicates(["id"]), dim)
        y = layout(x, (x - mean) @ axes, neighbours, seed=seed)
    else:
        rows = cut(vectors.select("id", F.col("vec").cast("array<float>").alias("vec")).dropDuplicates(["id"]))
        first = pca_map(rows, dim).toArrow()
        order = np.argsort(first.column("id").to_numpy())
        ids = first.column("id").to_numpy()[order]
        start = np.stack([first.column(c).to_numpy()[order] for c in ("x", "y")], 1)
        k = min(neighbours, total - 1)
        near, dist = np.full((total, k), -1, np.int32), np.full((total, k), 2.0, np.float32)
        edges = neighbour_graph(rows, total, dim, k, seed).select("src", "dst", "rank", "sim").toArrow()
        row, place = np.searchsorted(ids, edges.column("src").to_numpy()), edges.column("rank").to_numpy() - 1
        near[row, place] = np.searchsorted(ids, edges.column("dst").to_numpy())
        dist[row, place] = np.maximum(1 - edges.column("sim").to_numpy(), 0)
        del edges, row, place
        y = arrange(near, dist, start, seed=seed)
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "x": y[:, 0], "y": y[:, 1]}))
