"""Standardisation, principal components and a uniform-manifold layout."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import knn


def standardized(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): each feature less its mean over its population deviation; constant features keep scale 1."""
    long = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    per = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = per.agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("st"))
    scaled = F.zip_with(F.col(vec_col).cast("array<double>"), F.col("st"), lambda x, s: (x - s["m"]) / s["s"])
    return df.crossJoin(F.broadcast(one)).select(F.col(id_col).alias(id_col), scaled.alias("vec"))  # one row of a mean and deviation per feature


def _rows(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix, without Python numbers in between."""
    if column.null_count or not len(column):
        return np.array(column.to_pylist(), np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(n, total, products): one row of sums per partition, from which covariances add up."""

    def run(batches):
        n, s, p = 0, None, None
        for batch in batches:
            x = _rows(batch.column(0))
            if not len(x):
                continue
            s = x.sum(0) if s is None else s + x.sum(0)
            p = x.T @ x if p is None else p + x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], ["n", "total", "products"])

    return df.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "n long, total array<double>, products array<double>")


def covariance(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(a, b, cov): population covariance of each pair of features a <= b."""
    parts = moments(df, vec_col)
    n = parts.agg(F.sum("n").alias("n"))
    s = parts.select(F.posexplode("total").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    p = parts.select(F.posexplode("products").alias("pos", "x"), F.size("total").alias("d")).groupBy("pos", "d").agg(F.sum("x").alias("p"))
    p = p.withColumns({"a": F.floor(F.col("pos") / F.col("d")).cast("int"), "b": (F.col("pos") % F.col("d")).cast("int")}).where("a <= b")
    sa, sb = s.select(F.col("pos").alias("a"), F.col("x").alias("xa")), s.select(F.col("pos").alias("b"), F.col("x").alias("xb"))
    out = p.join(F.broadcast(sa), "a").join(F.broadcast(sb), "b").crossJoin(F.broadcast(n))
    return out.select("a", "b", (F.col("p") / F.col("n") - F.col("xa") * F.col("xb") / F.col("n") / F.col("n")).alias("cov"))


def principal_components(df: DataFrame, variance: float = 0.95, vec_col: str = "embedding") -> dict:
    """Mean, loadings (k x d), and explained ratios: the smallest k whose ratios sum to more than `variance`.

    Sums come from all rows; one task decomposes the d x d covariance. Signs make each largest loading positive.
    """

    def solve(batches):
        n, s, p = 0, 0, 0
        for batch in batches:
            for c, t, q in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, s, p = n + c, s + np.array(t), p + np.array(q)
        if not n:
            return
        mean = s / n
        cov = p.reshape(len(mean), -1) / n - np.outer(mean, mean)
        value, vector = np.linalg.eigh(cov)
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
        ratio = value / value.sum() if value.sum() > 0 else np.zeros_like(value)
        k = min(len(value), int(np.searchsorted(np.cumsum(ratio), variance, "right")) + 1)
        vector *= np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)])[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([mean.tolist()]), pa.array([vector[:k].tolist()]), pa.array([ratio[:k].tolist()])], ["mean", "loadings", "ratio"])

    row = moments(df, vec_col).coalesce(1).mapInArrow(solve, "mean array<double>, loadings array<array<double>>, ratio array<double>").first()
    return {"mean": np.array(row["mean"]), "loadings": np.array(row["loadings"]), "ratio": np.array(row["ratio"])}


def project(df: DataFrame, model: dict, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): centred vectors on the loadings."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(1))
            y = (x - model["mean"]) @ model["loadings"].T if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1], np.ascontiguousarray(y).ravel())], [id_col, "vec"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"{id_col} long, vec array<double>")


def smooth_weights(near: DataFrame) -> DataFrame:
    """(i, j, p): membership exp(-(d - rho) / sigma), rho the nearest positive distance and sigma such that a row sums to log2 k."""

    def solve(batches):
        for batch in batches:
            ids, lists, dists = (batch.column(c) for c in ("i", "j", "dist"))
            sizes = np.diff(lists.offsets.to_numpy())
            owner, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.inf)
            d[owner, place] = dists.flatten().to_numpy(zero_copy_only=False)
            rho = np.where(d > 0, d, np.inf).min(1)
            rho = np.where(np.isfinite(rho), rho, 0.0)
            over = np.maximum(0.0, d - rho[:, None])
            lo, hi, want = np.zeros(len(sizes)), np.full(len(sizes), np.inf), np.log2(np.maximum(2, sizes))
            sigma = np.ones(len(sizes))
            for _ in range(64):
                got = np.exp(-over / sigma[:, None]).sum(1)
                settled, high = np.abs(got - want) < 1e-9, got > want
                lo, hi = np.where(high, lo, sigma), np.where(high, sigma, hi)
                sigma = np.where(settled, sigma, np.where(np.isfinite(hi), (lo + np.where(np.isfinite(hi), hi, 0)) / 2, sigma * 2))
            mean = np.bincount(owner, d[owner, place], len(sizes)) / np.maximum(1, sizes)
            sigma = np.maximum(np.maximum(sigma, 1e-3 * mean), 1e-12)
            p = np.exp(-over[owner, place] / sigma[owner])
            yield pa.RecordBatch.from_arrays([pa.array(ids.to_numpy(zero_copy_only=False)[owner]), pa.array(lists.flatten()), pa.array(p)], ["i", "j", "p"])

    rows = near.groupBy("i").agg(F.collect_list(F.struct("j", "dist")).alias("near"))  # at most k neighbours a row
    return rows.select("i", F.col("near.j").alias("j"), F.col("near.dist").alias("dist")).mapInArrow(solve, "i long, j long, p double")


def fuzzy_union(directed: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: p + q - p q of both directions."""
    e = directed.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.when(F.col("i") < F.col("j"), F.col("p")).alias("p"), F.when(F.col("i") > F.col("j"), F.col("p")).alias("q"))
    e = e.groupBy("src", "dst").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"), F.coalesce(F.max("q"), F.lit(0.0)).alias("q"))
    return e.select("src", "dst", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b), fitted by least squares to a plateau up to min_dist with an exponential tail."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, damp = 1.0, 1.0, 1e-2
    for _ in range(200):
        u = x ** (2 * b)
        f = 1 / (1 + a * u)
        r = y - f
        ja, jb = -f * f * u, -f * f * a * u * 2 * np.log(x)
        h = np.array([[ja @ ja + damp, ja @ jb], [ja @ jb, jb @ jb + damp]])
        g = np.array([ja @ r, jb @ r])
        det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
        step = np.array([h[1, 1] * g[0] - h[0, 1] * g[1], h[0, 0] * g[1] - h[0, 1] * g[0]]) / det
        na, nb = max(1e-3, a + step[0]), max(1e-2, b + step[1])
        better = ((y - 1 / (1 + na * x ** (2 * nb))) ** 2).sum() < (r**2).sum()
        a, b, damp = (na, nb, damp / 3) if better else (a, b, damp * 5)
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def _connected(src: np.ndarray, dst: np.ndarray, n: int) -> bool:
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, src, label[dst])
        np.minimum.at(low, dst, label[src])
        low = low[low]
        if (low == label).all():
            return bool((label == 0).all())
        label = low


def spectral_start(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, dims: int, rng: np.random.Generator, rounds: int = 400) -> np.ndarray | None:
    """The leading eigenvectors after the first of the normalised graph, by subspace iteration over its edges; none if it is not connected."""
    if n <= dims + 1 or not _connected(src, dst, n):
        return None
    degree = np.maximum(np.bincount(src, weight, n) + np.bincount(dst, weight, n), 1e-12)
    w, first = weight / np.sqrt(degree[src] * degree[dst]), np.sqrt(degree / degree.sum())
    v = rng.normal(size=(n, min(n - 1, dims + 4)))

    def across(v):
        out = np.empty((v.shape[1], n))
        for c, own in enumerate(np.ascontiguousarray(v.T)):
            out[c] = np.bincount(src, w * own[dst], n) + np.bincount(dst, w * own[src], n)
        return np.ascontiguousarray(out.T)

    for k in range(rounds):
        moved = v + across(v)  # of the graph plus one, so that the largest eigenvalues lead
        moved -= np.outer(first, first @ moved)
        new = np.linalg.qr(moved)[0]
        settled = k % 10 == 9 and np.linalg.svd(new[:, :dims].T @ v[:, :dims], compute_uv=False).min() > 1 - 1e-10
        v = new
        if settled:
            break
    image = across(v)
    value, turn = np.linalg.eigh(v.T @ image)
    return (v @ turn)[:, ::-1][:, :dims]


def _layout(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, dims: int, min_dist: float, seed: int, epochs: int, spread: float, init: str = "spectral") -> np.ndarray:
    """Spectral start (random on request, or where the graph falls apart) and stochastic descent of the cross-entropy; epochs are vectorised over edges."""
    if init not in ("spectral", "random"):
        raise ValueError(f"unknown init {init}")
    rng, n = np.random.default_rng(seed), len(ids)
    y = rng.uniform(-10, 10, (n, dims))
    start = spectral_start(src, dst, weight, n, dims, rng) if init == "spectral" else None
    if start is not None:
        y = start * (10 / np.abs(start).max()) + rng.normal(0, 1e-4, (n, dims))
    a, b = curve(min_dist, spread)
    keep = weight >= weight.max() / epochs
    i, j = np.concatenate([src[keep], dst[keep]]), np.concatenate([dst[keep], src[keep]])
    rate = np.tile(weight[keep] / weight.max(), 2)
    for e in range(epochs):
        take = rng.random(len(i)) < rate
        p, q, alpha = i[take], j[take], 1 - e / epochs
        delta = y[p] - y[q]
        d2 = (delta**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * d2 ** np.where(d2 > 0, b - 1, 0) / (1 + a * d2**b), 0.0)
        move = np.clip(pull[:, None] * delta, -4, 4) * alpha
        step = np.zeros_like(y)
        np.add.at(step, p, move)
        np.add.at(step, q, -move)
        for _ in range(5):
            r = rng.integers(0, n, len(p))
            delta = y[p] - y[r]
            d2 = (delta**2).sum(1)
            push = np.where(r != p, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)
            np.add.at(step, p, np.clip(push[:, None] * delta, -4, 4) * alpha)
        count = np.maximum(1.0, np.bincount(p, minlength=n) / 4)
        y = y + step / np.sqrt(count)[:, None]
    return y


def manifold(
    df: DataFrame, configs: list[dict], id_col: str = "vec_id", vec_col: str = "embedding", epochs: int = 200, near: dict[str, DataFrame] | None = None
) -> DataFrame:
    """(config, id, vec) for each of configs {n_neighbors, min_dist, n_components, metric, seed, spread, init}.

    Neighbours are found once per metric, for the largest n_neighbors (near: those of a metric, if they are known), and memberships are shared by configurations of
    equal n_neighbors; layouts run side by side, one task each.
    """
    return layouts_of(graphs(df, configs, id_col, vec_col, near), configs, id_col, epochs)


def graphs(df: DataFrame, configs: list[dict], id_col: str = "vec_id", vec_col: str = "embedding", near: dict[str, DataFrame] | None = None) -> DataFrame:
    """(src, dst, weight, config): the fuzzy graph of each configuration."""
    out, near = None, dict(near or {})
    shared: dict[tuple, DataFrame] = {}
    for number, c in enumerate(configs):
        key = (c.get("n_neighbors", 15), c.get("metric", "euclidean"))
        if key[1] not in near:
            most = max(d.get("n_neighbors", 15) for d in configs if d.get("metric", "euclidean") == key[1])
            near[key[1]] = knn(df, most, id_col, vec_col, key[1]).persist()
        if key not in shared:
            shared[key] = fuzzy_union(smooth_weights(near[key[1]].where(F.col("rank") <= key[0]))).persist()
        edges = shared[key].withColumn("config", F.lit(number))
        out = edges if out is None else out.unionByName(edges)
    return out


def layouts_of(rows: DataFrame, configs: list[dict], id_col: str = "vec_id", epochs: int = 200) -> DataFrame:
    """(config, id, vec) of graphs that name their configuration; each is laid out in a task of its own, so none waits for another."""

    def fit(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        number, src, dst, weight = (table.column(c).to_numpy() for c in ("config", "src", "dst", "weight"))
        del held, table  # a layout needs the memory
        order = np.lexsort((dst, src, number))
        number, src, dst, weight = number[order], src[order], dst[order], weight[order]
        del order
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        parts = list(zip(number[starts].tolist(), *(np.split(x, starts[1:]) for x in (src, dst, weight))))
        del number, src, dst, weight
        while parts:
            number, src, dst, weight = parts.pop(0)
            c = configs[number]
            ids = np.unique(np.concatenate([src, dst]))
            y = _layout(ids, np.searchsorted(ids, src), np.searchsorted(ids, dst), weight, c.get("n_components", 2), c.get("min_dist", 0.1), c.get("seed", 42), epochs, c.get("spread", 1.0), c.get("init", "spectral"))
            vec = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * y.shape[1], y.ravel())
            yield from pa.table({"config": np.full(len(ids), number, np.int32), id_col: ids, "vec": vec}).to_batches()

    alone = rows.select("config", "src", "dst", "weight").repartitionById(len(configs), F.col("config"))
    return alone.mapInArrow(fit, f"config int, {id_col} long, vec array<double>")
