"""Clustering kernels: Gaussian mixtures by distributed EM, density clustering, graph communities, density validity."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .neighbors import _mat, _vec, distances, knn, met
from .trees import Space, spanning_tree, sparse_tree, tree_by_rows

#: Rows that a mixture's start is drawn from, at most; EM itself uses all rows.
START_ROWS = 20_000
COVARIANCES = ("full", "tied", "diag", "spherical")
#: Points of a block whose tree with another block is found in one step, and cells of a matrix of distances at most.
TREE_ROWS, CELLS = 4096, 1 << 17


def parameter_count(k: int, d: int, covariance: str) -> int:
    own = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[covariance]
    return own + k * d + k - 1


def _log_density(x: np.ndarray, model: dict) -> np.ndarray:
    """n x k log densities plus log weights."""
    d, out = x.shape[1], np.empty((len(x), len(model["weight"])))
    for k, (mean, root) in enumerate(zip(model["mean"], model["root"])):
        y = (x - mean) @ root  # root: Cholesky factor of the precision
        out[:, k] = math.log(max(model["weight"][k], 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + (y * y).sum(1)) + np.log(np.diag(root)).sum()
    return out


def _responsibility(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    ld = _log_density(x, model)
    top = ld.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(ld - top).sum(1))
    return np.exp(ld - total[:, None]), total


def _maximise(n: np.ndarray, s: np.ndarray, ss: np.ndarray, covariance: str, reg: float) -> dict:
    """Weights, means and precision roots from summed responsibilities, first and second moments."""
    k, d = s.shape
    count = n + 10 * np.finfo(float).eps
    mean = s / count[:, None]
    cov = ss / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    if covariance == "tied":
        cov = np.repeat((ss.sum(0) - (mean * count[:, None]).T @ mean)[None] / n.sum(), k, 0)
    elif covariance == "diag":
        cov = cov * np.eye(d)
    elif covariance == "spherical":
        cov = np.eye(d) * np.trace(cov, axis1=1, axis2=2)[:, None, None] / d
    root = np.empty_like(cov)
    for j in range(k):
        c = (cov[j] + cov[j].T) / 2 + reg * np.eye(d)
        root[j] = np.linalg.inv(np.linalg.cholesky(c)).T
    return {"weight": count / count.sum(), "mean": mean, "root": root}


def _kmeans_start(x: np.ndarray, k: int, covariance: str, reg: float, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d2 = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=d2 / d2.sum())] if d2.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(25):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(x) * k * x.shape[1] < 5e7 else np.concatenate([((p[:, None] - c[None]) ** 2).sum(2).argmin(1) for p in np.array_split(x, 64)])
        c = np.array([x[own == j].mean(0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
    one = np.eye(k)[own]
    return _maximise(one.sum(0), one.T @ x, np.einsum("nk,ni,nj->kij", one, x, x, optimize=True), covariance, reg)


def fit_mixtures(df: DataFrame, configs: list[dict], id_col: str = "vec_id", vec_col: str = "vec", max_iter: int = 100, tol: float = 1e-3) -> list[dict]:
    """The best of n_init runs for each of configs {k, covariance, reg, n_init, seed}, with log_likelihood, converged, n_iter, bic and aic.

    All runs of all configurations advance in the same passes: each partition sums the responsibilities' moments of every run, and one task
    turns the sums into new parameters, whose size depends on the configurations alone.
    """
    for c in configs:
        if c.get("covariance", "full") not in COVARIANCES or c["k"] < 1:
            raise ValueError("bad mixture configuration")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).persist()
    runs = [(i, t) for i, c in enumerate(configs) for t in range(c.get("n_init", 1))]

    def start(batches):
        x = np.array([v for b in batches for v in b.column(1).to_pylist()])
        for i, t in runs:
            c = configs[i]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(((i, t), _kmeans_start(x, c["k"], c.get("covariance", "full"), c.get("reg", 1e-6), c.get("seed", 42) + t)))])], ["m"])

    sample = rows.orderBy(F.xxhash64("id")).limit(START_ROWS).coalesce(1)
    models = dict(pickle.loads(bytes(r["m"])) for r in sample.mapInArrow(start, "m binary").collect())
    state = {r: {"last": -math.inf, "iter": 0, "converged": False} for r in runs}
    live = list(runs)
    final: dict = {}
    while live:
        now = {r: models[r] for r in live}

        def expect(batches, now=now):
            sums: dict = {}
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64)
                if not len(x):
                    continue
                for r, m in now.items():
                    p, total = _responsibility(x, m)
                    got = (len(x), total.sum(), p.sum(0), p.T @ x, np.stack([(x * p[:, [j]]).T @ x for j in range(p.shape[1])]))
                    sums[r] = tuple(u + v for u, v in zip(sums[r], got)) if r in sums else got
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)])], ["s"])

        def step(batches):
            sums: dict = {}
            for b in batches:
                for raw in b.column(0).to_pylist():
                    for r, got in pickle.loads(raw).items():
                        sums[r] = tuple(u + v for u, v in zip(sums[r], got)) if r in sums else got
            out = {r: (n, ll, _maximise(nk, s, ss, configs[r[0]].get("covariance", "full"), configs[r[0]].get("reg", 1e-6))) for r, (n, ll, nk, s, ss) in sums.items()}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)])], ["s"])

        got = pickle.loads(bytes(rows.mapInArrow(expect, "s binary").coalesce(1).mapInArrow(step, "s binary").first()["s"]))
        for r in list(live):
            n, ll, model = got[r]
            s = state[r]
            s["iter"] += 1
            gain, s["last"] = ll / n - s["last"], ll / n
            s["converged"] = bool(abs(gain) < tol)
            final[r] = (n, ll, models[r])
            models[r] = model
            if s["converged"] or s["iter"] >= max_iter:
                live.remove(r)
    out = []
    for i, c in enumerate(configs):
        best = max((r for r in runs if r[0] == i), key=lambda r: final[r][1])
        n, ll, model = final[best]
        p = parameter_count(c["k"], model["mean"].shape[1], c.get("covariance", "full"))
        out.append({**c, "model": model, "n": n, "log_likelihood": float(ll), "bic": float(p * math.log(n) - 2 * ll), "aic": float(2 * p - 2 * ll), "converged": state[best]["converged"], "n_iter": state[best]["iter"]})
    rows.unpersist()
    return out


def assign_mixture(df: DataFrame, model: dict, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """(id, label, prob)."""

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64)
            p = _responsibility(x, model)[0] if len(x) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.argmax(1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))], [id_col, "label", "prob"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"{id_col} long, label int, prob array<double>")


def condensed_labels(tree: np.ndarray, n: int, min_size: int, allow_single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(labels, strengths) by excess of mass over the hierarchy of a spanning tree; -1 is noise.

    Edges of equal weight part a cluster at once, so that labels follow from the points, whichever of the equal trees is given.
    """
    order = np.argsort(tree[:, 2], kind="stable")
    parent, size, kids, height = list(range(n)), [1] * n, {}, {}
    top, least = list(range(n)), list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, w in tree[order]:
        ra, rb = find(int(a)), find(int(b))
        node = len(size)
        kids[node], height[node] = (top[ra], top[rb]), w
        size.append(size[top[ra]] + size[top[rb]])
        least.append(min(least[top[ra]], least[top[rb]]))
        parent[rb] = ra
        top[ra] = node
    root = len(size) - 1

    def leaves(node):
        stack, out = [node], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v]
        return out

    lam = lambda w: 1 / w if w > 0 else math.inf
    # Clusters of the condensed tree: birth, the points that leave at which density, and child clusters.
    birth, left, child = {0: 0.0}, {0: []}, {0: []}
    stack = [(root, 0)]
    while stack:
        node, c = stack.pop()
        while node >= n:
            parts, same = [], [node]
            while same:
                v = same.pop()
                if v >= n and height[v] == height[node]:
                    same += kids[v]
                else:
                    parts.append(v)
            level = lam(height[node])
            big = sorted((v for v in parts if size[v] >= min_size), key=least.__getitem__)
            for v in parts:
                if size[v] < min_size:
                    left[c] += [(p, level) for p in leaves(v)]
            if len(big) > 1:
                for v in big:
                    new = len(birth)
                    birth[new], left[new], child[new] = level, [], []
                    child[c].append(new)
                    stack.append((v, new))
                break
            if not big:
                break
            node = big[0]
        else:
            left[c].append((node, lam(0)))
    peak = {}
    total = {}
    for c in sorted(birth, reverse=True):
        total[c] = len(left[c]) + sum(total[k] for k in child[c])
    finite = [v for c in left for _, v in left[c] if math.isfinite(v)]
    cap = max(finite, default=1.0)
    stable = {}
    for c in birth:
        stable[c] = sum(min(v, cap) - birth[c] for _, v in left[c]) + sum((birth[k] - birth[c]) * total[k] for k in child[c])
    chosen = {}
    for c in sorted(birth, reverse=True):
        below = sum(stable[k] for k in child[c])
        if c == 0 and not allow_single or child[c] and below > stable[c]:
            chosen[c], stable[c] = False, below
        else:
            chosen[c] = True
    labels, strength = np.full(n, -1), np.zeros(n)
    stack, number = [0], 0
    while stack:
        c = stack.pop(0)
        if not chosen[c]:
            stack += child[c]
            continue
        points, inner = [], [c]
        while inner:
            v = inner.pop()
            points += left[v]
            inner += child[v]
        peak = max((min(v, cap) for _, v in points), default=1.0)
        for p, v in points:
            labels[p], strength[p] = number, min(v, cap) / peak if peak > 0 else 1.0
        number += 1
    return labels, strength


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of vectors, without Python numbers in between."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks] or [np.zeros(0)])
    return flat.reshape(table.num_rows, -1)


def density_clusters(
    df: DataFrame, min_cluster_size: int = 10, min_samples: int = 5, id_col: str = "vec_id", vec_col: str = "vec", metric: str = "euclidean", count_self: bool = False, by: str | None = None
) -> DataFrame:
    """([by,] id, label, strength) by core distances and a tree per group.

    count_self takes the point itself as its first neighbour. Groups (configurations, seeds) run side by side, one task each, which
    holds a group's points but never its pairs. Without groups, neighbours and trees are found by blocks in all tasks, and one task
    holds the edges of these trees.
    """
    steps = min_samples - 1 if count_self else min_samples
    if by is None:
        rows = cut(df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col)))
        edges = tree_candidates(rows, steps, id_col, vec_col, metric)
        every = edges.unionByName(rows.select(F.col(id_col).alias("a"), F.col(id_col).alias("b"), F.lit(0.0).alias("weight")))

        def label(table):
            a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
            ids, real = np.unique(a[a == b]), a != b
            a, b = np.searchsorted(ids, a[real]), np.searchsorted(ids, b[real])
            labels, strength = condensed_labels(sparse_tree(a, b, w[real], len(ids)), len(ids), min_cluster_size) if len(ids) > 1 else (np.full(len(ids), -1), np.zeros(len(ids)))
            return pa.table({id_col: ids, "label": labels.astype(np.int32), "strength": strength})

        return every.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(label, f"{id_col} long, label int, strength double")

    def fit(key, table):
        order = np.argsort(table.column(id_col).to_numpy(), kind="stable")
        ids = table.column(id_col).to_numpy()[order]
        x = _matrix(table, vec_col)[order]
        n = len(x)
        if n < 2:
            labels, strength = np.full(n, -1), np.zeros(n)
        else:
            core = Space(x, metric).core(min(steps, n - 1))
            labels, strength = condensed_labels(spanning_tree(x, core, metric), n, min_cluster_size)
        return pa.table({by: pa.array([key[0].as_py()] * n, table.schema.field(by).type), id_col: ids, "label": labels.astype(np.int32), "strength": strength})

    kind = df.schema[by].dataType.simpleString()
    rows = df.select(by, F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col))
    return rows.groupBy(by).applyInArrow(fit, f"{by} {kind}, {id_col} long, label int, strength double")


def tree_candidates(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vec", metric: str = "euclidean", rows: int = TREE_ROWS) -> DataFrame:
    """(a, b, weight), a < b: edges of mutual reachability that hold the spanning tree of all points.

    Each pair of blocks has a tree of its own. An edge that such a tree leaves out closes a cycle of earlier edges, so the tree of all leaves it out too.
    """
    core = F.lit(0.0)
    if k > 0:
        df = df.join(knn(df, k, id_col, vec_col, metric).groupBy(F.col("i").alias(id_col)).agg(F.max("dist").alias("core")), id_col, "left")
        core = F.coalesce("core", F.lit(0.0))
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, math.ceil(df.count() / rows))))
    got = df.select(block.alias("block"), F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), core.alias("core")).alias("item")).groupBy("block").agg(F.collect_list("item").alias("items"))
    b = got.select("block", *[F.col(f"items.{c}").alias(c) for c in ("id", "vec", "core")])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sides = [0] if batch.column(0)[r] == batch.column(4)[r] else [0, 4]
                ids, core = (np.concatenate([_vec(batch.column(s + c)[r]) for s in sides]) for c in (1, 3))
                x = np.concatenate([_mat(batch.column(s + 2)[r]) for s in sides])
                order = np.argsort(ids, kind="stable")
                ids, tree = ids[order], spanning_tree(x[order], core[order], metric)
                yield pa.RecordBatch.from_arrays([pa.array(ids[tree[:, 0].astype(np.int64)]), pa.array(ids[tree[:, 1].astype(np.int64)]), pa.array(tree[:, 2])], ["a", "b", "weight"])

    return met(b, b).where("q_block <= block").mapInArrow(run, "a long, b long, weight double").distinct()


def core_distances(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(i, core): distance to the k-th neighbour, self not counted."""
    return knn(df, k, id_col, vec_col).where(F.col("rank") == k).select("i", F.col("dist").alias("core"))


def _spread(p: np.ndarray) -> np.ndarray:
    """Each point's mean of the inverse distances to all others, to the power of the dimension, as a distance."""
    n, d = p.shape
    out = np.zeros(n)
    for s in range(0, n, max(1, CELLS // n)):
        dist = distances(p[s : s + max(1, CELLS // n)], p, "euclidean")
        inverse = np.divide(1.0, dist, out=np.zeros_like(dist), where=dist > 0)
        high = inverse.max(1)
        inverse /= np.where(high > 0, high, 1)[:, None]
        np.power(inverse, d, out=inverse)
        some = high > 0
        out[s : s + len(dist)][some] = 1 / high[some] * (inverse.sum(1)[some] / (n - 1)) ** (-1 / d)
    return out


def density_validity(x: np.ndarray, labels: np.ndarray) -> float:
    """Density-based validity: per cluster (separation - sparseness) / max, weighted by size over all points, noise included."""
    names = [c for c in np.unique(labels) if c != -1]
    if len(names) < 2:
        return math.nan
    points = x[labels != -1]
    place = np.searchsorted(names, labels[labels != -1])
    core, sparse = np.zeros(len(points)), np.zeros(len(names))
    for c in range(len(names)):
        mine = place == c
        p = points[mine]
        if len(p) < 2:
            continue
        core[mine] = _spread(p)
        tree = tree_by_rows(p, core[mine])  # which of equal trees matters here
        degree = np.bincount(tree[:, :2].astype(int).ravel(), minlength=len(p))
        own = (degree[tree[:, 0].astype(int)] > 1) & (degree[tree[:, 1].astype(int)] > 1)
        sparse[c] = float(tree[own, 2].max() if own.any() else tree[:, 2].max())
    apart = Space(points).ways_out(core, place)[2]
    top = np.maximum(apart, sparse)
    return float((np.bincount(place) / len(x) * np.where(top > 0, (apart - sparse) / np.where(top > 0, top, 1), 0.0)).sum())


def communities(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, resolution: float = 1.0, kind: str = "RBConfiguration", rounds: int = 2, seed: int = 42) -> np.ndarray:
    """Leiden's local moves, refinement and aggregation; labels by size, largest first."""
    if kind not in ("RBConfiguration", "CPM", "Modularity"):
        raise ValueError(f"unknown partition type {kind}")
    g = 1.0 if kind == "Modularity" else resolution
    rng = np.random.default_rng(seed)

    def lists(s, t, w, m):
        out = [[] for _ in range(m)]
        for a, b, v in zip(s.tolist(), t.tolist(), w.tolist()):
            out[a].append((b, v))
            if a != b:
                out[b].append((a, v))
        return out

    def local(near, strength, total, label, allowed=None):
        mass = {}
        for v, c in enumerate(label):
            mass[c] = mass.get(c, 0.0) + strength[v]
        queue, waiting = rng.permutation(len(label)).tolist(), set(range(len(label)))
        at = 0
        while at < len(queue):
            v = queue[at]
            at += 1
            waiting.discard(v)
            link = {}
            for u, w in near[v]:
                if u != v and (allowed is None or allowed[u] == allowed[v]):
                    link[label[u]] = link.get(label[u], 0.0) + w
            own = label[v]
            mass[own] -= strength[v]
            score = lambda c: link.get(c, 0.0) - g * strength[v] * mass.get(c, 0.0) / total  # noqa: B023, E731
            best, top = own, score(own)
            for c in link:
                if score(c) > top + 1e-12:
                    best, top = c, score(c)
            mass[best] = mass.get(best, 0.0) + strength[v]
            if best != own:
                label[v] = best
                for u, _ in near[v]:
                    if label[u] != best and u not in waiting:
                        waiting.add(u)
                        queue.append(u)
        return label

    best = np.arange(n)
    for _ in range(max(1, rounds)):
        s, t, w, m = src, dst, weight, n
        member, label = np.arange(n), None
        size = np.ones(n)
        label = np.unique(best, return_inverse=True)[1].tolist()
        while True:
            near = lists(s, t, w, m)
            if kind == "CPM":
                strength, total = size.tolist(), 1.0
            else:
                strength = (np.bincount(s, w, m) + np.bincount(t, w, m)).tolist()
                total = max(2 * float(w.sum()), 1e-300)
            before = len(set(label))
            label = local(near, strength, total, label)
            fine = np.unique(local(near, strength, total, list(range(m)), label), return_inverse=True)[1]
            coarse = np.array(label)
            best = coarse[member]
            k = int(fine.max()) + 1
            if k == m or len(set(label)) == m and before == m:
                break
            up = np.zeros(k, np.int64)
            up[fine] = coarse
            a, b = np.minimum(fine[s], fine[t]), np.maximum(fine[s], fine[t])
            pair, inverse = np.unique(a * k + b, return_inverse=True)
            s, t, w = pair // k, pair % k, np.bincount(inverse, w)
            size = np.bincount(fine, size, k)
            member, m = fine[member], k
            label = np.unique(up, return_inverse=True)[1].tolist()
    names, inverse, counts = np.unique(best, return_inverse=True, return_counts=True)
    place = np.empty(len(names), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(names))
    return place[inverse]


def graph_communities(edges: DataFrame, configs: list[dict]) -> DataFrame:
    """(config, id, label) for each of configs {resolution, kind, rounds, seed} over one edge table; each runs in a task of its own."""
    return communities_of(edges.crossJoin(F.broadcast(edges.sparkSession.range(len(configs)).select(F.col("id").cast("int").alias("config")))), configs)


def communities_of(rows: DataFrame, configs: list[dict]) -> DataFrame:
    """The same of edges that name their configuration (config), so that different graphs run side by side too."""

    def fit(key, table):
        number = key[0].as_py()
        src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        order = np.lexsort((dst, src))
        ids = np.unique(np.concatenate([src, dst]))
        label = communities(np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order]), w[order], len(ids), **configs[number])
        return pa.table({"config": np.full(len(ids), number, np.int32), "id": ids, "label": label.astype(np.int32)})

    return rows.groupBy("config").applyInArrow(fit, "config int, id long, label int")
