"""Parameter searches and pipelines: grids as tables, fits side by side, votes in SQL.

The density search draws its trials by their history; the others take a grid whole, or a seeded sample of it without replacement where it is larger than
the number of trials.
"""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import projection as P
from ..operators import selection as S
from ..operators.durable import cut


def combos(**axes) -> list[dict]:
    return [dict(zip(axes, v)) for v in itertools.product(*axes.values())]


def trials_of(space: list[dict], n_trials: int, seed: int = 42) -> list[dict]:
    """The whole space, or n_trials of it drawn by the seed."""
    return space if len(space) <= n_trials else random.Random(seed).sample(space, n_trials)


class HistorySampler:
    """Trials of a finite space, one after another, led by the values of earlier ones (larger is better).

    The first `startup` trials are random. Then the history is parted into its best share and the rest; of the configurations not
    tried yet, the one is taken whose choices are likeliest among the best against the rest, each axis counted on its own
    and smoothed by one. Equal ones are drawn by the seed, so a search can be repeated.
    """

    def __init__(self, space: list[dict], seed: int = 42, startup: int = 10, best: float = 0.25):
        self.left, self.startup, self.best = list(space), startup, best
        self.axes = {k: sorted({c[k] for c in space}, key=repr) for c in space[:1] for k in c}
        self.random = random.Random(seed)
        self.history: list[tuple[dict, float]] = []

    def ask(self) -> dict | None:
        if not self.left:
            return None
        return self.left.pop(self.random.randrange(len(self.left)) if len(self.history) < self.startup else self._likeliest())

    def tell(self, config: dict, value: float | None) -> None:
        self.history.append((config, -math.inf if value is None or math.isnan(value) else value))

    def _likeliest(self) -> int:
        ranked = sorted(self.history, key=lambda h: -h[1])
        n = max(1, math.ceil(self.best * len(ranked)))
        share = []
        for part in (ranked[:n], ranked[n:]):
            counts = {k: {v: 1.0 for v in values} for k, values in self.axes.items()}
            for config, _ in part:
                for k in counts:
                    counts[k][config[k]] += 1
            share.append({k: {v: c / (len(part) + len(own)) for v, c in own.items()} for k, own in counts.items()})
        score = [sum(math.log(share[0][k][c[k]] / share[1][k][c[k]]) for k in self.axes) for c in self.left]
        top = max(score)
        return self.random.choice([i for i, s in enumerate(score) if s > top - 1e-12])


class GridSampler(HistorySampler):
    """The whole space, or a seeded sample of it, in order; values are not used."""

    def __init__(self, space: list[dict], n_trials: int, seed: int = 42):
        super().__init__(trials_of(space, n_trials, seed), seed)

    def ask(self) -> dict | None:
        return self.left.pop(0) if self.left else None


def sampler_of(kind: str, space: list[dict], n_trials: int, seed: int = 42) -> HistorySampler:
    if kind not in ("history", "grid"):
        raise ValueError(f"unknown sampler {kind}")
    return HistorySampler(space, seed) if kind == "history" else GridSampler(space, n_trials, seed)


def grid(spark: SparkSession, **axes) -> DataFrame:
    rows = [(i, *c.values()) for i, c in enumerate(combos(**axes))]
    return spark.createDataFrame(rows, ["config_no", *axes])


def feasible(configs: DataFrame, n: int, spread: float = 1.0) -> DataFrame:
    """Configurations that n samples allow; others are passed over."""
    return configs.where((F.col("n_neighbors") >= 2) & (F.col("n_neighbors") < n) & (F.col("min_dist") >= 0) & (F.col("min_dist") <= spread) & (F.col("n_components") >= 1) & (F.col("n_components") < n))


def max_clusters(n: int) -> int:
    return min(12, max(4, math.ceil(math.log2(n))))


def cluster_bounds(n: int) -> tuple[int, int]:
    """(least, most) clusters that are looked for among n samples."""
    most = max_clusters(n)
    return round(most / 2) + 1, most


def embedded(df: DataFrame, variance: float = 0.95) -> DataFrame:
    """Standardised and reduced to the components that explain `variance`: (vec_id, vec)."""
    scaled = P.standardized(df).persist()
    return P.project(scaled, P.principal_components(scaled, variance, "vec"), vec_col="vec")


def search_manifold(df: DataFrame, space: list[dict], ks=(5, 10), epochs: int = 100, vec_col: str = "vec", weights: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(trial table with votes, layouts): neighbour preservation of each feasible configuration, ranked by weighted votes."""
    n = df.count()
    space = [c for c in space if 2 <= c["n_neighbors"] < n and 0 <= c["min_dist"] <= c.get("spread", 1.0) and 1 <= c["n_components"] < n]
    if not space:
        raise ValueError("no feasible configuration")
    df = cut(df.select("vec_id", vec_col))
    metric_of, most = [c.get("metric", "euclidean") for c in space], {}
    for c, metric in zip(space, metric_of):
        most[metric] = max(most.get(metric, max(ks)), c["n_neighbors"])
    # Neighbours are found once per metric, for the layouts and for what they keep of them.
    near = {metric: cut(N.knn(df, k, vec_col=vec_col, metric=metric)) for metric, k in (most | {"euclidean": most.get("euclidean", max(ks))}).items()}
    layouts = cut(P.manifold(df, space, vec_col=vec_col, epochs=epochs, near=near))
    high = df.select("vec_id", F.col(vec_col).alias("embedding"))
    rows = None
    # Layouts of one metric hold the same vectors, and meet in the same passes.
    for metric in most:
        own = [i for i, m in enumerate(metric_of) if m == metric]
        lows = [layouts.where(F.col("config") == i).select("vec_id", F.col("vec").alias("embedding")) for i in own]
        kept = M.neighbor_preservations(high, lows, ks, near=near["euclidean"])
        kept = cut(kept.groupBy("which").agg(*[F.avg(x).alias(x) for x in ("trustworthiness", "continuity", "qnn", "lcmc", "auc_lcmc")]))
        for w, i in enumerate(own):
            m = kept.where(F.col("which") == w).drop("which").withColumn("config_no", F.lit(i))
            for k, v in space[i].items():
                m = m.withColumn(f"umap_{k}", F.lit(v))
            rows = m if rows is None else rows.unionByName(m)
    rows = rows.withColumn("valid_solution", F.col("trustworthiness").isNotNull())
    return S.vote(rows, weights), layouts


def search_mixtures(df: DataFrame, ks, covariances=C.COVARIANCES, regs=(1e-6,), n_init: int = 2, max_iter: int = 50, min_size: int | None = None, penalty_weight: float = 1.0, vec_col: str = "vec") -> tuple[DataFrame, list[dict]]:
    """(trial table by selection score, fits): BIC per sample plus a penalty for small components."""
    n = df.count()
    space = [c for c in combos(k=list(ks), covariance=list(covariances), reg=list(regs)) if 1 <= c["k"] < n]
    fits = C.fit_mixtures(df, [{**c, "n_init": n_init} for c in space], vec_col=vec_col, max_iter=max_iter)
    least = S.adaptive_min_size(n) if min_size is None else min_size
    spark = df.sparkSession
    sizes = None
    for i, f in enumerate(fits):
        p = S.size_penalty(C.assign_mixture(df, f["model"], vec_col=vec_col), f["k"], least).withColumn("config_no", F.lit(i))
        sizes = p if sizes is None else sizes.unionByName(p)
    rows = [(i, f["k"], f["covariance"], f["reg"], f["bic"], f["aic"], f["bic"] / f["n"], f["converged"], f["n_iter"]) for i, f in enumerate(fits)]
    trials = spark.createDataFrame(rows, "config_no int, n_components int, covariance_type string, reg_covar double, bic double, aic double, bic_per_sample double, converged boolean, n_iter int")
    out = trials.join(sizes, "config_no").withColumn("selection_score", F.col("bic_per_sample") + penalty_weight * F.col("penalty"))
    return out.orderBy("selection_score", "bic", "config_no"), fits


def search_communities(df: DataFrame, neighbors=(15, 20), resolutions=(0.6, 1.0), kind: str = "RBConfiguration", bounds=(4, 10), min_size: int = 10, n_trials: int = 50, vec_col: str = "vec") -> DataFrame:
    """Trials over neighbours and resolution with their measures, ranked by normalised votes."""
    space = trials_of(combos(n_neighbors=list(neighbors), resolution=list(resolutions)), n_trials)
    rows, missing = None, -(2**31)
    df = cut(df)
    # Neighbours are found once, for the largest graph; the others are parts of it.
    near = cut(N.knn(df, max(c["n_neighbors"] for c in space), vec_col=vec_col))
    edges = {k: cut(N.edges_of(near.where(F.col("rank") <= k))) for k in sorted({c["n_neighbors"] for c in space})}
    named = None
    for i, c in enumerate(space):
        own = edges[c["n_neighbors"]].withColumn("config", F.lit(i))
        named = own if named is None else named.unionByName(own)
    labels = cut(C.communities_of(named, [{"resolution": c["resolution"], "kind": kind, "seed": 42 + i} for i, c in enumerate(space)]))
    wide, names = df, [f"_l{i}" for i in range(len(space))]
    for i, name in enumerate(names):
        wide = wide.join(labels.where(F.col("config") == i).select(F.col("id").alias("vec_id"), F.col("label").alias(name)), "vec_id", "left")
    wide = wide.withColumns({x: F.coalesce(x, F.lit(missing)) for x in names})
    compact = cut(M.silhouettes(wide, names, missing, vec_col=vec_col).groupBy("which").agg(F.avg("silhouette").alias("silhouette")))
    for i, c in enumerate(space):
        part = labels.where(F.col("config") == i).select("id", "label")
        both = df.join(part, F.col("vec_id") == F.col("id"))
        s = compact.where(F.col("which") == i).agg(F.max("silhouette").alias("silhouette"))
        sizes = part.groupBy("label").count().agg(F.count("*").cast("int").alias("n_clusters"), F.min("count").alias("min_size"))
        q = M.graph_quality(edges[c["n_neighbors"]], part, c["resolution"]).select(F.col("rb" if kind == "RBConfiguration" else "cpm" if kind == "CPM" else "modularity").alias("quality"))
        r = s.crossJoin(M.davies_bouldin(both, vec_col)).crossJoin(M.calinski_harabasz(both, vec_col)).crossJoin(sizes).crossJoin(q)
        r = cut(r.withColumns({"trial_number": F.lit(i), "n_neighbors": F.lit(c["n_neighbors"]), "resolution": F.lit(c["resolution"])}))
        rows = r if rows is None else rows.unionByName(r)
    valid = F.col("n_clusters").between(*bounds) & (F.col("min_size") >= min_size) & S.finite("silhouette")
    return S.select_graph_trial(rows.withColumn("valid_solution", F.coalesce(valid, F.lit(False))))


def stable_density_runs(layouts: DataFrame, seeds: list[int], min_cluster_size: int, min_samples: int, bounds=(2, 12), max_noise: float = 0.33) -> tuple[DataFrame, DataFrame]:
    """(records, run labels) of one density clustering per seed over layouts (config, vec_id, vec); config is the seed's place."""
    labels = cut(C.density_clusters(layouts, min_cluster_size, min_samples, by="config"))

    def validity(key, table):
        v = C.density_validity(C._matrix(table, "vec"), table.column("label").to_numpy())
        return pa.table({"config": pa.array([key[0].as_py()], pa.int32()), "dbcv": pa.array([None if math.isnan(v) else v], pa.float64())})

    scores = layouts.join(labels, ["config", "vec_id"]).select("config", "vec", "label").groupBy("config").applyInArrow(validity, "config int, dbcv double")
    named = layouts.sparkSession.createDataFrame(list(enumerate(seeds)), "config int, seed int")
    runs = labels.join(F.broadcast(named), "config").select("seed", "vec_id", "label")
    records = S.clusters_and_noise(runs, ("seed",)).join(scores.join(F.broadcast(named), "config").select("seed", "dbcv"), "seed", "left")
    records = records.withColumn("reason", S.seed_validity(bounds[0], bounds[1], max_noise))
    return records.withColumn("valid", F.col("reason") == "ok"), runs


def evaluate_density_config(df: DataFrame, config: dict, seeds: list[int], min_cluster_size: int, min_samples: int, epochs: int = 100, vec_col: str = "vec", **limits) -> DataFrame:
    """One row: aggregates over the valid seeds, the modal number of clusters, and the runs' mean agreement."""
    layouts = cut(P.manifold(df, [{**config, "seed": s} for s in seeds], vec_col=vec_col, epochs=epochs))
    records, runs = stable_density_runs(layouts, seeds, min_cluster_size, min_samples, **limits)
    records = cut(records)
    good = runs.join(records.where("valid").select("seed"), "seed", "left_semi")
    modal = S.modal_count(records).select(F.col("mode").alias("modal_clusters"), F.col("ratio").alias("modal_ratio"))
    out = S.seed_aggregates(records).crossJoin(modal).crossJoin(M.stability_summary(M.agreement(good)))
    return out.withColumn("value", 0.7 * F.col("mean_dbcv") + 0.3 * F.col("mean_ari"))


def evaluate_pipeline(df: DataFrame, name: str, variance: float = 0.95, n_neighbors: int = 15, min_dist: float = 0.1, n_components: int = 5, min_cluster_size: int = 10, min_samples: int = 5, seed: int = 42, epochs: int = 100) -> DataFrame:
    """One comparison row: standardise, reduce, lay out, cluster by density, and measure what isn't noise."""
    return evaluate_pipelines(df, [(name, variance)], n_neighbors, min_dist, n_components, min_cluster_size, min_samples, seed, epochs)


def evaluate_pipelines(df: DataFrame, named: list[tuple[str, float]], n_neighbors: int = 15, min_dist: float = 0.1, n_components: int = 5, min_cluster_size: int = 10, min_samples: int = 5, seed: int = 42, epochs: int = 100) -> DataFrame:
    """The same for several (name, variance), a row each; their layouts and clusterings run side by side."""
    scaled = cut(P.standardized(df))
    config = {"n_neighbors": n_neighbors, "min_dist": min_dist, "n_components": n_components, "seed": seed}
    edges = None
    for i, (_, variance) in enumerate(named):
        reduced = cut(P.project(scaled, P.principal_components(scaled, variance, "vec"), vec_col="vec"))
        own = P.graphs(reduced, [config], vec_col="vec").withColumn("config", F.lit(i))
        edges = own if edges is None else edges.unionByName(own)
    layouts = cut(P.layouts_of(edges, [config] * len(named), epochs=epochs))
    labels = cut(C.density_clusters(layouts, min_cluster_size, min_samples, count_self=True, by="config"))
    clear, sizes, out = cut(layouts.join(labels.where("label <> -1"), ["config", "vec_id"])), S.clusters_and_noise(labels, ("config",)), None
    for i, (name, _) in enumerate(named):
        c = sizes.where(F.col("config") == i)
        s = M.silhouette_samples(clear.where(F.col("config") == i), vec_col="vec").agg(F.avg("silhouette").alias("silhouette"))
        row = c.crossJoin(s).select(F.lit(name).alias("name"), "n_clusters", "noise_ratio", F.when(F.col("n_clusters") >= 2, F.col("silhouette")).alias("silhouette"))
        out = row if out is None else out.unionByName(row)
    return out


def coordinates(df: DataFrame) -> DataFrame:
    """Plot data: vec_id, x, y and the label's name and colour."""
    name, colour = S.label_style()
    return df.select("vec_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), "label", name, colour)




def search_density(df: DataFrame, space: list[dict], seeds: list[int], n_trials: int = 50, epochs: int = 100, vec_col: str = "vec", bounds=(6, 12), max_noise: float = 0.33, min_valid: float = 0.8, min_common: float = 0.2, min_modal: float = 0.7, weights=(0.7, 0.3), sampler: str = "history") -> tuple[DataFrame, dict | None]:
    """(trial table, best): layouts and density clusterings of each configuration over all seeds, and the chosen run.

    space holds {n_neighbors, n_components, min_dist, min_cluster_size, min_samples}. Layouts are shared by configurations that
    differ in the clustering alone. sampler: "history" leads trials by earlier values, "grid" takes the space or a seeded sample of it. A trial fails for the first reason that applies, else its value is the weighted sum of mean
    validity and mean agreement. The best trial's runs are walked in the order of their agreement with the others, and the
    first valid one is chosen; best has its configuration, seed, labels, recovery in the other valid runs, and layout.
    """
    draw = sampler_of(sampler, space, n_trials)
    df = cut(df)
    shared: dict[tuple, DataFrame] = {}
    rows, kept = None, []
    for i in range(min(n_trials, len(space))):
        c = draw.ask()
        key = (c["n_neighbors"], c["n_components"], c.get("min_dist", 0.0))
        if key not in shared:
            configs = [{"n_neighbors": key[0], "n_components": key[1], "min_dist": key[2], "seed": s} for s in seeds]
            shared[key] = cut(P.manifold(df, configs, vec_col=vec_col, epochs=epochs))
        records, runs = stable_density_runs(shared[key], seeds, c["min_cluster_size"], c["min_samples"], bounds, max_noise)
        records = cut(records)
        pairs = cut(M.agreement(runs.join(records.where("valid").select("seed"), "seed", "left_semi")))
        kept.append((c, key, records, runs, pairs))
        modal = S.modal_count(records).select(F.col("mode").alias("modal_clusters"), F.col("ratio").alias("modal_ratio"))
        row = S.seed_aggregates(records).crossJoin(modal).crossJoin(M.stability_summary(pairs))
        # One written row per trial: the plan of the table is a union of short scans, however many trials there are.
        row = row.withColumns({"trial_number": F.lit(i), **{k: F.lit(v) for k, v in c.items()}}).withColumn("reason", S.config_validity(min_valid, min_common, min_modal))
        row = cut(row.withColumn("value", F.when(F.col("reason") == "ok", weights[0] * F.col("mean_dbcv") + weights[1] * F.col("mean_ari")).otherwise(-10.0)))
        draw.tell(c, row.first()["value"])
        rows = row if rows is None else rows.unionByName(row)
    top = rows.where("reason = 'ok'").orderBy(F.desc("value"), "trial_number").first()
    if top is None:
        return rows, None
    c, key, records, runs, pairs = kept[top["trial_number"]]
    order = [r["seed"] for r in M.medoid_ranking(pairs).orderBy("medoid_rank").collect()]  # one row per seed
    valid = {r["seed"] for r in records.where("valid").collect()}
    seed = next((s for s in order if s in valid), min(valid))
    others = runs.where(F.col("seed").isin(*valid))
    layout = shared[key].where(F.col("config") == seeds.index(seed)).select("vec_id", "vec")
    return rows, {"config": c, "seed": seed, "labels": runs.where(F.col("seed") == seed).select("vec_id", "label"), "recovery": M.cluster_recovery(others, seed), "layout": layout}
