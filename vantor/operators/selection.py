"""Ranking, voting and validity rules over trial tables, runs and memberships."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Default votes of the neighbour measures, and of the graph-clustering measures (True: larger is better). Fixed values.
UMAP_WEIGHTS = {"trustworthiness": 0.30, "continuity": 0.30, "qnn": 0.20, "lcmc": 0.10, "auc_lcmc": 0.10}
GRAPH_WEIGHTS = {"silhouette": (0.40, True), "davies_bouldin": (0.30, False), "calinski_harabasz": (0.20, True), "quality": (0.10, True)}


def finite(col: str) -> Column:
    return F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) < float("inf"))


def voting_weights(override: dict | None = None, defaults: dict = UMAP_WEIGHTS) -> dict:
    """Defaults, or defaults with overrides normalised to sum 1; unknown names and useless sums are errors."""
    if override is None:
        return dict(defaults)
    if unknown := set(override) - set(defaults):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    merged = defaults | override
    if any(w < 0 for w in merged.values()) or sum(merged.values()) <= 0:
        raise ValueError("weights must be at least 0 and sum to more than 0")
    return {k: w / sum(merged.values()) for k, w in merged.items()}


def average_rank(col: str, ascending: bool = True, partition: tuple = ()) -> Column:
    """Rank from 1 with ties sharing their mean, as a window expression."""
    w = Window.partitionBy(*partition)
    order = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, col))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2.0


def normalized_rank(col: str, ascending: bool = True, partition: tuple = ()) -> Column:
    """Average rank scaled to 0..1; a single row has 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return F.when(n <= 1, 0.0).otherwise((average_rank(col, ascending, partition) - 1) / (n - 1))


def vote(trials: DataFrame, weights: dict | None = None, key: str = "config_no") -> DataFrame:
    """Valid trials get the weighted sum of their ranks per metric (larger is better); all are ordered valid first, then by score."""
    weights = voting_weights(weights)
    good = trials.where("valid_solution")
    for m in weights:
        good = good.withColumn(f"rank_{m}", average_rank(m, ascending=False))
    score = sum((F.col(f"rank_{m}") * w for m, w in weights.items()), F.lit(0.0))
    good = good.withColumn("final_rank_score", score).select(key, "final_rank_score", *[f"rank_{m}" for m in weights])
    out = trials.join(good, key, "left")
    w = Window.orderBy(F.desc("valid_solution"), F.col("final_rank_score").asc_nulls_last(), key)
    return out.withColumn("place", F.row_number().over(w))


def select_graph_trial(trials: DataFrame, weights: dict | None = None, key: str = "trial_number") -> DataFrame:
    """Valid trials with all weighted metrics finite, by weighted normalised rank; (..., selection_score, rank_selection)."""
    weights = weights or GRAPH_WEIGHTS
    keep = F.col("valid_solution")
    for m in weights:
        keep &= finite(m)
    good = trials.where(keep)
    score = sum((normalized_rank(m, not up) * w for m, (w, up) in weights.items()), F.lit(0.0))
    good = good.withColumn("selection_score", score)
    return good.withColumn("rank_selection", F.row_number().over(Window.orderBy("selection_score", key)))


def seed_validity(min_clusters: int, max_clusters: int, max_noise: float) -> Column:
    """The first failing check of a run, or ok. The reasons are fixed values."""
    bad = F.col("dbcv").isNull() | F.isnan("dbcv")
    return (
        F.when(F.col("n_clusters") < min_clusters, "too_few_clusters")
        .when(F.col("n_clusters") > max_clusters, "too_many_clusters")
        .when(F.col("noise_ratio") > max_noise, "too_much_noise")
        .when(bad, "dbcv_not_available")
        .otherwise("ok")
    )


def config_validity(min_valid: float, min_common: float, min_modal: float) -> Column:
    """The first failing check of a configuration, or ok. The reasons are fixed values."""

    def gone(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    return (
        F.when(F.col("min_samples") > F.col("min_cluster_size"), "min_samples_exceeds_min_cluster_size")
        .when(F.col("valid_seed_ratio") < min_valid, "too_few_valid_seeds")
        .when(gone("mean_dbcv"), "mean_dbcv_not_available")
        .when(gone("mean_ari"), "mean_ari_valid_not_available")
        .when(gone("mean_common_ratio"), "mean_common_clustered_ratio_not_available")
        .when(F.col("mean_common_ratio") < min_common, "too_few_common_clustered_points")
        .when(gone("modal_ratio"), "modal_cluster_ratio_not_available")
        .when(F.col("modal_ratio") < min_modal, "weak_modal_cluster_count")
        .otherwise("ok")
    )


def clusters_and_noise(labels: DataFrame, by: tuple = ()) -> DataFrame:
    noise = F.col("label") == -1
    return labels.groupBy(*by).agg(F.count_distinct(F.when(~noise, F.col("label"))).alias("n_clusters"), F.avg(noise.cast("double")).alias("noise_ratio"))


def seed_aggregates(runs: DataFrame) -> DataFrame:
    """Means over valid runs; the valid share counts all runs, failed ones too."""
    ok = F.col("valid")
    return runs.agg(
        F.avg(F.when(ok, F.col("dbcv"))).alias("mean_dbcv"), F.stddev_pop(F.when(ok, F.col("dbcv"))).alias("std_dbcv"), F.avg(F.when(ok, F.col("n_clusters"))).alias("mean_clusters"),
        F.avg(F.when(ok, F.col("noise_ratio"))).alias("mean_noise"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("valid_seed_ratio"),
    )


def modal_count(runs: DataFrame, only_valid: bool = True) -> DataFrame:
    """(mode, ratio, n_runs) of n_clusters; ties go to the value met first by seed order."""
    runs = runs.where("valid") if only_valid else runs
    per = runs.groupBy("n_clusters").agg(F.count("*").alias("c"), F.min("seed").alias("first"))
    return per.agg(F.min_by("n_clusters", F.struct(-F.col("c"), F.col("first"))).alias("mode"), (F.max("c") / F.sum("c")).alias("ratio"), F.sum("c").alias("n_runs"))


def adaptive_min_size(n: int, absolute: int = 5, fraction: float = 0.01) -> int:
    """Least cluster size of n samples."""
    return int(max(absolute, math.ceil(math.sqrt(n)), math.ceil(fraction * n)))


def size_penalty(labels: DataFrame, k: int, min_size: int) -> DataFrame:
    """Squared relative shortfalls of all k components, empty ones included."""
    sizes = labels.sparkSession.range(k).select(F.col("id").alias("label")).join(labels.groupBy("label").agg(F.count("*").alias("c")), "label", "left").na.fill(0, ["c"])
    m, c = F.lit(float(min_size)), F.col("c")
    short = F.greatest(F.lit(0.0), m - c) / F.greatest(m, F.lit(1.0))
    small = c < min_size
    return sizes.agg(
        F.sum(short * short).alias("penalty"), F.count_if(small).alias("n_small"), F.sum(F.when(small, c).otherwise(0)).alias("small_samples"),
        (F.sum(F.when(small, c).otherwise(0)) / F.sum(c)).alias("small_ratio"), (F.count_if(small) == 0).alias("valid_size"),
    )


def membership_summary(members: DataFrame) -> DataFrame:
    """count, mean, median, min, max of the strength per cluster, noise left out."""
    p = F.col("strength")
    return members.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"))


def assigned_probability(prob: str = "prob", label: str = "label") -> Column:
    """Probability of the assigned cluster; noise has 0."""
    return F.when(F.col(label) == -1, 0.0).otherwise(F.element_at(F.col(prob), (F.col(label) + 1).cast("int")))


def confidence(members: DataFrame) -> DataFrame:
    top = F.array_max("prob")
    h = V.normalized_entropy(F.col("prob"))
    shares = [F.avg((top < t).cast("double")).alias(f"below_{int(t * 10)}") for t in (0.5, 0.6, 0.7, 0.8)]
    return members.agg(
        F.avg(top).alias("mean_max"), F.median(top).alias("median_max"), F.min(top).alias("min_max"), F.max(top).alias("max_max"), *shares,
        F.avg(h).alias("mean_entropy"), F.median(h).alias("median_entropy"), F.max(h).alias("max_entropy"),
    )


def top_samples(members: DataFrame, x: int, include_noise: bool = False) -> DataFrame:
    """The x strongest samples of each cluster with their place, noise last or left out."""
    if x < 1:
        raise ValueError("x must be at least 1")
    members = members if include_noise else members.where("label <> -1")
    w = Window.partitionBy("label").orderBy(F.desc("strength"), "vec_id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= x)


def contact_sheet(members: DataFrame, max_cols: int = 8, thumb: int = 180, pad: int = 20, title: int = 50, caption: int = 25) -> DataFrame:
    """(label, vec_id, row, col, x, y): grid of all members of each cluster in id order."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    cols = F.least(F.lit(max_cols), F.count(F.lit(1)).over(Window.partitionBy("label"))).cast("int")
    out = members.select("label", "vec_id", k.alias("k"), cols.alias("cols"))
    row, col = F.floor(F.col("k") / F.col("cols")).cast("int"), (F.col("k") % F.col("cols")).cast("int")
    return out.select("label", "vec_id", row.alias("row"), col.alias("col"), (pad + col * (thumb + pad)).alias("x"), (title + row * (thumb + caption + pad)).alias("y"))


def label_style(col: str = "label") -> list[Column]:
    """(name, colour index of 20, -1 for noise): clusters are coloured by their place among the sorted labels."""
    noise = F.col(col) == -1
    order = F.dense_rank().over(Window.orderBy(noise, col)) - 1
    return [F.when(noise, "Noise").otherwise(F.concat(F.lit("Cluster "), F.col(col).cast("string"))).alias("name"), F.when(noise, -1).otherwise(order % 20).cast("int").alias("colour")]


def split_counts(n: int, train: float, valid: float, rest: str = "remainder") -> list[int]:
    """Sizes of train, valid and test: floored shares of n, and what is left by largest remainder, ties in that order, or all of it to "test"."""
    if rest not in ("remainder", "test"):
        raise ValueError(f"unknown rest {rest}")
    if rest == "test":
        # Shares as they are written: a product of floats can lie just below a whole number.
        first = [math.floor(n * Fraction(str(s))) for s in (train, valid)]
        return [*first, n - sum(first)]
    wanted = [n * s for s in (train, valid, 1 - train - valid)]
    counts = [math.floor(w) for w in wanted]
    for i in sorted(range(3), key=lambda i: -(wanted[i] - counts[i]))[: n - sum(counts)]:
        counts[i] += 1
    return counts


def split_items(items: DataFrame, key: str, train: float, valid: float, seed: int = 1, rest: str = "remainder") -> DataFrame:
    """(key, split): a seeded order cut at the sizes of split_counts."""
    counts = split_counts(items.count(), train, valid, rest)
    split = F.when(F.col("at") <= counts[0], "train").when(F.col("at") <= counts[0] + counts[1], "valid").otherwise("test")
    return seeded_order(items, key, seed).select(key, split.alias("split"))


def seeded_order(items: DataFrame, key: str, seed: int, bins: int | None = None) -> DataFrame:
    """items with their place (at, from 1) in the order of md5(seed:key), key.

    Places are ranks within ranges of the hash plus the counts of the ranges before, so no task orders all items; ranges
    follow the number of items.
    """
    bins = bins or max(16, items.count() // 50_000)
    rows = items.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    rows = rows.withColumn("_bin", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / 2.0**32 * bins).cast("long"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    counts = rows.groupBy("_bin").count().select("_bin", before.alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy("_hash", key))
    return rows.join(counts, "_bin").withColumn("at", place).drop("_hash", "_bin", "_before")


def batched(items: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """items with their batch: the seeded order cut into batches of a size."""
    return seeded_order(items, key, seed).withColumn("batch", F.floor((F.col("at") - 1) / size)).drop("at")
