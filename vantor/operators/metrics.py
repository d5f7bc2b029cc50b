"""Quality of embeddings and partitions: neighbour preservation, compactness, agreement, stability, graph quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .durable import cut
from .neighbors import label_means, layouts_ranks, neighbor_ranks


def check_k(ks, n: int) -> list[int]:
    """Distinct sorted neighbourhood sizes; errors as for the measures below."""
    ks = sorted({int(k) for k in ([ks] if isinstance(ks, int) else ks)})
    if not ks or ks[0] < 1 or ks[-1] > (n - 1) // 2:
        raise ValueError("each k must be from 1 to (n - 1) // 2")
    return ks


def neighbor_preservation(high: DataFrame, low: DataFrame, ks, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(k, trustworthiness, continuity, qnn, lcmc) per k and auc_lcmc, from the neighbours of both spaces with their ranks in the other.

    One table serves all k: a pair counts for k from its rank on, and is shared from the larger of its two ranks on. The penalties are
    2 / (n k (2n - 3k - 1)) times how far ranks in the other space exceed k.
    """
    n = high.count()
    ks = check_k(ks, n)
    return _preservation(neighbor_ranks(high, low, ks[-1], id_col, vec_col, metric), n, ks)


def neighbor_preservations(high: DataFrame, lows: list[DataFrame], ks, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "euclidean", near: DataFrame | None = None) -> DataFrame:
    """(which, k, ...): the same for several low spaces (which: their place) of the same vectors; near: the neighbours of the high one, if they are known."""
    n = high.count()
    ks = check_k(ks, n)
    return _preservation(layouts_ranks(high, lows, ks[-1], id_col, vec_col, metric, near), n, ks, "which")


def _preservation(pairs: DataFrame, n: int, ks: list[int], *by: str) -> DataFrame:
    top, spark = ks[-1], pairs.sparkSession
    # Rows of the table are summed once per own rank and other rank; what follows has at most top * top + top rows and no vector.
    over = [F.sum(F.greatest(F.col("other") - k, F.lit(0))).alias(f"over{k}") for k in ks]
    cells = cut(pairs.groupBy(*by, "space", "rank", F.least(F.col("other"), F.lit(top + 1)).alias("at")).agg(F.count("*").alias("n"), *over))
    sizes = spark.createDataFrame([(k,) for k in range(1, top + 1)], "k int")
    near = cells.join(F.broadcast(sizes), F.col("rank") <= F.col("k"))
    hits = F.sum(F.when((F.col("space") == 0) & (F.col("at") <= F.col("k")), F.col("n")).otherwise(0)) / (F.lit(n) * F.col("k"))
    lost = lambda space: sum((F.coalesce(F.sum(F.when((F.col("space") == space) & (F.col("k") == k), F.col(f"over{k}"))), F.lit(0)) for k in ks), F.lit(0))
    k = F.col("k").cast("long")  # n * n * k is beyond an int from some 10,000 rows on
    worst = F.lit(n) * k * (2 * n - 3 * k - 1)
    per = near.groupBy(*by, "k").agg(hits.alias("qnn"), (1 - 2.0 * lost(1) / F.nullif(worst, F.lit(0))).alias("trustworthiness"), (1 - 2.0 * lost(0) / F.nullif(worst, F.lit(0))).alias("continuity"))
    per = per.withColumn("lcmc", F.col("qnn") - F.col("k") / F.lit(n - 1))
    auc = F.broadcast(per.groupBy(*by).agg(F.avg("lcmc").alias("auc_lcmc")))
    per = per.where(F.col("k").isin(ks))
    return (per.join(auc, list(by)) if by else per.crossJoin(auc)).select(*by, "k", "trustworthiness", "continuity", "qnn", "lcmc", "auc_lcmc")


def silhouette_samples(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", metric: str = "euclidean") -> DataFrame:
    """(i, label, a, b, silhouette): mean distance to the own cluster and to the nearest other; a singleton has 0."""
    return _silhouette(label_means(df, [label_col], id_col, vec_col, metric)).drop("which")


def silhouettes(df: DataFrame, label_cols: list[str], missing: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(which, i, label, a, b, silhouette): the same for several labellings, whose vectors meet once; those labelled `missing` are left out."""
    return _silhouette(label_means(df, label_cols, id_col, vec_col, metric, missing))


def _silhouette(means: DataFrame) -> DataFrame:
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return means.withColumn("silhouette", F.coalesce(value, F.lit(0.0)))


def per_cluster_silhouette(samples: DataFrame) -> DataFrame:
    s = F.col("silhouette")
    return samples.groupBy("label").agg(F.count("*").alias("size"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"))


def centroids(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(label, n, centroid)."""
    long = df.select(F.col(label_col).alias("label"), F.posexplode(V.doubles(vec_col)).alias("pos", "x"))
    per = long.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = per.groupBy("label").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return packed.select("label", "n", F.transform("c", lambda x: x["m"]).alias("centroid"))


def davies_bouldin(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(davies_bouldin): mean over clusters of the largest (S_i + S_j) / distance of the centroids."""
    c = centroids(df, vec_col, label_col).persist()
    spread = df.join(F.broadcast(c), df[label_col] == c.label).groupBy(c.label).agg(F.avg(V.euclidean(V.doubles(vec_col), F.col("centroid"))).alias("s"))
    c = c.join(spread, "label")
    a, b = (c.select(*[F.col(x).alias(f"{x}_{k}") for x in ("label", "centroid", "s")]) for k in "ab")
    gap = V.euclidean(F.col("centroid_a"), F.col("centroid_b"))
    worst = a.join(b, F.col("label_a") != F.col("label_b")).groupBy("label_a").agg(F.max(F.when(gap > 0, (F.col("s_a") + F.col("s_b")) / gap).otherwise(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(calinski_harabasz): between-cluster over within-cluster dispersion per degree of freedom; 1 if nothing varies within, null for one cluster."""
    long = df.select(F.col(label_col).alias("label"), F.posexplode(V.doubles(vec_col)).alias("pos", "x"))
    per = long.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("w"))
    grand = per.groupBy("pos").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"), F.sum("n").alias("all"))
    t = per.join(F.broadcast(grand), "pos").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum("w").alias("w"), F.countDistinct("label").alias("k"), F.max("all").alias("n")
    )
    return t.select(F.when(F.col("k") < 2, None).when(F.col("w") == 0, 1.0).otherwise(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)) / (F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))).alias("calinski_harabasz"))


def contingency(runs: DataFrame, noise: bool = False) -> DataFrame:
    """(run_a, run_b, la, lb, n) of items clustered in both runs (or of all items), for each pair of runs a < b; runs: (seed, vec_id, label)."""
    a, b = (runs.select(F.col("seed").alias(f"run_{k}"), "vec_id", F.col("label").alias(f"l{k}")) for k in "ab")
    both = a.join(b, "vec_id").where("run_a < run_b")
    both = both if noise else both.where("la <> -1 AND lb <> -1")
    return both.groupBy("run_a", "run_b", "la", "lb").agg(F.count("*").alias("n"))


def agreement(runs: DataFrame) -> DataFrame:
    """(run_a, run_b, common, common_ratio, ari, ami, noise_agreement, noise_jaccard); scores are null below two common points."""
    # Runs meet once; all that follows is made of the written cells, a row per pair of labels.
    every = cut(contingency(runs, noise=True))
    na, nb = F.col("la") == -1, F.col("lb") == -1
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    base = every.groupBy("run_a", "run_b").agg(
        share(~na & ~nb).alias("common"), (share(~na & ~nb) / F.sum("n")).alias("common_ratio"), (share(na == nb) / F.sum("n")).alias("noise_agreement"),
        (share(na & nb) / F.when(share(na | nb) > 0, share(na | nb))).alias("noise_jaccard"),
    )
    cells = every.where("la <> -1 AND lb <> -1")
    pair = ["run_a", "run_b"]
    ra = cells.groupBy(*pair, "la").agg(F.sum("n").alias("a"))
    rb = cells.groupBy(*pair, "lb").agg(F.sum("n").alias("b"))
    n = cells.groupBy(*pair).agg(F.sum("n").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    sums = n.join(ra.groupBy(*pair).agg(F.sum(F.col("a").cast("double") * F.col("a")).alias("aa")), pair).join(rb.groupBy(*pair).agg(F.sum(F.col("b").cast("double") * F.col("b")).alias("bb")), pair)
    t = F.col("t").cast("double")
    tp, fp, fn = F.col("nn") - t, F.col("bb") - F.col("nn"), F.col("aa") - F.col("nn")
    tn = t * t - fp - fn - F.col("nn")
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    sums = sums.withColumn("ari", ari)
    mi = cells.join(ra, [*pair, "la"]).join(rb, [*pair, "lb"]).join(n.select(*pair, "t"), pair)
    mi = mi.groupBy(*pair).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))

    def uncertain(side: DataFrame, col: str) -> DataFrame:
        p = F.col(col) / F.col("t")
        return side.join(n.select(*pair, "t"), pair).groupBy(*pair).agg((-F.sum(p * F.log(p))).alias(f"h{col}"), F.count("*").alias(f"k{col}"))

    # Expected information depends on cluster sizes alone, so equal sizes are summed once.
    sa = ra.groupBy(*pair, "a").agg(F.count("*").alias("ma"))
    sb = rb.groupBy(*pair, "b").agg(F.count("*").alias("mb"))
    e = sa.join(sb, pair).join(n.select(*pair, "t"), pair)
    e = e.withColumn("x", F.explode(F.sequence(F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("t")), F.least("a", "b"))))
    f = V.ln_factorial
    a_, b_, t_, x_ = (F.col(c) for c in ("a", "b", "t", "x"))
    ln = f(a_) + f(b_) + f(t_ - a_) + f(t_ - b_) - f(t_) - f(x_) - f(a_ - x_) - f(b_ - x_) - f(t_ - a_ - b_ + x_)
    emi = e.groupBy(*pair).agg(F.sum(F.col("ma") * F.col("mb") * x_ / t_ * F.log(t_.cast("double") * x_ / (a_.cast("double") * b_)) * F.exp(ln)).alias("emi"))
    s = sums.join(mi, pair).join(uncertain(ra, "a"), pair).join(uncertain(rb, "b"), pair).join(emi, pair)
    gap = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    one = ((F.col("ka") == 1) & (F.col("kb") == 1)) | ((F.col("ka") == F.col("t")) & (F.col("kb") == F.col("t")))
    ami = F.when(one, 1.0).otherwise((F.col("mi") - F.col("emi")) / F.when(gap < 0, F.least(gap, F.lit(-2.220446049250313e-16))).otherwise(F.greatest(gap, F.lit(2.220446049250313e-16))))
    s = s.select(*pair, "ari", ami.alias("ami"))
    out = base.join(s, pair, "left")
    few = F.col("common") < 2
    return out.select(*pair, "common", "common_ratio", F.when(~few, F.col("ari")).alias("ari"), F.when(~few, F.col("ami")).alias("ami"), "noise_agreement", "noise_jaccard")


def stability_summary(pairs: DataFrame) -> DataFrame:
    """Means over all pairs of runs; null scores are left out."""
    names = ["ari", "ami", "common_ratio", "noise_agreement", "noise_jaccard"]
    return pairs.agg(*[F.avg(c).alias(f"mean_{c}") for c in names], F.count("*").alias("n_pairs"))


def recovery_order(recovery: DataFrame) -> DataFrame:
    """Recovered clusters with their place: by mean overlap, largest first, missing ones last, ties by cluster."""
    return recovery.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_jaccard").desc_nulls_last(), "cluster")))


def medoid_ranking(pairs: DataFrame) -> DataFrame:
    """(seed, mean_ari, medoid_rank): runs by mean agreement with the others, null last, ties to the earlier run."""
    both = pairs.select(F.col("run_a").alias("seed"), "ari").unionAll(pairs.select("run_b", "ari"))
    mean = both.groupBy("seed").agg(F.avg("ari").alias("mean_ari"))
    return mean.withColumn("medoid_rank", F.row_number().over(Window.orderBy(F.col("mean_ari").desc_nulls_last(), "seed")))


def cluster_recovery(runs: DataFrame, reference: int, exclude_noise: bool = True) -> DataFrame:
    """(cluster, cluster_size, mean/std/min/max_jaccard, status) of the reference run's clusters in the other runs."""
    ref = runs.where(F.col("seed") == reference).select("vec_id", F.col("label").alias("cluster"))
    rest = runs.where(F.col("seed") != reference).select("seed", "vec_id", F.col("label").alias("other"))
    if exclude_noise:
        ref, rest_in = ref.where("cluster <> -1"), rest.where("other <> -1")
    else:
        rest_in = rest
    size = ref.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    other = rest_in.groupBy("seed", "other").agg(F.count("*").alias("other_size"))
    cross = ref.join(rest_in, "vec_id").groupBy("cluster", "seed", "other").agg(F.count("*").alias("shared"))
    j = cross.join(size, "cluster").join(other, ["seed", "other"])
    j = j.withColumn("jaccard", F.col("shared") / (F.col("cluster_size") + F.col("other_size") - F.col("shared")))
    best = j.groupBy("cluster", "seed").agg(F.max("jaccard").alias("jaccard"))
    all_pairs = size.crossJoin(F.broadcast(rest.select("seed").distinct()))
    best = all_pairs.join(best, ["cluster", "seed"], "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    out = best.groupBy("cluster", "cluster_size").agg(*[f("jaccard").alias(f"{n}_jaccard") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    m = F.col("mean_jaccard")
    return out.withColumn("status", F.when(m.isNull(), "not_available").when(m >= 0.75, "solid").when(m >= 0.5, "borderline").otherwise("dissolved"))


def graph_quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(rb, cpm, modularity) of a partition; edges (src, dst, weight) stand once, labels (id, label)."""
    la, lb = (labels.select(F.col("id").alias(k), F.col("label").alias(f"l_{k}")) for k in ("src", "dst"))
    e = edges.join(la, "src").join(lb, "dst")
    inside = e.where("l_src = l_dst").groupBy(F.col("l_src").alias("label")).agg(F.sum("weight").alias("w"))
    ends = e.select(F.col("l_src").alias("label"), "weight").unionAll(e.select("l_dst", "weight")).groupBy("label").agg(F.sum("weight").alias("k"))
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    m = edges.agg(F.sum("weight").alias("m"))
    t = size.join(inside, "label", "left").join(ends, "label", "left").na.fill(0.0).crossJoin(F.broadcast(m))
    g = F.lit(resolution)

    def rb(r: Column) -> Column:
        return 2 * F.sum(F.col("w") - r * F.col("k") * F.col("k") / (4 * F.col("m")))

    cpm = 2 * F.sum(F.col("w") - g * F.col("n") * (F.col("n") - 1) / 2)
    return t.agg(rb(g).alias("rb"), cpm.alias("cpm"), (rb(F.lit(1.0)) / F.max(2 * F.col("m"))).alias("modularity"))
