"""Relational operators of the notebooks: lookups, alignment, set measures, counts, orders, names, plot data and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def aligned(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(n_rows, n_unmatched) of a full join on the keys: both sides of a positional pair must have no row without partner."""
    a, b = left.select(F.col(left_key).alias("_a")), right.select(F.col(right_key).alias("_b"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the table's value of their key; a key without an entry fails the query."""
    found = rows.join(table.select(key, F.col(value).alias("_found")), key, "left")
    got = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast(table.schema[value].dataType)).otherwise(F.col("_found"))
    return found.withColumn(value, got).drop("_found")


def marked_existing(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a flag whether their key is among the known ones; callers skip what is not."""
    there = known.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys in the order of their first row."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def joined_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, n_pixels, n_tissue): pixels that their image's mask sets."""
    set_ = mask.where("m").select("image_id", "y", "x", F.lit(True).alias("_m"))
    return pixels.join(set_, ["image_id", "y", "x"], "left").groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.count_if("_m").alias("n_tissue"))


def noise_sets(runs: DataFrame, one: int, two: int) -> DataFrame:
    """(both_noise, any_noise): items that are noise in both of two runs, and in any of them."""
    a, b = (runs.where(F.col("seed") == s).select("vec_id", (F.col("label") == -1).alias(n)) for s, n in ((one, "a"), (two, "b")))
    return a.join(b, "vec_id").agg(F.count_if(F.col("a") & F.col("b")).alias("both_noise"), F.count_if(F.col("a") | F.col("b")).alias("any_noise"))


def noise_last(labels: DataFrame) -> DataFrame:
    """(label, place) of the distinct labels: ascending, noise last."""
    return labels.select("label").distinct().select("label", F.dense_rank().over(Window.orderBy(F.col("label") == -1, "label")).alias("place"))


def presence(rows: DataFrame, col: str) -> DataFrame:
    """(n_missing, n_there) of a column."""
    return rows.agg(F.count_if(F.col(col).isNull()).alias("n_missing"), F.count_if(F.col(col).isNotNull()).alias("n_there"))


def existing_columns(rows: DataFrame, wanted) -> DataFrame:
    """Those of the wanted columns that are there, in the order asked for."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def value_counts(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count("*").alias("n"))


def size_stats(counts: DataFrame) -> DataFrame:
    """Samples, clusters, and the least, largest, mean and median size of a table of counts."""
    n = F.col("n")
    return counts.agg(F.sum(n).alias("n_samples"), F.count("*").alias("n_clusters"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("mean_size"), F.median(n).alias("median_size"))


def size_map(counts: DataFrame, key: str = "label") -> DataFrame:
    """(sizes): one map of cluster to size."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("sizes"))


def without_noise(labels: DataFrame) -> DataFrame:
    return labels.where("label <> -1")


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with their place in an order of trials."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def mixture_order(trials: DataFrame, n: int, key: str = "config_no") -> DataFrame:
    """Mixture trials by validity, then by BIC per sample plus penalty (rounded to 9 digits), BIC and number."""
    scored = trials.withColumn("score", F.col("bic") / n + F.col("penalty"))
    return placed(scored, F.desc("valid_for_selection"), F.round("score", 9), "bic", key)


def valid_first(trials: DataFrame, key: str = "trial_number") -> DataFrame:
    return placed(trials, F.desc("valid_solution"), key)


def top_trials(trials: DataFrame, by: str, n: int, key: str = "trial_number") -> DataFrame:
    return trials.orderBy(F.col(by).desc_nulls_last(), key).limit(n)


def graph_validity(least: int, most: int, min_size: int, *finite: Column) -> Column:
    """Whether a graph partition's numbers of clusters and members are within bounds and its measures finite."""
    out = F.col("n_clusters").between(least, most) & (F.col("min_size") >= min_size)
    for f in finite:
        out &= f
    return F.coalesce(out, F.lit(False))


def feature_deviation(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(pos, s): population deviation of each feature."""
    return rows.select(F.posexplode(V.doubles(vec_col)).alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("s"))


def deviation_summary(deviation: DataFrame) -> DataFrame:
    """Mean, least and largest deviation, and how many features hardly vary."""
    return deviation.agg(F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"), *[F.count_if(F.col("s") < 10.0**-k).alias(f"dead{k}") for k in (6, 4, 3)])


def histogram(values: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal-width bins over the values' range; the last one is closed."""
    m = values.agg(F.min(col).alias("_lo"), ((F.max(col) - F.min(col)) / bins).alias("_w"))
    place = F.when(F.col("_w") > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / F.nullif(F.col("_w"), F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    return values.crossJoin(F.broadcast(m)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row of limits


def most_variable(rows: DataFrame, n: int = 10, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, value, side, place): the n lowest and highest rows of the feature that varies most."""
    best = feature_deviation(rows, vec_col).agg(F.min_by("pos", F.struct(-F.round("s", 9), "pos")).alias("pos"))
    v = rows.crossJoin(F.broadcast(best)).select(id_col, F.element_at(vec_col, F.col("pos") + 1).alias("value"))
    out = None
    for side, order in (("low", F.asc("value")), ("high", F.desc("value"))):
        part = placed(v.orderBy(order, id_col).limit(n), order, id_col).select(id_col, "value", F.lit(side).alias("side"), "place")
        out = part if out is None else out.unionByName(part)
    return out


def components_for(variances: DataFrame, share: float) -> DataFrame:
    """(k, cum): the fewest of the components (pos, v), largest first, whose variance is more than the share of all."""
    w = Window.orderBy(F.desc("v"), "pos")
    c = variances.select(F.row_number().over(w).alias("k"), (F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy())).alias("cum"))
    return c.where(F.col("cum") > share).agg(F.min("k").alias("k"), F.min("cum").alias("cum"))


def nearest_points(rows: DataFrame, x: float, y: float, n: int = 1, within: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """(id, dist) of the rows (id, x, y) closest to a point, at most so far away."""
    d = rows.select(id_col, F.round(F.sqrt(F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2))), 9).alias("dist")).orderBy("dist", id_col).limit(n)
    return d if within is None else d.where(F.col("dist") <= within)


def neighbors_of(rows: DataFrame, one, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(j, rank): the k rows nearest to a row by cosine, itself among them."""
    q = rows.where(F.col(id_col) == one).select(F.col(vec_col).alias("_q"))
    d = rows.crossJoin(F.broadcast(q)).select(F.col(id_col).alias("j"), F.round(V.cosine_distance(F.col("_q"), F.col(vec_col)), 9).alias("dist"))  # one vector
    return placed(d.orderBy("dist", "j").limit(k), "dist", "j").select("j", F.col("place").alias("rank"))


def crop_name(group: str, order: str, prefix: str = "slide") -> Column:
    """Names of a slide's crops by their place within it."""
    return F.format_string(prefix + "%d_%04d.png", F.col(group), F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def patch_name(slide: str = "slide_id", x: str = "sx", y: str = "sy", target: str | None = None) -> Column:
    """A patch's name by slide and place, with its colour target if it is a recoloured copy."""
    parts = [F.lit("slide"), F.col(slide), F.lit("_"), F.col(x), F.lit("_"), F.col(y)]
    return F.concat(*parts, *([F.lit("_reinhard_"), F.col(target)] if target else []), F.lit(".png"))


def image_name(key: str = "vec_id") -> Column:
    return F.concat(F.lit("img_"), F.col(key), F.lit(".png"))


def selected(key: str, values) -> Column:
    return F.col(key).isin(*values)


def coordinate_pairs(rows: DataFrame, pairs=((0, 1), (1, 2)), vec_col: str = "vec", id_col: str = "vec_id") -> DataFrame:
    """(id, a, b, x, y, label, colour): plot data of pairs of components; labels are coloured by their dense rank. A component that is missing is an error."""
    most = max(max(p) for p in pairs)
    vec = F.when(F.size(vec_col) > most, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"no component {most}")).cast("array<double>"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")
    colours = rows.select("label").distinct().select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("colour"))
    out = rows.select(id_col, "label", vec.alias("_v"), each).join(F.broadcast(colours), "label")
    return out.select(id_col, F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("_v")[F.col("p.a")].alias("x"), F.col("_v")[F.col("p.b")].alias("y"), "label", "colour")


def scatter(rows: DataFrame, dims: int = 3, vec_col: str = "vec", id_col: str = "vec_id") -> DataFrame:
    """(id, x, y[, z], label, noise): plot data of the first components, noise marked."""
    return rows.select(id_col, *[F.col(vec_col)[k].alias("xyz"[k]) for k in range(dims)], "label", (F.col("label") == -1).alias("noise"))


def image_grid(chosen: DataFrame, files: DataFrame, cols: int = 5, path: str = "image_path", order: str = "place") -> DataFrame:
    """(path, row, col, status): cells of a grid of images in order; an image whose file is not listed is "missing" and keeps its cell."""
    k = F.row_number().over(Window.orderBy(order, path)) - 1
    there = files.select(F.col("path").alias(path)).distinct().withColumn("_there", F.lit(True))
    out = chosen.select(path, order).join(there, path, "left")
    status = F.when(F.col(path).isNull(), "no path").when(F.col("_there").isNull(), "missing").otherwise("ok")
    return out.select(path, F.floor(k / cols).cast("int").alias("row"), (k % cols).cast("int").alias("col"), status.alias("status"))


def cluster_pages(members: DataFrame, per_page: int = 25, cols: int = 5, include_noise: bool = False) -> DataFrame:
    """(label, vec_id, page, row, col): all members of each cluster, strongest first, dealt to pages of a grid."""
    rows = members if include_noise else without_noise(members)
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strength"), "vec_id")) - 1
    cell = k % per_page
    return rows.select("label", "vec_id", F.floor(k / per_page).cast("int").alias("page"), F.floor(cell / cols).cast("int").alias("row"), (cell % cols).cast("int").alias("col"))


def tally(rows: DataFrame, **checks: Column) -> DataFrame:
    """(warning, n): how many rows each check is true for, zeros included."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("warning"), F.col(n).alias("n")) for n in checks])).alias("t")).select("t.*")


def vector_faults(rows: DataFrame, vec_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """One row: vectors that are null, of another length than dims (or the first's), or hold null or non-finite components."""
    width = F.lit(dims) if dims is not None else F.max(F.size(vec_col)).over(Window.partitionBy())
    v = V.doubles(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flags = rows.select(F.col(vec_col).isNull().alias("a"), (F.size(vec_col) != width).alias("b"), bad.alias("c"))
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return flags.agg(F.count("*").alias("n"), count("a").alias("n_null"), count("b").alias("n_length"), count("c").alias("n_not_finite"))


def validated(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """rows, or ValueError if a vector is null, not finite, or unlike the others in length."""
    dims = rows.agg(F.max(F.size(vec_col))).first()[0]
    r = vector_faults(rows, vec_col, dims).first()
    if not r["n"] or r["n_null"] or r["n_length"] or r["n_not_finite"]:
        raise ValueError(f"vectors must be finite and of one length: {r.asDict()}")
    return rows


def weighted_mean(rows: DataFrame, by: str, value: Column, weight: Column, floor: float = 1e-8) -> DataFrame:
    """(by, pooled): weighted mean with a small floor under the weights' sum."""
    return rows.groupBy(by).agg((F.sum(weight * value) / (F.sum(weight) + floor)).alias("pooled"))


def step_decay(epoch: Column, first: float = 0.1, factor: float = 0.1, every: int = 2) -> Column:
    """The learning rate after an epoch: the first one, times the factor on each `every`-th epoch."""
    return first * F.pow(F.lit(factor), F.floor((epoch + 1) / every))


def flattened(trials: DataFrame, details: str, *keep: str) -> DataFrame:
    """One row per element of a trial's list of structs, with the trial's own columns."""
    return trials.select(*keep, F.explode(details).alias("_d")).select(*keep, "_d.*")


def reachability(near: DataFrame, min_samples: int) -> DataFrame:
    """(i, j, reach): mutual reachability of a neighbour table's pairs, core distances being those to the min_samples-th neighbour."""
    core = near.where(F.col("rank") == min_samples).select(F.col("i").alias("_c"), F.col("dist").alias("core"))
    a, b = core.select(F.col("_c").alias("i"), F.col("core").alias("ca")), core.select(F.col("_c").alias("j"), F.col("core").alias("cb"))
    return near.join(a, "i").join(b, "j").select("i", "j", F.greatest("dist", "ca", "cb").alias("reach"))


def shared_neighbors(one: DataFrame, two: DataFrame) -> DataFrame:
    """(i, shared, lost): neighbours in both of two neighbour tables, and in the first alone."""
    a, b = (d.groupBy("i").agg(F.collect_set("j").alias(c)) for d, c in ((one, "a"), (two, "b")))  # k neighbours each
    return a.join(b, "i").select("i", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_except("a", "b")).cast("long").alias("lost"))
