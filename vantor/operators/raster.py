"""Raster and polygon operators over long-form pixels (image_id, y, x, ...) and polygon tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

#: Side of the square tiles that neighbourhood operators work on.
TILE = 256
# sRGB to XYZ under D65, the white point, and the constants of CIE Lab.
RGB_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
XYZ_RGB = ((3.240481343200527, -1.5371515162713185, -0.49853632616888777), (-0.9692549499965682, 1.8759900014898907, 0.04155592655829284), (0.055646639135177, -0.20404133836651123, 1.0573110696453443))
WHITE = (0.95047, 1.0, 1.08883)


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """(L, a, b) of 8-bit sRGB."""
    lin = [F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92) for c in (r, g, b)]
    xyz = [sum((lin[k] * row[k] for k in range(3)), F.lit(0.0)) / w for row, w in zip(RGB_XYZ, WHITE)]
    f = [F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16.0 / 116) for v in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_to_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    """8-bit sRGB of Lab, clipped and truncated."""
    fy = (light + 16) / 116
    fs = [a / 500 + fy, fy, F.greatest(F.lit(0.0), fy - b / 200)]
    xyz = [F.when(f > 0.2068966, F.pow(f, F.lit(3.0))).otherwise((f - 16.0 / 116) / 7.787) * w for f, w in zip(fs, WHITE)]
    lin = [sum((xyz[k] * row[k] for k in range(3)), F.lit(0.0)) for row in XYZ_RGB]
    out = [F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v) for v in lin]
    return [F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 255))).cast("int") for v in out]


def with_lab(pixels: DataFrame) -> DataFrame:
    light, a, b = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({"lab_l": light, "lab_a": a, "lab_b": b})


def colour_stats(pixels: DataFrame, by: str = "image_id") -> DataFrame:
    """(image, mean, std arrays) of Lab over the given pixels; a std below 1e-6 counts as 1."""
    lab = with_lab(pixels)
    names = ("lab_l", "lab_a", "lab_b")
    agg = lab.groupBy(by).agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    std = [F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}")) for c in names]
    return agg.select(by, F.array(*[F.col(f"m_{c}") for c in names]).alias("mean"), F.array(*std).alias("std"))


def normalise_colour(pixels: DataFrame, stats: DataFrame, target_mean: list, target_std: list, by: str = "image_id", mask: Column | None = None) -> DataFrame:
    """Pixels moved from their image's colour statistics to the target's; those outside the mask keep their Lab value."""
    lab = with_lab(pixels).join(F.broadcast(stats), by)
    keep = mask if mask is not None else F.lit(True)
    bounds = ((0.0, 100.0), (-128.0, 127.0), (-128.0, 127.0))
    moved = []
    for k, c in enumerate(("lab_l", "lab_a", "lab_b")):
        v = (F.col(c) - F.col("mean")[k]) / (F.col("std")[k] + F.lit(1e-8)) * target_std[k] + target_mean[k]
        v = F.when(keep, v).otherwise(F.col(c))
        moved.append(F.least(F.lit(bounds[k][1]), F.greatest(F.lit(bounds[k][0]), v)))
    r, g, b = lab_to_rgb(*moved)
    return lab.withColumns({"nr": r, "ng": g, "nb": b}).select(*pixels.columns, "nr", "ng", "nb")


def pick_targets(stats: DataFrame, n: int, by: str = "image_id") -> DataFrame:
    """n images spread over the order of mean lightness: the middle one, the ends, or evenly spaced ones."""
    if n < 1:
        raise ValueError("n must be at least 1")
    total = stats.count()
    if total < n:
        raise ValueError("too few images")
    places = [total // 2] if n == 1 else sorted({int(i * (total - 1) / (n - 1)) for i in range(n)})
    at = F.row_number().over(Window.orderBy(F.col("mean")[0], by)) - 1
    return stats.withColumn("place", at).where(F.col("place").isin(places))


def _disk(radius: int, square: bool = False) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if square or dy * dy + dx * dx <= radius * radius]


def tiled(pixels: DataFrame, value: str, reach: int, kernel, result: str, side: int = TILE) -> DataFrame:
    """(image_id, y, x, result): kernel over square tiles with a margin of `reach` pixels, so a pixel travels about once, not once per offset.

    kernel(values, present) takes arrays with the margin, int64 and bool, and gives an array without it; only pixels that are there come back.
    """
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    rows = pixels.select("image_id", "y", "x", F.col(value).cast("long").alias("v"), near("y").alias("ty")).select("*", near("x").alias("tx"))
    name, kind = result.split()

    def run(key, table):
        image, ty, tx = (k.as_py() for k in key)
        y, x = (table.column(c).to_numpy() - t * side + reach for c, t in (("y", ty), ("x", tx)))
        values, present = np.zeros((side + 2 * reach,) * 2, np.int64), np.zeros((side + 2 * reach,) * 2, bool)
        values[y, x], present[y, x] = table.column("v").to_numpy(), True
        own = (y >= reach) & (y < side + reach) & (x >= reach) & (x < side + reach)
        y, x = y[own] - reach, x[own] - reach
        out = kernel(values, present)[y, x] if own.any() else np.zeros(0)
        fields = pa.schema([("image_id", table.schema.field("image_id").type), ("y", pa.int32()), ("x", pa.int32()), (name, pa.float64() if kind == "double" else pa.bool_())])
        return pa.table([pa.array([image] * len(y), fields.field(0).type), pa.array((y + ty * side).astype(np.int32)), pa.array((x + tx * side).astype(np.int32)), pa.array(out.astype(float if kind == "double" else bool))], schema=fields)

    image = pixels.schema["image_id"].dataType.simpleString()
    return rows.groupBy("image_id", "ty", "tx").applyInArrow(run, f"image_id {image}, y int, x int, {result}")


def _shifted(a: np.ndarray, offsets: list[tuple[int, int]], reach: int) -> np.ndarray:
    h, w = a.shape[0] - 2 * reach, a.shape[1] - 2 * reach
    return np.stack([a[reach + dy : reach + dy + h, reach + dx : reach + dx + w] for dy, dx in offsets])


def local_entropy(pixels: DataFrame, radius: int = 3, value: str = "v", side: int = TILE) -> DataFrame:
    """(image_id, y, x, entropy): Shannon entropy in bits of the values in a disk, clipped at the border."""
    offsets = _disk(radius)

    def kernel(values, present):
        # Each pixel's neighbourhood in order: runs are equal values; what is not there counts as one run that is left out.
        gone = np.iinfo(np.int64).min
        near = _shifted(np.where(present, values, gone), offsets, radius)
        shape, m = near.shape[1:], len(near)
        near = np.sort(near.reshape(m, -1).T, axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, near.size)).astype(float)
        length[near.ravel()[start] == gone] = 0
        n = np.bincount(start // m, length, len(near))
        total = np.bincount(start // m, length * np.log2(np.maximum(length, 1)), len(near))
        return (np.log2(np.maximum(n, 1)) - total / np.maximum(n, 1)).reshape(shape)

    return tiled(pixels, value, radius, kernel, "entropy double", side)


def entropy_threshold(entropies: DataFrame, bins: int = 30, low: float = 0.5, high: float = 5.0, default: float = 2.0) -> DataFrame:
    """(image_id, threshold): left edge of the last strict local minimum of the histogram within (low, high), else the default."""
    lim = entropies.groupBy("image_id").agg(F.min("entropy").alias("lo"), F.max("entropy").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("entropy") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = entropies.join(F.broadcast(lim), "image_id").groupBy("image_id", bin_.alias("bin")).agg(F.count("*").alias("c"))
    grid = lim.select("image_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["image_id", "bin"], "left").na.fill(0, ["c"])
    w = Window.partitionBy("image_id").orderBy("bin")
    g = grid.withColumns({"p": F.lag("c").over(w), "n": F.lead("c").over(w), "edge": F.col("lo") + F.col("bin") * width})
    hit = (F.col("c") < F.col("p")) & (F.col("c") < F.col("n")) & (F.col("edge") > low) & (F.col("edge") < high)
    return g.groupBy("image_id").agg(F.coalesce(F.max_by(F.when(hit, F.col("edge")), F.when(hit, F.col("bin"))), F.lit(default)).alias("threshold"))


def morphology(mask: DataFrame, radius: int, grow: bool, square: bool = True, side: int = TILE) -> DataFrame:
    """Dilation or erosion of (image_id, y, x, m) by a square or disk; beyond the border nothing is set for growth and all is for erosion."""
    offsets = _disk(radius, square)

    def kernel(values, present):
        near = _shifted(np.where(present, values, 0 if grow else 1), offsets, radius)
        return (near.max(0) if grow else near.min(0)) > 0

    return tiled(mask, "m", radius, kernel, "m boolean", side)


def opened(mask: DataFrame, radius: int, square: bool = True) -> DataFrame:
    return morphology(morphology(mask, radius, False, square), radius, True, square)


def closed(mask: DataFrame, radius: int, square: bool = True) -> DataFrame:
    return morphology(morphology(mask, radius, True, square), radius, False, square)


def objects(mask: DataFrame, value: bool = True, max_rounds: int = 200) -> DataFrame:
    """(image_id, y, x, object, size): 8-connected components of pixels equal to value, named by their first pixel.

    Labels take the least of their neighbourhood, then jump to their label's label, until nothing changes; each image is a
    component problem of its own and rounds grow with the logarithm of the longest path.
    """
    at = F.col("y").cast("long") * F.lit(1 << 31) + F.col("x")
    px = mask.where(F.col("m") == value).select("image_id", "y", "x", at.alias("id"))
    shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("o")
    around = px.select("image_id", "id", shift).select("image_id", "id", (F.col("id") + F.col("o.dy") * F.lit(1 << 31) + F.col("o.dx")).alias("near"))
    edges = cut(around.join(px.select("image_id", F.col("id").alias("near")), ["image_id", "near"]))
    labels = px.select("image_id", "id", F.col("id").alias("object"))
    for _ in range(max_rounds):
        near = labels.select("image_id", F.col("id").alias("near"), F.col("object").alias("seen"))
        step = cut(edges.join(near, ["image_id", "near"]).groupBy("image_id", "id").agg(F.min("seen").alias("object")))
        jump = step.select("image_id", F.col("id").alias("object"), F.col("object").alias("root"))
        new = cut(step.join(jump, ["image_id", "object"]).select("image_id", "id", F.col("root").alias("object")))
        changed = new.join(labels.select("image_id", "id", F.col("object").alias("old")), ["image_id", "id"]).where("object <> old").limit(1).count()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("objects did not settle")
    size = labels.groupBy("image_id", "object").agg(F.count("*").alias("size"))
    return px.join(labels.join(size, ["image_id", "object"]), ["image_id", "id"]).select("image_id", "y", "x", "object", "size")


def without_small_objects(mask: DataFrame, max_size: int) -> DataFrame:
    small = objects(mask).where(F.col("size") <= max_size).select("image_id", "y", "x", F.lit(True).alias("small"))
    return mask.join(small, ["image_id", "y", "x"], "left").select("image_id", "y", "x", (F.col("m") & F.col("small").isNull()).alias("m"))


def without_small_holes(mask: DataFrame, max_size: int) -> DataFrame:
    small = objects(mask, False).where(F.col("size") <= max_size).select("image_id", "y", "x", F.lit(True).alias("small"))
    return mask.join(small, ["image_id", "y", "x"], "left").select("image_id", "y", "x", (F.col("m") | F.col("small").isNotNull()).alias("m"))


def bounding_box(polygons: DataFrame, margin: int, width: str, height: str) -> DataFrame:
    """(..., x0, y0, x1, y1): floored and ceiled limits with a margin, clipped to the slide; polygons hold pts array<struct<x,y>>."""
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    zero = F.lit(0)
    return polygons.withColumns(
        {
            "x0": F.greatest(zero, F.floor(F.array_min(xs)).cast("int") - margin), "y0": F.greatest(zero, F.floor(F.array_min(ys)).cast("int") - margin),
            "x1": F.least(F.col(width), F.ceil(F.array_max(xs)).cast("int") + margin), "y1": F.least(F.col(height), F.ceil(F.array_max(ys)).cast("int") + margin),
        }
    )


def touching(polygons: DataFrame, tiles: DataFrame, cell: int) -> DataFrame:
    """Polygon boxes that meet square tiles (slide_id, tx, ty, side), touching included: an equi-join on grid cells, then the exact test."""
    p = polygons.withColumns({"cx": F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))})
    p = p.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    t = tiles.withColumn("cx", F.explode(F.sequence(F.floor(F.col("tx") / cell), F.floor((F.col("tx") + F.col("side")) / cell))))
    t = t.withColumn("cy", F.explode(F.sequence(F.floor(F.col("ty") / cell), F.floor((F.col("ty") + F.col("side")) / cell))))
    both = p.join(t, ["slide_id", "cx", "cy"]).where("x1 >= tx AND x0 <= tx + side AND y1 >= ty AND y0 <= ty + side")
    return both.drop("cx", "cy").dropDuplicates(["slide_id", "polygon_id", "tx", "ty"])


def filled(polygons: DataFrame, width: int, height: int, dx: Column | int = 0, dy: Column | int = 0) -> DataFrame:
    """(polygon_id, y, x) of the pixels inside by even-odd crossings of the rounded local polygon; half rounds to even."""
    def rounded(c: Column) -> Column:
        return F.rint(c.cast("double")).cast("int")

    local = F.transform("pts", lambda p: F.struct(rounded(p["x"] - dx).alias("x"), rounded(p["y"] - dy).alias("y")))
    n = F.size("pts")
    edges = polygons.select("polygon_id", F.posexplode(local).alias("k", "a"), local.alias("all"), n.alias("n"))
    edges = edges.select("polygon_id", "a", F.element_at("all", ((F.col("k") + 1) % F.col("n") + 1).cast("int")).alias("b")).where("a.y <> b.y")
    lo, hi = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    rows = edges.withColumn("y", F.explode(F.sequence(lo, hi - 1))).where((F.col("y") >= 0) & (F.col("y") < height))
    cross = F.col("a.x") + (F.col("y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))
    rows = rows.select("polygon_id", "y", cross.alias("cx"))
    # Crossings of a row in order bound the inside pairwise: no pixel outside a polygon's rows is made.
    spans = rows.groupBy("polygon_id", "y").agg(F.sort_array(F.collect_list("cx")).alias("c"))
    spans = spans.select("polygon_id", "y", "c", F.explode(F.sequence(F.lit(0), (F.floor(F.size("c") / 2) - 1).cast("int"))).alias("k")).where(F.size("c") > 1)
    a, b = F.element_at("c", F.col("k") * 2 + 1), F.element_at("c", F.col("k") * 2 + 2)
    first, last = F.greatest(F.lit(0), F.ceil(a).cast("int")), F.least(F.lit(width - 1), F.ceil(b).cast("int") - 1)
    spans = spans.select("polygon_id", "y", first.alias("f"), last.alias("l")).where("f <= l")
    return spans.select("polygon_id", "y", F.explode(F.sequence("f", "l")).alias("x"))


def black_outside(pixels: DataFrame, polygons: DataFrame, width: int, height: int, value: str = "v") -> DataFrame:
    """(slide_id, polygon_id, y, x, value): a slide's pixels (slide_id, y, x, value) once for each of its polygons, 0 outside it."""
    inside = filled(polygons, width, height).withColumn("_in", F.lit(True))
    every = pixels.join(polygons.select("slide_id", "polygon_id"), "slide_id").join(inside, ["polygon_id", "y", "x"], "left")
    return every.select("slide_id", "polygon_id", "y", "x", F.when(F.col("_in"), F.col(value)).otherwise(0).alias(value))


def tile_grid(slides: DataFrame, patch: int, stride: int) -> DataFrame:
    """(slide_id, my, mx, sx, sy): windows over a mask of (mask_h, mask_w) at scale ds, with slide coordinates rounded half to even."""
    m = F.ceil(F.lit(patch) / F.col("ds")).cast("int")
    step = F.greatest(F.lit(1), F.rint(F.lit(stride) / F.col("ds")).cast("int"))
    s = slides.withColumns({"win": m, "step": step}).where("win <= mask_h AND win <= mask_w")
    s = s.withColumn("my", F.explode(F.sequence(F.lit(0), F.col("mask_h") - F.col("win"), F.col("step"))))
    s = s.withColumn("mx", F.explode(F.sequence(F.lit(0), F.col("mask_w") - F.col("win"), F.col("step"))))
    s = s.withColumns({"sx": F.rint(F.col("mx") * F.col("ds")).cast("long"), "sy": F.rint(F.col("my") * F.col("ds")).cast("long")})
    return s.where((F.col("sx") + patch <= F.col("width")) & (F.col("sy") + patch <= F.col("height")))


def tissue_ratio(tiles: DataFrame, mask: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """Tiles whose share of set mask pixels reaches min_ratio. Only set pixels meet tiles, by the grid cell of a window's size."""
    t = tiles.withColumn("cy", F.explode(F.sequence(F.floor(F.col("my") / F.col("win")), F.floor((F.col("my") + F.col("win") - 1) / F.col("win")))))
    t = t.withColumn("cx", F.explode(F.sequence(F.floor(F.col("mx") / F.col("win")), F.floor((F.col("mx") + F.col("win") - 1) / F.col("win")))))
    win = tiles.select("slide_id", F.col("win").alias("w")).distinct()
    px = mask.where("m").join(F.broadcast(win), "slide_id").select("slide_id", "y", "x", F.floor(F.col("y") / F.col("w")).alias("cy"), F.floor(F.col("x") / F.col("w")).alias("cx"))
    hit = t.join(px, ["slide_id", "cy", "cx"]).where("y >= my AND y < my + win AND x >= mx AND x < mx + win")
    c = hit.groupBy("slide_id", "my", "mx").agg(F.count("*").alias("c"))
    out = tiles.join(c, ["slide_id", "my", "mx"], "left").withColumn("ratio", F.coalesce(F.col("c"), F.lit(0)) / (F.col("win") * F.col("win"))).drop("c")
    return out.where(F.col("ratio") >= min_ratio)


def resized_nearest(pixels: DataFrame, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """Each new pixel takes the old one under its centre."""
    grid = pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(new_h - 1))).alias("ny")).select("image_id", "ny", F.explode(F.sequence(F.lit(0), F.lit(new_w - 1))).alias("nx"))
    y, x = F.floor((F.col("ny") + 0.5) * h / new_h).cast("int"), F.floor((F.col("nx") + 0.5) * w / new_w).cast("int")
    return grid.withColumns({"y": y, "x": x}).join(pixels, ["image_id", "y", "x"]).drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})


def filter_weights(size: int, new_size: int, kernel: str) -> list[tuple[int, int, float]]:
    """(new, old, weight) of a separable filter over pixel centres; where an image shrinks, the filter widens with it, and weights sum to 1."""
    reach = {"box": 0.5, "bilinear": 1.0, "lanczos": 3.0}[kernel]
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    value = {"box": lambda x: float(-0.5 < x <= 0.5), "bilinear": lambda x: max(0.0, 1 - abs(x)), "lanczos": lambda x: sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0}[kernel]
    scale = size / new_size
    wide = max(1.0, scale)
    out = []
    for i in range(new_size):
        centre = (i + 0.5) * scale
        own = [(k, value((k + 0.5 - centre) / wide)) for k in range(max(0, math.floor(centre - reach * wide)), min(size, math.ceil(centre + reach * wide) + 1))]
        total = sum(w for _, w in own)
        out += [(i, k, w / total) for k, w in own if w]
    return out


def resampled(pixels: DataFrame, h: int, w: int, new_h: int, new_w: int, kernel: str = "lanczos", value: str = "v") -> DataFrame:
    """(image_id, y, x, value): separable resampling by a box, triangle or Lanczos filter, columns first; values are not rounded."""
    spark = pixels.sparkSession
    across, down = (spark.createDataFrame(filter_weights(a, b, kernel), f"n{c} int, {c} int, w{c} double") for a, b, c in ((w, new_w, "x"), (h, new_h, "y")))
    # The tables of weights have a few rows per new line or column.
    rows = pixels.join(F.broadcast(across), "x").groupBy("image_id", "y", F.col("nx").alias("x")).agg(F.sum(F.col(value) * F.col("wx")).alias(value))
    return rows.join(F.broadcast(down), "y").groupBy("image_id", F.col("ny").alias("y"), "x").agg(F.sum(F.col(value) * F.col("wy")).alias(value))


def block_means(pixels: DataFrame, side_y: int, side_x: int, value: str = "v") -> DataFrame:
    """Area resampling by whole blocks."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / side_y).cast("int").alias("y"), F.floor(F.col("x") / side_x).cast("int").alias("x")).agg(F.avg(value).alias(value))


def turned(pixels: DataFrame, h: int, w: int, quarter_turns: int, flip: bool) -> DataFrame:
    """Counter-clockwise quarter turns, then an optional upside-down flip, as a projection of coordinates."""
    y, x = F.col("y"), F.col("x")
    for _ in range(quarter_turns % 4):
        y, x, h, w = F.lit(w - 1) - x, y, w, h
    return pixels.withColumns({"y": (F.lit(h - 1) - y) if flip else y, "x": x})


def masked_pool(tokens: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(img_id, pooled): token vectors weighted by coverage, over the larger of the weights' sum and a floor."""
    long = tokens.select("img_id", "coverage", F.posexplode(F.col("tok").cast("array<double>")).alias("pos", "v"))
    per = long.groupBy("img_id", "pos").agg((F.sum(F.col("v") * F.col("coverage")) / F.greatest(F.sum("coverage"), F.lit(floor))).alias("p"))
    return per.groupBy("img_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("pooled"))


def augmentation_pairs(patches: DataFrame, targets: DataFrame) -> DataFrame:
    """Each training patch with each target of another slide: an equi-join on all targets but the own, by exploding the checked, short target list."""
    listed = targets.agg(F.sort_array(F.collect_list("target_id")).alias("targets"))
    return patches.crossJoin(F.broadcast(listed)).select(*patches.columns, F.explode(F.filter("targets", lambda t: t != F.col("slide_id"))).alias("target_id"))


def tissue_mask(grey: DataFrame, max_object: int = 1499, max_hole: int = 5000, small_radius: int = 3, wide_radius: int = 5) -> DataFrame:
    """(image_id, y, x, m): pixels of high local entropy, opened, closed, without small objects and holes.

    The threshold comes from the wide disk's entropies, the mask from the small disk's.
    """
    limit = entropy_threshold(local_entropy(grey, wide_radius))
    ent = local_entropy(grey, small_radius).join(F.broadcast(limit), "image_id")
    mask = ent.select("image_id", "y", "x", (F.col("entropy") >= F.col("threshold")).alias("m"))
    mask = cut(closed(closed(opened(mask, 1), 3), 5, square=False))
    return without_small_holes(cut(without_small_objects(mask, max_object)), max_hole)


def normalised_crops(pixels: DataFrame, inside: DataFrame, target_mean: list, target_std: list) -> DataFrame:
    """Whole crops moved to the target colours by the statistics of the pixels inside their polygon; crops without any stay as they are."""
    stats = colour_stats(pixels.join(inside, ["image_id", "y", "x"], "left_semi"))
    done = normalise_colour(pixels, stats, target_mean, target_std)
    rest = pixels.join(stats, "image_id", "left_anti").withColumns({"nr": F.col("r"), "ng": F.col("g"), "nb": F.col("b")})
    return done.unionByName(rest)
