"""Hand-checked cases and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantor.operators import cluster as C
from vantor.operators import metrics as M
from vantor.operators import neighbors as N
from vantor.operators import projection as P
from vantor.operators import raster as R
from vantor.operators import selection as S
from vantor.operators import trees
from vantor.sources import files


def vectors(spark, rows, labels=None):
    return spark.createDataFrame([(i, [float(x) for x in np.atleast_1d(v)], int(labels[i]) if labels is not None else 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")


def runs(spark, *labels):
    return spark.createDataFrame([(s, i, x) for s, own in enumerate(labels) for i, x in enumerate(own)], "seed int, vec_id long, label int")


A, B = [0, 0, 0, 1, 1, 1, 2, 2, -1, -1], [0, 0, 1, 1, 1, 1, 2, -1, 2, -1]


def test_agreement_of_two_runs(spark):
    r = M.agreement(runs(spark, A, B)).first()
    assert r.common == 7 and r.common_ratio == pytest.approx(0.7)
    assert r.ari == pytest.approx(0.444444, abs=1e-6) and r.ami == pytest.approx(0.503269, abs=1e-6)
    assert r.noise_agreement == pytest.approx(0.8) and r.noise_jaccard == pytest.approx(1 / 3)


def test_agreement_without_common_points(spark):
    r = M.agreement(runs(spark, [-1, -1, 0], [0, 1, -1])).first()
    assert r.common == 0 and r.ari is None and r.ami is None


def test_agreement_with_itself(spark):
    r = M.agreement(runs(spark, A, A)).first()
    assert r.ari == 1 and r.ami == pytest.approx(1)


def test_recovery(spark):
    got = {r.cluster: (round(r.mean_jaccard, 6), r.status) for r in M.cluster_recovery(runs(spark, A, B), 0).collect()}
    assert got == {0: (0.666667, "borderline"), 1: (0.75, "solid"), 2: (0.333333, "dissolved")}


def test_neighbor_preservation(spark):
    high, low = vectors(spark, [0, 1, 3, 6, 10, 15, 21]), vectors(spark, [0, 1, 3, 6, 10, 2, 21])
    got = {r.k: r for r in M.neighbor_preservation(high, low, (1, 2, 3)).collect()}
    want = {1: (0.742857, 0.771429, 0.571429, 0.404762), 2: (0.673469, 0.734694, 0.5, 0.166667), 3: (0.642857, 0.738095, 0.619048, 0.119048)}
    for k, w in want.items():
        assert (got[k].trustworthiness, got[k].continuity, got[k].qnn, got[k].lcmc) == pytest.approx(w, abs=1e-6)
    assert got[1].auc_lcmc == pytest.approx(0.230159, abs=1e-6)
    with pytest.raises(ValueError):
        M.neighbor_preservation(high, low, (4,))


def test_compactness(spark):
    d = vectors(spark, [(0, 0), (0, 1), (4, 0), (4, 1), (4, 2), (10, 0)], [0, 0, 1, 1, 1, 2])
    s = {r.i: r.silhouette for r in M.silhouette_samples(d).collect()}
    assert [s[i] for i in range(6)] == pytest.approx([0.761815, 0.755026, 0.630683, 0.753789, 0.65097, 0], abs=1e-6)
    assert M.davies_bouldin(d).first()[0] == pytest.approx(0.229476, abs=1e-6)
    assert M.calinski_harabasz(d).first()[0] == pytest.approx(40.9)


def test_size_penalty(spark):
    labels = spark.createDataFrame([(0,)] * 10 + [(1,)] * 2, "label int")
    r = S.size_penalty(labels, 3, 5).first()
    assert r.penalty == pytest.approx(1.36) and r.n_small == 2 and r.small_samples == 2 and r.small_ratio == pytest.approx(2 / 12)


def test_normalized_rank(spark):
    d = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0), (3, 2.0)], "i int, v double").withColumn("r", S.normalized_rank("v"))
    assert [r.r for r in d.orderBy("i").collect()] == pytest.approx([1, 1 / 6, 1 / 6, 2 / 3])


def test_split_by_largest_remainder(spark):
    d = S.split_items(spark.range(10), "id", 0.7, 0.15).groupBy("split").count()
    assert {r.split: r["count"] for r in d.collect()} == {"train": 7, "test": 2, "valid": 1}


def test_validity_order(spark):
    d = spark.createDataFrame([(3, 0.9, float("nan"))], "n_clusters int, noise_ratio double, dbcv double")
    assert d.select(S.seed_validity(6, 12, 0.33)).first()[0] == "too_few_clusters"


def test_modal_count_prefers_the_first_met(spark):
    d = spark.createDataFrame([(0, 6, True), (1, 7, True), (2, 7, True), (3, 6, True)], "seed int, n_clusters int, valid boolean")
    r = S.modal_count(d).first()
    assert (r["mode"], r.ratio) == (6, 0.5)


def test_weights():
    assert S.voting_weights({"qnn": 0.2})["qnn"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        S.voting_weights({"other": 1.0})


def test_bounding_box(spark):
    p = spark.createDataFrame([(1, [(1.5, 2.0), (3.0, 2.0), (3.0, 5.0)], 4, 6)], "polygon_id int, pts array<struct<x: double, y: double>>, w int, h int")
    r = R.bounding_box(p, 2, "w", "h").first()
    assert (r.x0, r.y0, r.x1, r.y1) == (0, 0, 4, 6)


def test_colour_round_trip(spark):
    px = spark.range(64).select(F.lit(0).alias("image_id"), (F.col("id") * 4).cast("int").alias("r"), (255 - F.col("id") * 3).cast("int").alias("g"), (F.col("id") % 7 * 36).cast("int").alias("b"))
    r, g, b = R.lab_to_rgb(F.col("lab_l"), F.col("lab_a"), F.col("lab_b"))
    bad = R.with_lab(px).where((F.abs(r - F.col("r")) > 1) | (F.abs(g - F.col("g")) > 1) | (F.abs(b - F.col("b")) > 1))
    assert bad.count() == 0


def test_tile_grid(spark):
    s = spark.createDataFrame([(1, 300, 400, 16.0, 6400, 4800)], "slide_id int, mask_h int, mask_w int, ds double, width int, height int")
    got = R.tile_grid(s, 2000, 2000).collect()
    assert {(r.my, r.mx, r.sx) for r in got} == {(y, x, x * 16) for y in (0, 125) for x in (0, 125, 250)}


def test_pick_targets(spark):
    s = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "image_id int, mean array<double>")
    assert sorted(r.place for r in R.pick_targets(s, 4).collect()) == [0, 3, 6, 9]
    with pytest.raises(ValueError):
        R.pick_targets(s, 11)


def blobs(seed=0, n=60):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.2, (n, 2)) for c in ((0, 0), (4, 0), (0, 4))]), np.repeat([0, 1, 2], n)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_density_clusters(spark):
    x, y = blobs()
    d = vectors(spark, x, y).withColumnRenamed("embedding", "vec")
    got = C.density_clusters(d, 10, 5).orderBy("vec_id").toPandas()
    clustered = got.label >= 0
    assert clustered.mean() > 0.8 and same_partition(got.label[clustered], y[clustered])
    assert got.strength.between(0, 1).all() and (got.strength[~clustered] == 0).all()


def test_density_validity():
    x, y = blobs()
    good, bad = C.density_validity(x, y), C.density_validity(x, np.random.default_rng(1).permutation(y))
    assert good > 0.5 > bad and np.isnan(C.density_validity(x, np.zeros(len(x))))


def cells_of(monkeypatch, module):
    """The sizes of the matrices of distances that a module asks for."""
    seen, real = [], module.distances
    monkeypatch.setattr(module, "distances", lambda a, b, metric: seen.append(len(a) * len(b)) or real(a, b, metric))
    return seen


def test_density_validity_holds_no_pairs(monkeypatch):
    x, y = blobs(n=1200)
    whole = np.sqrt(((x[:1200, None] - x[None, :1200]) ** 2).sum(2)).round(9)
    inverse = np.divide(1.0, whole, out=np.zeros_like(whole), where=whole > 0)
    assert np.allclose(C._spread(x[:1200]), ((inverse**2).sum(1) / 1199) ** -0.5)
    seen = cells_of(monkeypatch, C), cells_of(monkeypatch, trees)
    assert 0.5 < C.density_validity(x, y) < 1 and max(map(max, seen)) <= C.CELLS


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_trees_of_blocks(monkeypatch, metric):
    """Weights of the tree and core distances against all pairs; rounded points have copies and equal distances."""
    x = np.round(np.vstack([blobs(n=500)[0], np.random.default_rng(3).uniform(-9, 9, (300, 2))]), 1)
    full = N.distances(x, x, metric)
    core = np.partition(full, 5, axis=1)[:, 5]
    seen = cells_of(monkeypatch, trees)
    assert (trees.Space(x, metric).core(5) == core).all()
    a, b = np.triu_indices(len(x), 1)
    want = trees.sparse_tree(a, b, np.maximum(np.maximum(full[a, b], core[a]), core[b]), len(x))
    got = trees.tree_by_blocks(x, core, metric)
    assert max(seen) <= trees.LEAF * trees.LEAF * trees.GROUP and np.array_equal(got, want)
    grown = trees.tree_by_rows(x, core, metric)
    assert np.array_equal(np.sort(grown[:, 2]), want[:, 2])
    labels, strength = C.condensed_labels(want, len(x), 10)
    for tree in (grown, trees.sparse_tree(len(x) - 1 - a, len(x) - 1 - b, np.maximum(np.maximum(full[a, b], core[a]), core[b]), len(x))):
        tree = tree if tree is grown else np.column_stack([len(x) - 1 - tree[:, :2], tree[:, 2]])
        other, also = C.condensed_labels(tree, len(x), 10)
        assert (other == labels).all() and (also == strength).all()


def test_density_clusters_of_pairs_of_blocks(spark, monkeypatch):
    """Trees of pairs of blocks in all tasks give the labels of one tree in one task."""
    x, y = blobs(n=150)
    d = vectors(spark, np.hstack([np.round(x, 1), np.random.default_rng(5).normal(0, 0.1, (450, 18))]), y).withColumnRenamed("embedding", "vec")
    edges = C.tree_candidates(d, 5, rows=64)
    assert edges.count() < 450 * 449 / 4
    one = C.density_clusters(d.withColumn("g", F.lit(0)), 10, 5, by="g").orderBy("vec_id").collect()
    monkeypatch.setattr(C.tree_candidates, "__defaults__", (*C.tree_candidates.__defaults__[:-1], 64))
    many = C.density_clusters(d, 10, 5).orderBy("vec_id").collect()
    assert [(r.vec_id, r.label) for r in many] == [(r.vec_id, r.label) for r in one] and len({r.label for r in one}) >= 3
    assert [r.strength for r in many] == pytest.approx([r.strength for r in one])
    assert [r.label for r in C.density_clusters(d.limit(1), 10, 5).collect()] == [-1] and not C.density_clusters(d.where("vec_id < 0"), 10, 5).collect()


def test_mixture(spark):
    x, y = blobs()
    d = vectors(spark, x, y).withColumnRenamed("embedding", "vec")
    fits = C.fit_mixtures(d, [{"k": 3, "covariance": c, "n_init": 2} for c in C.COVARIANCES])
    for f in fits:
        got = C.assign_mixture(d, f["model"]).orderBy("vec_id").toPandas()
        assert same_partition(got.label, y) and np.allclose([sum(p) for p in got.prob], 1)
    assert C.parameter_count(3, 2, "full") == 3 * 3 + 6 + 2


def test_communities(spark):
    x, y = blobs()
    edges = N.adjacency(vectors(spark, x, y), 10)
    got = C.graph_communities(edges, [{"resolution": 0.05}]).orderBy("id").toPandas()
    assert len(set(zip(got.label, y))) == len(set(got.label))
    q = M.graph_quality(edges, vectors(spark, x, y).select(F.col("vec_id").alias("id"), "label")).first()
    assert 0.5 < q.modularity < 1


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) @ np.array([[3, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0.1, 0]])
    m = P.principal_components(vectors(spark, x), 0.9)
    assert np.allclose(m["loadings"] @ m["loadings"].T, np.eye(len(m["loadings"])), atol=1e-9)
    assert m["ratio"].sum() > 0.9 and m["ratio"][:-1].sum() <= 0.9


def test_manifold_keeps_neighbours(spark):
    x, y = blobs()
    low = P.manifold(vectors(spark, x), [{"n_neighbors": 10, "n_components": 2}], epochs=100).select("vec_id", F.col("vec").alias("embedding"))
    assert M.neighbor_preservation(vectors(spark, x), low, (10,)).first().trustworthiness > 0.85


def test_knn_ties_and_duplicates(spark):
    got = N.knn(vectors(spark, [0, 0, 0, 1, 1]), 2).orderBy("i", "rank").collect()
    assert [(r.i, r.j) for r in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 4), (3, 0), (4, 3), (4, 0)]


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.npy").write_bytes(files.npy_bytes(x))
    got = files.read_npy(spark, str(tmp_path)).orderBy("index").collect()
    assert [list(r.row) for r in got] == x.tolist()
    for n in ("a.PNG", "b.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r.stem for r in files.list_files(spark, str(tmp_path)).collect()} == {"a", "b"}
    xml = tmp_path / "x"
    xml.mkdir()
    points = "".join(f'<Coordinate X="{i}" Y="{i * 2}"/>' for i in range(3))
    (xml / "s1.xml").write_text(f"<A><Annotations><Annotation><Coordinates>{points}</Coordinates></Annotation><Annotation><Coordinates><Coordinate X='1' Y='1'/></Coordinates></Annotation></Annotations></A>")
    p = files.read_polygons(spark, str(xml)).collect()
    assert [(r.slide_id, r.polygon_id, len(r.pts)) for r in p] == [("s1", 0, 3)]


def test_image_model(spark):
    from vantor.operators.backbone import BlockMeans, coverage, embed_images

    image = np.zeros((8, 8, 3), np.uint8)
    image[:4] = 255
    mask = np.zeros((8, 8), np.uint8)
    mask[:4] = 1
    d = spark.createDataFrame([(1, 8, 8, bytearray(image.tobytes()), bytearray(mask.tobytes())), (2, 8, 8, bytearray(image.tobytes()), None)], "id long, height int, width int, pixels binary, mask binary")
    got = {r.id: r.vec for r in embed_images(d, BlockMeans(2)).collect()}
    assert got[1] == pytest.approx([1, 1, 1]) and got[2] == pytest.approx([0.5, 0.5, 0.5])
    assert coverage(mask, 2).tolist() == [1, 1, 0, 0]


def filtered_png(image, kinds):
    """A PNG whose rows use the given filters, made by the format's rules."""
    import struct
    import zlib

    h, w, s = image.shape
    x, out = image.astype(int).reshape(h, -1), b""
    for y in range(h):
        kind, above = kinds[y % len(kinds)], x[y - 1] if y else np.zeros(w * s, int)
        left, corner = np.concatenate([np.zeros(s, int), x[y][:-s]]), np.concatenate([np.zeros(s, int), above[:-s]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out += bytes([kind]) + ((x[y] - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[s], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 3, 4])
def test_png_filters(samples):
    from vantor.sources import images

    x = np.random.default_rng(0).integers(0, 256, (11, 7, samples)).astype(np.uint8)
    assert (images.png_decode(filtered_png(x, (0, 1, 2, 3, 4))) == x).all()
    if samples < 4:
        assert (images.png_decode(images.png_encode(x if samples == 3 else x[:, :, 0])) == x).all()
    with pytest.raises(ValueError):
        images.png_decode(b"GIF89a")


def test_tiles_have_no_seams(spark):
    rng = np.random.default_rng(1)
    rows = [(i, y, x, int(rng.integers(0, 5))) for i in range(2) for y in range(17) for x in range(23) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    there = {(i, y, x): v for i, y, x, v in rows}
    for side in (5, 256):
        got = {(r.image_id, r.y, r.x): r.entropy for r in R.local_entropy(px, 2, side=side).collect()}
        assert got.keys() == there.keys()
        for (i, y, x), e in got.items():
            near = [there[i, y + a, x + b] for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and (i, y + a, x + b) in there]
            p = np.bincount(near) / len(near)
            assert e == pytest.approx(-sum(q * np.log2(q) for q in p if q), abs=1e-9)
        grown = {(r.image_id, r.y, r.x): r.m for r in R.morphology(px.withColumn("m", F.col("v") == 0), 1, True, side=side).collect()}
        assert all(m == any(there.get((i, y + a, x + b)) == 0 for a in (-1, 0, 1) for b in (-1, 0, 1)) for (i, y, x), m in grown.items())


def test_history_leads_the_search():
    from vantor.plans import search as H

    space = H.combos(a=list(range(8)), b=list(range(8)), c=list(range(6)))
    value = lambda c: -abs(c["a"] - 5) - abs(c["b"] - 2) - abs(c["c"] - 4)

    def found(sampler, n=60):
        best = -math.inf
        for _ in range(n):
            c = sampler.ask()
            sampler.tell(c, value(c))
            best = max(best, value(c))
        assert len({tuple(c.values()) for c, _ in sampler.history}) == n
        return best

    led = [found(H.HistorySampler(space, seed)) for seed in range(20)]
    drawn = [found(H.GridSampler(space, 60, seed)) for seed in range(20)]
    assert np.mean(led) > np.mean(drawn) and np.mean(led) > -0.6
    assert [c for c, _ in (lambda s: (found(s), s.history))(H.HistorySampler(space, 3))[1]] == [c for c, _ in (lambda s: (found(s), s.history))(H.HistorySampler(space, 3))[1]]
    s = H.HistorySampler(space[:3])
    assert [s.ask() is None for _ in range(4)] == [False, False, False, True]
    s.tell(space[0], None)
    with pytest.raises(ValueError):
        H.sampler_of("x", space, 3)


def test_preservation_of_many_rows(spark, monkeypatch):
    """n * k * (2 n - 3 k - 1) is beyond an int; ten pairs stand for the neighbours."""
    pairs = spark.createDataFrame([(s, i, i + 1, 1, 31) for s in (0, 1) for i in range(5)], "space int, i long, j long, rank int, other int")
    monkeypatch.setattr(M, "neighbor_ranks", lambda *_: pairs)
    n = 200_000
    rows = {r.k: r for r in M.neighbor_preservation(spark.range(n), None, (5, 15)).collect()}
    for k, r in rows.items():
        assert r.trustworthiness == r.continuity == pytest.approx(1 - 2 * 5 * (31 - k) / (n * k * (2 * n - 3 * k - 1)), abs=1e-15)


def test_label_pairs_in_blocks(spark, monkeypatch):
    """Pairs of several blocks with copies, a missing vector and a missing label, against all pairs; no plan of rows of pairs."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(int(i), None if i == 7 else [float(v) for v in np.round(rng.normal(size=3), 1)], None if i % 11 == 5 else int(rng.integers(3))) for i in rng.permutation(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {}
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j:
                n, got = want.setdefault((a, b), [0, []])
                want[a, b][0] += 1
                got += [] if v is None or w is None else [round(math.dist(v, w), 9)]
    out = N.label_pairs(df)
    assert "mapInArrow" in out._jdf.queryExecution().toString() or "MapInArrow" in out._jdf.queryExecution().toString()
    got = {(r.li, r.lj): r for r in out.collect()}
    assert set(got) == set(want)
    for k, (n, d) in want.items():
        assert got[k].n == n and got[k].total == (pytest.approx(sum(d)) if d else None) and got[k].least == (min(d) if d else None)


def test_community_search_meets_vectors_once(spark, monkeypatch):
    """Neighbours once and compactness once for all trials, with the values of one trial at a time."""
    from vantor.plans import search as H

    x, y = blobs(n=40)
    d = vectors(spark, x, y).withColumnRenamed("embedding", "vec").drop("label")
    calls, real = [], N.met
    monkeypatch.setattr(N, "met", lambda a, b: calls.append(1) or real(a, b))
    got = {r.trial_number: r for r in H.search_communities(d, (6, 9), (0.05, 0.5), bounds=(2, 40), min_size=5).collect()}
    assert len(got) == 4 and len(calls) == 2
    for i, (k, resolution) in enumerate([(6, 0.05), (6, 0.5), (9, 0.05), (9, 0.5)]):
        labels = C.graph_communities(N.adjacency(d, k, vec_col="vec"), [{"resolution": resolution, "seed": 42 + i}]).select(F.col("id").alias("vec_id"), "label")
        want = M.silhouette_samples(d.join(labels, "vec_id"), vec_col="vec").agg(F.avg("silhouette")).first()[0]
        assert (got[i].n_neighbors, got[i].resolution) == (k, resolution) and got[i].silhouette == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_ranks_of_layouts_in_blocks(spark, monkeypatch, metric):
    """Neighbours and ranks of two layouts, with copies and ties, over many blocks and steps, against sorted rows of distances."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "STEP", 8)
    rng = np.random.default_rng(4)
    n, k = 260, 4
    spaces = [np.round(rng.normal(size=(n, d)), 1) for d in (3, 2, 1)]
    spaces[0][40:60] = spaces[0][:20]
    frames = [spark.createDataFrame([(i, x[i].tolist()) for i in rng.permutation(n).tolist()], "vec_id long, embedding array<double>") for x in spaces]
    places = []
    for x in spaces:
        d = N.distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        order = np.lexsort((np.broadcast_to(np.arange(n), d.shape), d), axis=1)
        places.append(np.argsort(order, axis=1) + 1)
    want = set()
    for w in (0, 1):
        for space, (own, other) in enumerate([(places[0], places[1 + w]), (places[1 + w], places[0])]):
            want |= {(w, space, i, j, int(own[i, j]), int(other[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(own <= k)))}
    got = [tuple(r) for r in N.layouts_ranks(frames[0], frames[1:], k, metric=metric).select("which", "space", "i", "j", "rank", "other").collect()]
    assert len(got) == len(want) and set(got) == want


def test_manifold_search_meets_vectors_once(spark, monkeypatch):
    """One pass for neighbours and two for what all layouts keep of them, with the values of one layout at a time."""
    from vantor.plans import search as H

    d = vectors(spark, blobs(n=30)[0])
    calls, real = [], N.met
    monkeypatch.setattr(N, "met", lambda a, b: calls.append(1) or real(a, b))
    rows, layouts = H.search_manifold(d, H.combos(n_neighbors=[5, 8], min_dist=[0.0, 0.1], n_components=[2], seed=[1]), ks=(3, 6), epochs=10, vec_col="embedding")
    got = {r.config_no: r for r in rows.collect()}
    assert len(got) == 4 and len(calls) == 3
    for i in (0, 3):
        low = layouts.where(F.col("config") == i).select("vec_id", F.col("vec").alias("embedding"))
        want = M.neighbor_preservation(d, low, (3, 6)).agg(*[F.avg(x).alias(x) for x in ("trustworthiness", "continuity", "qnn", "lcmc")]).first()
        assert all(got[i][x] == pytest.approx(want[x], abs=1e-12) for x in want.asDict())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_silhouettes_of_many_labels(spark, monkeypatch, metric):
    """Many labels, single ones too, over many blocks, against all pairs; a row per vector and labelling leaves the blocks, not one per label."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "STEP", 8)
    rng = np.random.default_rng(6)
    n = 240
    x = np.round(rng.normal(size=(n, 2)), 1)
    labels = [rng.integers(0, 90, n), np.where(rng.random(n) < 0.3, -9, rng.integers(0, 3, n)), np.zeros(n, int)]
    df = spark.createDataFrame([(i, x[i].tolist(), *[int(l[i]) for l in labels]) for i in rng.permutation(n).tolist()], "vec_id long, embedding array<double>, l0 long, l1 long, l2 long")
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for k, l in enumerate(labels):
        for i in np.flatnonzero(l != -9):
            means = {c: d[i, l == c].sum() / max(1, (l == c).sum() - (c == l[i])) for c in set(l.tolist()) - {-9}}
            a, b = means.pop(l[i]), min(means.values(), default=None)
            want[k, int(i)] = 0.0 if b is None or (l == l[i]).sum() < 2 else (b - a) / max(a, b)
    assert N.label_means(df, ["l0", "l1", "l2"], metric=metric, missing=-9).count() == len(want)
    got = {(r.which, r.i): r.silhouette for r in M.silhouettes(df, ["l0", "l1", "l2"], -9, metric=metric).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_pipelines_side_by_side(spark, monkeypatch):
    """All layouts in one job, and two passes over pairs of blocks for each pipeline, with the rows of one pipeline at a time."""
    from vantor.plans import search as H

    d = vectors(spark, blobs(n=30)[0])
    calls, real, jobs, layouts = [], N.met, [], P.layouts_of
    monkeypatch.setattr(N, "met", lambda a, b: calls.append(1) or real(a, b))
    monkeypatch.setattr(P, "layouts_of", lambda *a, **k: jobs.append(1) or layouts(*a, **k))
    got = H.evaluate_pipelines(d, [("a", 0.95), ("b", 0.5)], n_components=2, epochs=20, min_cluster_size=5, min_samples=3).collect()
    assert len(calls) == 4 and len(jobs) == 1
    for r, variance in zip(got, (0.95, 0.5)):
        w = H.evaluate_pipeline(d, r.name, variance, n_components=2, epochs=20, min_cluster_size=5, min_samples=3).first()
        assert (r.n_clusters, r.noise_ratio) == (w.n_clusters, w.noise_ratio) and r.silhouette == (None if w.silhouette is None else pytest.approx(w.silhouette, abs=1e-9))
    assert [r.name for r in got] == ["a", "b"]
