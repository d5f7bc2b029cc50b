"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

#: Cells of all labels together: their centres, at most so many, are what is sent to every task.
MAX_CELLS = 2048
#: Vectors that the cells are fitted on, at most; every vector is indexed and compared.
FIT_ROWS = 20_480


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres that maximise the summed cosine; an emptied cell takes the worst-served vector."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ centres.T
        own = score.argmax(1)
        best = score[np.arange(len(x)), own]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        for j in np.flatnonzero(norm < 1e-12):
            i = int(best.argmin())
            sums[j], norm[j], best[i] = x[i], 1.0, 2.0
        centres = sums / norm[:, None]
    return centres


def fit_cells(unique: DataFrame, cell_rows: int) -> dict[tuple, np.ndarray]:
    """Centres per (label, dimensions), for those that need more than one cell."""
    counts = unique.groupBy("label", "dims").count().where(F.col("count") > cell_rows).orderBy(F.desc("count"), "label", "dims").limit(MAX_CELLS // 2).collect()
    total = sum(r["count"] for r in counts)
    wanted = {(r["label"], r["dims"]): max(2, min(math.ceil(r["count"] / cell_rows), MAX_CELLS * r["count"] // (2 * total))) for r in counts}
    if not wanted:
        return {}

    def fit(batches):
        by: dict[tuple, list[bytes]] = {}
        for batch in batches:
            for label, dims, vec in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by.setdefault((label, dims), []).append(vec)
        for key, rows in sorted(by.items()):
            if key in wanted and len(rows) >= 2:
                x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                centres = spherical_kmeans(x, min(wanted[key], max(2, len(rows) // 8)))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([centres.tobytes()])], ["label", "dims", "centres"])

    sample = unique.orderBy(F.xxhash64("uid"), "uid").select("label", "dims", "vec").limit(FIT_ROWS)
    found = sample.coalesce(1).mapInArrow(fit, "label string, dims int, centres binary").collect()  # at most MAX_CELLS centres
    return {(r["label"], r["dims"]): np.frombuffer(bytes(r["centres"]), "<f8").reshape(-1, r["dims"] // 8) for r in found}


def unique_vectors(emb: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, label, dims, vec bytes; vec null if it links with nothing), and the distinct vectors with a number each."""

    def run(batches):
        for batch in batches:
            out = []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ok = label is not None and v and not any(c is None for c in v)
                if ok:
                    x = np.asarray(v, np.float64)
                    norm = np.linalg.norm(x)
                    if norm > 0 and not math.isfinite(norm) and np.isfinite(x).all():  # squares overflow, the direction doesn't
                        x = x / np.abs(x).max()
                    ok = bool(np.isfinite(x).all() and np.abs(x).max() > 0)
                    if ok and (norm == 0 or norm < 1e-150):
                        x = x / np.abs(x).max()
                out.append((x + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    rows = emb.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = stored(rows.mapInArrow(run, "vec_id long, label string, vec binary").withColumn("dims", F.length("vec")), "vectors")
    unique = rows.where("vec IS NOT NULL").groupBy("label", "dims", "vec").agg(F.min("vec_id").alias("root"), F.count("*").alias("copies"))
    return rows, stored(stored(unique, "unique").withColumn("uid", F.monotonically_increasing_id()), "unique")


def cell_pairs(unique: DataFrame, threshold: float, cell_rows: int, block_rows: int) -> DataFrame:
    """Blocks of a cell's vectors against blocks of the queries that can have a link in it.

    If x is within chord r of some y of the cell with centre c', then x lies at most r beyond the plane
    that parts c' from x's own centre c: x.(c - c') <= r |c - c'|. Queries go to all such cells, so no link is lost.
    """
    centres = fit_cells(unique, cell_rows)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def assign(batches):
        for batch in batches:
            labels, dims, uids, vecs, copies = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for label, d, uid, vec, n in zip(labels, dims, uids, vecs, copies):
                c = centres.get((label, d))
                if c is None:
                    out += [(label, d, 0, True, uid, vec, n), (label, d, 0, False, uid, vec, n)]
                    continue
                x = np.frombuffer(vec, "<f8")
                score = c @ (x / np.linalg.norm(x))
                own = int(score.argmax())
                gap = np.linalg.norm(c[own] - c, axis=1)
                out.append((label, d, own, True, uid, vec, n))
                out += [(label, d, int(k), False, uid, vec, n) for k in np.flatnonzero(score[own] - score <= reach * gap)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64()]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["label", "dims", "cell", "held", "uid", "vec", "copies"])

    placed = stored(unique.select("label", "dims", "uid", "vec", "copies").mapInArrow(assign, "label string, dims int, cell int, held boolean, uid long, vec binary, copies long"), "placed")
    counts = placed.groupBy("label", "dims", "cell", "held").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    block = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    blocks = placed.join(counts, ["label", "dims", "cell", "held"]).groupBy("label", "dims", "cell", "held", block.alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct("uid", "copies", "vec")).alias("rows")).withColumn("rows", F.col("rows"))
    blocks = blocks.select("label", "dims", "cell", "held", *[F.col(f"rows.{c}").alias(c) for c in ("uid", "copies", "vec")])
    held = blocks.where("held").drop("held")
    asks = blocks.where("NOT held").drop("held").withColumnsRenamed({"uid": "quid", "copies": "qcopies", "vec": "qvec"})
    return held.join(asks, ["label", "dims", "cell"]).select("uid", "copies", "vec", "quid", "qvec")


def block_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """(uid, links, root): per pair of blocks, the vectors that a query links with and a spanning forest of the links."""

    def run(batches):
        for batch in batches:
            for uid, copies, vec, quid, qvec in zip(*(batch.column(i).to_pylist() for i in range(5))):
                t, q = (np.frombuffer(b"".join(v), "<f8").reshape(len(v), -1) for v in (vec, qvec))
                cos = (q @ t.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(t, axis=1)[None]
                tu, qu = np.array(uid), np.array(quid)
                near = (cos >= threshold) & (qu[:, None] != tu[None])
                if not near.any():
                    continue
                links = near @ np.array(copies)
                lq, lt, far = qu.copy(), tu.copy(), np.iinfo(np.int64).max
                while True:
                    nq = np.minimum(lq, np.where(near, lt[None], far).min(1))
                    nt = np.minimum(lt, np.where(near, nq[:, None], far).min(0))
                    if (nq == lq).all() and (nt == lt).all():
                        break
                    lq, lt = nq, nt
                asked, met = near.any(1), near.any(0)
                out = [np.concatenate(p) for p in ((qu[asked], tu[met]), (links[asked], np.zeros(met.sum(), np.int64)), (lq[asked], lt[met]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["uid", "links", "root"])

    return pairs.mapInArrow(run, "uid long, links long, root long")


def embedding_groups(
    emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cell_rows: int = 1000, block_rows: int = 1024
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector: links of cosine >= threshold between vectors of one label.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without label, link with
    nothing, nor do vectors of different lengths. Equal vectors are compared once and counted as often as they come, repeated rows
    too. component_id is the smallest vec_id reachable; an empty table gives an empty result.
    """
    rows, unique = unique_vectors(emb, id_col, vec_col, label_col)
    found = stored(block_links(cell_pairs(unique, threshold, cell_rows, block_rows), threshold), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    group = connected_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    named = unique.join(links, "uid", "left").join(group, F.col("uid") == F.col("node"), "left")
    named = stored(named.select("label", "dims", "vec", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component")), "named")
    roots = named.groupBy("component").agg(F.min("root").alias("component_id"))
    named = named.join(roots, "component").select("label", "dims", "vec", "n_links", "component_id")
    out = rows.join(named, ["label", "dims", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, len(embedding) AS d FROM embeddings),
ok AS (SELECT r, vec_id, label, v, d FROM e WHERE label IS NOT NULL AND d > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.d = b.d AND a.r <> b.r
          AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
walk AS (WITH RECURSIVE w(a, b) AS (SELECT r, r FROM e UNION SELECT w.a, l.b FROM w JOIN links l ON w.b = l.a) SELECT a, b FROM w),
comp AS (SELECT w.a, min(e.vec_id) AS component_id FROM walk w JOIN e ON w.b = e.r GROUP BY w.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.r) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN comp c ON c.a = e.r
"""
