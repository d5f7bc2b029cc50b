"""Inputs that stand in for tables the driver has none of, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

#: Five partitions of the embeddings with noise and moved labels.
RUNS = """SELECT s.seed, e.vec_id, CASE WHEN (e.vec_id * 7 + s.seed) % 11 = 0 THEN -1 WHEN (e.vec_id + s.seed) % 5 = 0 THEN (e.label + 1) % 10 ELSE e.label END AS label
FROM embeddings e CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS s(seed)"""
RUN_RECORDS = """SELECT CAST(id AS INT) AS seed, CAST(5 + (id * 7) % 4 AS INT) AS n_clusters, CAST(0.05 + (id % 6) * 0.06 AS DOUBLE) AS noise_ratio,
CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(0.2 + (id % 9) * 0.05 AS DOUBLE) END AS dbcv FROM range(30) AS t(id)"""
UMAP_TRIALS = """SELECT CAST(id AS INT) AS config_no, CAST(0.5 + ((id * 37) % 17) / CAST(40.0 AS DOUBLE) AS DOUBLE) AS trustworthiness, CAST(0.4 + ((id * 11) % 19) / CAST(40.0 AS DOUBLE) AS DOUBLE) AS continuity,
CAST(((id * 5) % 7) / CAST(10.0 AS DOUBLE) AS DOUBLE) AS qnn, CAST(((id * 3) % 11) / CAST(20.0 AS DOUBLE) AS DOUBLE) AS lcmc, CAST(((id * 13) % 5) / CAST(10.0 AS DOUBLE) AS DOUBLE) AS auc_lcmc, id % 8 <> 3 AS valid_solution FROM range(40) AS t(id)"""
GRAPH_TRIALS = """SELECT CAST(id AS INT) AS trial_number, CASE WHEN id % 9 = 4 THEN NULL ELSE CAST(((id * 7) % 13) / CAST(20.0 AS DOUBLE) AS DOUBLE) END AS silhouette, CAST(0.5 + ((id * 5) % 11) / CAST(10.0 AS DOUBLE) AS DOUBLE) AS davies_bouldin,
CAST(10 + ((id * 17) % 23) AS DOUBLE) AS calinski_harabasz, CAST(((id * 19) % 29) / CAST(30.0 AS DOUBLE) AS DOUBLE) AS quality, CAST(2 + id % 9 AS INT) AS n_clusters, CAST(3 + (id * 5) % 20 AS INT) AS min_size, id % 6 <> 5 AS valid_solution FROM range(50) AS t(id)"""
MIXTURE_TRIALS = """SELECT CAST(id AS INT) AS config_no, CAST(1000 + (id * 31) % 97 AS DOUBLE) AS bic, CAST(((id * 7) % 10) / CAST(10.0 AS DOUBLE) AS DOUBLE) AS penalty, id % 5 <> 0 AS valid_for_selection FROM range(40) AS t(id)"""
CONFIGS = """SELECT CAST(id AS INT) AS config_no, CAST(5 + id % 12 AS INT) AS min_samples, CAST(10 AS INT) AS min_cluster_size, CAST((id % 5) / CAST(4.0 AS DOUBLE) AS DOUBLE) AS valid_seed_ratio,
CASE WHEN id % 7 = 1 THEN NULL ELSE CAST(0.3 AS DOUBLE) END AS mean_dbcv, CASE WHEN id % 11 = 2 THEN NULL ELSE CAST(0.6 AS DOUBLE) END AS mean_ari,
CASE WHEN id % 13 = 3 THEN NULL ELSE CAST((id % 6) / CAST(10.0 AS DOUBLE) AS DOUBLE) END AS mean_common_ratio, CASE WHEN id % 17 = 4 THEN NULL ELSE CAST((id % 10) / CAST(10.0 AS DOUBLE) AS DOUBLE) END AS modal_ratio FROM range(200) AS t(id)"""
#: Memberships of three clusters per vector, and the stronger one's strength.
MEMBERS = """SELECT vec_id, CAST(CASE WHEN vec_id % 13 = 0 THEN -1 ELSE vec_id % 3 END AS INT) AS label, CAST(((vec_id * 37) % 101) / CAST(101.0 AS DOUBLE) AS DOUBLE) AS strength,
CAST(1 + vec_id % 5 AS DOUBLE) / CAST(6 + vec_id % 5 + vec_id % 3 AS DOUBLE) AS p0, CAST(2 + vec_id % 3 AS DOUBLE) / CAST(6 + vec_id % 5 + vec_id % 3 AS DOUBLE) AS p1,
CAST(3 AS DOUBLE) / CAST(6 + vec_id % 5 + vec_id % 3 AS DOUBLE) AS p2 FROM embeddings"""
#: Three images of 24 x 32 pixels.
PIXELS = """SELECT CAST(i.id AS INT) AS image_id, CAST(p.id / 32 AS INT) AS y, CAST(p.id % 32 AS INT) AS x, CAST((p.id * 7 + i.id * 31) % 256 AS INT) AS r, CAST((p.id * 13 + i.id * 17) % 256 AS INT) AS g,
CAST((p.id * 29 + i.id * 5) % 256 AS INT) AS b, CAST((p.id * p.id + i.id * 3) % 7 AS INT) AS v FROM (SELECT CAST(id AS BIGINT) AS id FROM range(768) AS t(id)) AS p CROSS JOIN (SELECT CAST(id AS BIGINT) AS id FROM range(3) AS t(id)) AS i"""
PIXELS = PIXELS.replace("p.id / 32", "FLOOR(p.id / 32.0)")
#: Polygons in slide coordinates and slides with their masks' sizes.
VERTICES = """SELECT * FROM (VALUES (1, 0, 0, 1.5, 2.0), (1, 0, 1, 13.0, 2.0), (1, 0, 2, 13.5, 15.0), (1, 0, 3, 4.2, 11.7), (1, 1, 0, 18.0, 1.0), (1, 1, 1, 28.0, 6.0), (1, 1, 2, 20.0, 19.5),
(2, 2, 0, 3.0, 3.0), (2, 2, 1, 9.0, 3.0), (2, 2, 2, 9.0, 9.0), (2, 2, 3, 3.0, 9.0), (2, 3, 0, 0.5, 20.5), (2, 3, 1, 30.0, 21.5)) AS t(slide_id, polygon_id, k, x, y)"""
SLIDES = """SELECT * FROM (VALUES (1, 300, 400, 16.0, 6400, 4800), (2, 250, 250, 8.0, 2010, 2000), (3, 60, 90, 4.0, 360, 240)) AS t(slide_id, mask_h, mask_w, ds, width, height)"""
