"""Queries of the fitted models and searches, which SQL has no form for; tests hold them to properties and small exact cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import neighbors as N
from ..operators import projection as P
from . import search as H
from .queries import emb, query, rounded

#: Seeds of a stability search.
SEEDS = list(range(1, 16))
LAYOUT = {"n_neighbors": 15, "min_dist": 0.1, "n_components": 2, "seed": 42}


def reduced(spark, sf) -> DataFrame:
    return H.embedded(emb(spark, sf))


def small(spark, sf) -> DataFrame:
    """The whole reduced vectors: all components that explain 95 % of the variance."""
    return reduced(spark, sf)


@query("x2_principal_components")
def principal_components(spark, sf):
    return reduced(spark, sf)



@query("x3_fuzzy_union")
def fuzzy_union(spark, sf):
    return rounded(P.fuzzy_union(P.smooth_weights(N.knn(emb(spark, sf), 15))), "weight")


@query("x3_manifold_layout")
def manifold_layout(spark, sf):
    return P.manifold(emb(spark, sf), [LAYOUT, {**LAYOUT, "seed": 43}], epochs=100)


@query("x5_density_clusters")
def density_clusters(spark, sf):
    return C.density_clusters(small(spark, sf), 10, 5)


@query("x4_layout_and_density")
def layout_and_density(spark, sf):
    layout = P.manifold(emb(spark, sf), [LAYOUT], epochs=100)
    return C.density_clusters(layout, 10, 5, by="config")


@query("m16_density_validity")
def density_validity(spark, sf):
    records, _ = H.stable_density_runs(P.manifold(emb(spark, sf), [LAYOUT, {**LAYOUT, "seed": 43}], epochs=50), [42, 43], 10, 5)
    return records


@query("x6_gaussian_mixture")
def gaussian_mixture(spark, sf):
    d = small(spark, sf)
    fit = C.fit_mixtures(d, [{"k": 4, "covariance": "full", "n_init": 2}], max_iter=30)[0]
    return C.assign_mixture(d, fit["model"])


@query("m19_information_criteria")
def information_criteria(spark, sf):
    fits = C.fit_mixtures(small(spark, sf), [{"k": k, "covariance": c} for k in (2, 4) for c in C.COVARIANCES], max_iter=20)
    rows = [(f["k"], f["covariance"], f["bic"], f["aic"], f["converged"], f["n_iter"]) for f in fits]
    return spark.createDataFrame(rows, "n_components int, covariance_type string, bic double, aic double, converged boolean, n_iter int")


@query("x9_graph_communities")
def graph_communities(spark, sf):
    return C.graph_communities(N.adjacency(emb(spark, sf), 15), [{"resolution": 1.0}, {"resolution": 0.05, "kind": "CPM"}, {"kind": "Modularity"}])


@query("x10_manifold_search")
def manifold_search(spark, sf):
    space = H.combos(n_neighbors=[10, 20], min_dist=[0.0, 0.1], n_components=[2], seed=[42])
    return H.search_manifold(emb(spark, sf), space, ks=(5, 10), epochs=30, vec_col="embedding")[0]


@query("x11_mixture_search")
def mixture_search(spark, sf):
    return H.search_mixtures(small(spark, sf), (2, 4), n_init=1, max_iter=20)[0]


@query("x12_community_search")
def community_search(spark, sf):
    return H.search_communities(small(spark, sf), (10, 15), (0.5, 1.0), bounds=(2, 40), min_size=5)


@query("x13_seed_stability")
def seed_stability(spark, sf):
    return H.evaluate_density_config(emb(spark, sf), {"n_neighbors": 15, "min_dist": 0.0, "n_components": 2}, SEEDS, 10, 5, epochs=30, vec_col="embedding")


@query("x15_pipeline_comparison")
def pipeline_comparison(spark, sf):
    return H.evaluate_pipelines(emb(spark, sf), [("pca95", 0.95), ("pca50", 0.5)], epochs=30, n_components=2)


@query("sk7_plot_points")
def plot_points(spark, sf):
    layout = P.manifold(emb(spark, sf), [LAYOUT], epochs=30).drop("config")
    return H.coordinates(layout.join(emb(spark, sf).select("vec_id", "label"), "vec_id"))
