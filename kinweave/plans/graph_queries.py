"""Registered queries of the graph side, on the co-purchase graph: customers who bought the same part from the same supplier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import ergm, explain, graph_build, graph_community, graph_iterate, graph_local, graph_traverse, graph_walks, model, relational, target_statistics
from kinweave.plans import pipeline
from kinweave.plans.entity_queries import AS_OF, parts, read, recordings, releases, rounded
from kinweave.operators import early
from kinweave.validate import cut, dealt, forget


def members(spark, d) -> DataFrame:
    return recordings(spark, d).select("l_partkey", "l_suppkey", F.col("artist").alias("n")).distinct()


def weighted(spark, d) -> DataFrame:
    return graph_build.pair_counts(members(spark, d), ["l_partkey", "l_suppkey"], "n")


def edges(spark, d) -> DataFrame:
    """A written table: the operators read it several times."""
    return cut(weighted(spark, d).select("u", "v"))


def attributes(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment", F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("c_nationkey"))


def copurchase_edges(spark, d):
    return weighted(spark, d)


def size_adjusted_edges(spark, d):
    return rounded(graph_build.size_adjusted_edges(members(spark, d), ["l_partkey", "l_suppkey"], "n"), "weight")


def pair_examples(spark, d):
    m = members(spark, d).join(parts(spark, d).select("l_partkey", "p_name"), "l_partkey")
    return graph_build.pair_examples(m, ["l_partkey", "l_suppkey"], "n", "p_name")


def edge_cleanup(spark, d):
    e = weighted(spark, d)
    noisy = e.select(F.concat(F.lit(" "), F.col("u").cast("string")).alias("u"), F.col("v").cast("string").alias("v")).union(e.select(F.col("v").cast("string"), F.concat(F.col("u").cast("string"), F.lit("\t")))).union(e.select(F.col("u").cast("string"), F.col("u").cast("string"))).union(e.select(F.lit("  "), F.col("v").cast("string"))).union(e.select(F.lit(None).cast("string"), F.col("v").cast("string")))
    return graph_build.simple_graph(noisy)


def last_edge_weight(spark, d):
    li = recordings(spark, d).select(F.col("artist").alias("u"), F.col("l_suppkey").alias("v"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).alias("weight"), ((F.col("release_id") * 100 + F.col("l_linenumber")) * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"), "release_id")
    return graph_build.last_weight(li, "seq")


def edges_within(spark, d):
    return graph_build.within(edges(spark, d), attributes(spark, d).where("c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"), "node")


def graph_degree(spark, d):
    return rounded(graph_local.degree(edges(spark, d)), "log_degree")


def degree_summary(spark, d):
    return rounded(graph_local.degree_summary(edges(spark, d)), "mean_degree", "var_degree")


def log_binned_degree(spark, d):
    return rounded(graph_local.log_binned_clustering(edges(spark, d)), "centre", "mean_clustering")


def shared_partners_gwesp_weak(spark, d):
    return rounded(graph_local.edge_scores(edges(spark, d)), "gwesp_score", "weak_tie_frac")


def triangles_clustering_wedges(spark, d):
    return rounded(graph_local.clustering(edges(spark, d)), "clust_local")


def transitivity_triads(spark, d):
    return rounded(graph_local.global_clustering(edges(spark, d)), "transitivity", "average_clustering")


def homophily_shares(spark, d):
    return rounded(graph_local.same_share(edges(spark, d), attributes(spark, d), {"c_mktsegment": "same_role_share", "c_nationkey": "same_nation_share"}), "same_role_share", "same_nation_share")


def triangle_mixing(spark, d):
    return graph_local.triangle_mixing(edges(spark, d), attributes(spark, d), {"c_mktsegment": "role", "c_nationkey": "nation"})


def open_dyads(spark, d):
    return graph_local.open_dyads(edges(spark, d))


def graph_density_summary(spark, d):
    return rounded(graph_local.density(edges(spark, d)), "density", digits=10)


def connected_components(spark, d):
    return graph_iterate.connected_components(edges(spark, d))


def component_sizes(spark, d):
    return rounded(graph_iterate.component_sizes(graph_iterate.connected_components(edges(spark, d))), "node_share")


def hub_distance(spark, d):
    e = edges(spark, d)
    return graph_iterate.distance_to(e, graph_iterate.top_hubs(graph_local.degree(e), "degree", 5))


def kcore(spark, d):
    return graph_iterate.core_number(edges(spark, d))


def kcore_profile(spark, d):
    return graph_iterate.core_number(edges(spark, d)).groupBy("kcore").agg(F.count("*").alias("n"))


def eigen_centrality(spark, d):
    return graph_iterate.eigenvector(edges(spark, d))


def eigen_steps(spark, d):
    return rounded(graph_iterate.eigenvector(edges(spark, d), fixed=8), "eigencent", digits=8)


def pagerank(spark, d):
    return rounded(graph_iterate.pagerank(edges(spark, d)), "pagerank", digits=10)


def betweenness(spark, d):
    return rounded(graph_traverse.betweenness(edges(spark, d)), "betweenness", digits=9)


def closeness(spark, d):
    return rounded(graph_traverse.closeness(edges(spark, d), None), "closeness", digits=9)


def path_lengths(spark, d):
    return graph_traverse.path_lengths(edges(spark, d))


def path_length_summary(spark, d):
    return rounded(graph_traverse.path_summary(path_lengths(spark, d)), "mean_distance")


def approximate_diameter(spark, d):
    e = edges(spark, d)
    start = graph_iterate.top_hubs(graph_local.degree(e), "degree", 1).first()["node"]
    return spark.createDataFrame([(graph_traverse.approximate_diameter(e, start),)], "diameter long")


def component_diameters(spark, d):
    return graph_traverse.diameters(edges(spark, d))


def hub_distances_from_sources(spark, d):
    e = edges(spark, d)
    return graph_traverse.distances(e, graph_iterate.top_hubs(graph_local.degree(e), "degree", 5))


def sampled_closeness(spark, d):
    return rounded(graph_traverse.closeness(edges(spark, d), 50), "closeness", digits=9)


def induced_sample(spark, d):
    return graph_build.sampled_subgraph(edges(spark, d), 100, 5)


def sample_adjacency(spark, d):
    w = cut(weighted(spark, d))
    return graph_build.adjacency(w, graph_build.sample_nodes(graph_build.vertices(w), "node", 40), "node", "weight")


def _records(spark, d):
    """Orders as recordings: an author for each supplier of its lines, without an id every seventh, relations by the return flag."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).alias("mbid"), F.element_at(F.create_map(*map(F.lit, ["N", "Composer", "R", "lyricist", "A", "publisher"])), F.col("l_returnflag")).alias("relation")).alias("a"))
    return li.groupBy("recording_id").agg(F.array_sort(F.collect_list("a")).alias("authors")).withColumn("recording_title", F.concat(F.lit("T"), (F.col("recording_id") % 10).cast("string")))


def writer_edges(spark, d):
    return graph_build.writer_graph(_records(spark, d), ["composer", "lyricist"])


def author_dedupe(spark, d):
    return graph_build.distinct_authors(_records(spark, d))


def author_names(spark, d):
    return graph_build.author_names(_records(spark, d))


def _partition(spark, d):
    return attributes(spark, d).select("node", F.col("c_mktsegment").alias("community"))


def modularity_given_partition(spark, d):
    return rounded(graph_local.modularity(edges(spark, d), _partition(spark, d)), "modularity")


def participation(spark, d):
    return rounded(graph_local.participation(edges(spark, d), _partition(spark, d)), "community_participation")


def louvain(spark, d):
    return graph_community.louvain(edges(spark, d))


def louvain_modularity(spark, d):
    e = edges(spark, d)
    return graph_local.modularity(e, graph_community.louvain(e))


def node2vec_embeddings(spark, d):
    return graph_walks.node2vec(weighted(spark, d))


def endpoint_template_fill(spark, d):
    e = edges(spark, d)
    f = read(spark, d, "customer").select(F.col("c_custkey").alias("artist_mbid"), "c_name", "c_mktsegment")
    have = f.where("artist_mbid % 4 <> 0")
    missing = graph_build.vertices(e).join(have, F.col("node") == F.col("artist_mbid"), "left_anti")
    return relational.template_rows(missing, e, have, "artist_mbid")


def sampled_subgraph(spark, d):
    e = edges(spark, d)
    drawn = graph_build.sample_nodes(attributes(spark, d), "node", 200)
    return rounded(graph_local.density(graph_build.within(e, drawn, "node")), "density", digits=10)


def ergm_density_logit(spark, d):
    return rounded(ergm.density_model(edges(spark, d)), "theta", "deviance")


def ergm_dyad_stats(spark, d):
    """All edges, and for each vertex the pair with every vertex of the 20 drawn ones that it isn't linked to."""
    e = edges(spark, d)
    v = graph_build.vertices(e)
    drawn = F.broadcast(graph_build.sample_nodes(v, "node", 20).select(F.col("node").alias("w")))  # 20 rows
    pairs = v.join(drawn, F.col("node") != F.col("w")).select(F.least("node", "w").alias("u"), F.greatest("node", "w").alias("v")).distinct().join(e, ["u", "v"], "left_anti")
    dy = cut(e.select("u", "v", F.lit(1).alias("edge"), F.lit(1.0).alias("weight")).union(pairs.select("u", "v", F.lit(0), F.lit(1.0))))
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("role"), F.abs("c_acctbal").alias("balance"))
    x = ergm.change_statistics(dy, e)
    out = ergm.covariates(x, nodes, "node", match=["role"], add=["balance"], difference=["balance"])
    return rounded(out.drop("weight"), "gwesp", "gwdegree", "gwdsp", "sum_balance", "absdiff_balance")


def ergm_mple_fit(spark, d):
    e = graph_build.simple_graph(edges(spark, d))
    dy = ergm.sampled_dyads(e, 3.0)
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("role"))
    x = ergm.covariates(ergm.change_statistics(dy, e), nodes, "node", match=["role"])
    x = cut(x)
    return ergm.ladder(x, {"density": [], "structure": ["gwesp", "gwdegree"], "homophily": ["gwesp", "gwdegree", "match_role"]})


def _model_rows(spark, d):
    """A row for each artist, in a table. Releases, those of the early years and each group of features are written once: no task sorts for several joins at once."""
    r = cut(releases(spark, d).select("artist", "id", "date", "label", "price"))
    with dealt(spark, r.count()):
        won = cut(early.in_window(r, early.career_window(r)))
        held = [
            early.cadence(won, AS_OF).select("artist", "releases_total", "gap_std_days", "max_dry_spell_days", "front_loading_index"),
            early.label_profile(won).select("artist", "primary_label", "label_hhi"),
            early.temporal_controls(r, AS_OF).select("artist", "years_active"),
            r.groupBy("artist").agg(F.log1p(F.sum("price") + 1).alias("target")),
        ]
        held = [cut(x) for x in held]
        x = reduce(lambda a, b: a.join(b, "artist"), held)
        rows = cut(x.select("artist", "primary_label", "target", "years_active", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("releases_total", "gap_std_days", "max_dry_spell_days", "label_hhi", "front_loading_index")]))
    forget(r, won, *held)
    return rows


_FEATURES = ["releases_total", "gap_std_days", "max_dry_spell_days", "label_hhi", "front_loading_index", "primary_label"]


def node_features(spark, d):
    """The node table of a whole run, without the columns that follow from an eigenvector's or a partition's last digits."""
    nodes = attributes(spark, d).withColumn("node", F.col("node").cast("string"))
    out = pipeline.node_features(edges(spark, d), nodes, {"c_mktsegment": "role", "c_nationkey": "genre"}, closeness_k=50)
    out = out.drop("eigencent", "dist_to_hub_min", "community_participation")
    out = rounded(out, "clust_local", "gwesp_score", "log_degree", "weak_tie_frac", "same_genre_share", "same_role_share")
    return rounded(out, "betweenness", "closeness", digits=9)


def sketched_path_lengths(spark, d):
    return graph_traverse.sketched_path_lengths(edges(spark, d), 12)


def ordered_target_statistic(spark, d):
    """A customer's segment as the mean balance, in cents, of the customers of the segment before it."""
    c = read(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return rounded(target_statistics.ordered_statistic(c, "c_custkey", "segment", "cents", "statistic"), "statistic")


def shapley_contributions(spark, d):
    """What each numeric feature adds to each artist's prediction by boosted trees."""
    names = _FEATURES[:-1]
    fitted = model.pipeline(names, "target", kind="gbt", maxIter=5, maxDepth=3, seed=1).fit(rows := _model_rows(spark, d))
    return explain.shapley_values(fitted.stages[-1], fitted.stages[0].transform(rows), "__features", names, ["artist"])


def gbt_regression_cv(spark, d):
    p = model.pipeline(_FEATURES, "target", ["primary_label"], "gbt", maxIter=10, maxDepth=3, seed=1)
    return model.cross_validate(_model_rows(spark, d), "artist", p, "target")


def rank_by_prediction(spark, d):
    p = model.pipeline(_FEATURES[:-1], "target", kind="linear")
    return model.rank_segment(_model_rows(spark, d), "years_active", p, 6.0, ["artist"])


NAMES = [
    copurchase_edges, size_adjusted_edges, pair_examples, edge_cleanup, last_edge_weight, edges_within, graph_degree, degree_summary, log_binned_degree,
    shared_partners_gwesp_weak, triangles_clustering_wedges, transitivity_triads, homophily_shares, triangle_mixing, open_dyads, graph_density_summary,
    connected_components, component_sizes, hub_distance, kcore, kcore_profile, eigen_centrality, eigen_steps, pagerank, betweenness, closeness, path_lengths,
    path_length_summary, approximate_diameter, component_diameters, hub_distances_from_sources, sampled_closeness, induced_sample, sample_adjacency, writer_edges,
    author_dedupe, author_names, modularity_given_partition, participation, louvain, louvain_modularity, node2vec_embeddings, endpoint_template_fill,
    node_features, sketched_path_lengths, ordered_target_statistic, shapley_contributions, sampled_subgraph, ergm_density_logit, ergm_dyad_stats, ergm_mple_fit, gbt_regression_cv, rank_by_prediction,
]
QUERIES = {f.__name__: f for f in NAMES}
