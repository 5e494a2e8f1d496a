"""Whole runs: catalog -> documents -> features; documents -> graph -> node features; all -> model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import catalog, early, graph_build, graph_community, graph_iterate, graph_local, graph_traverse, graph_walks, matrix
from kinweave.schemas import NODE_COLUMNS
from kinweave.validate import cut


def accepted(docs: DataFrame, excluded: tuple[str, ...] = ("[unknown]",)) -> DataFrame:
    """Documents with a name that isn't excluded, works, sane gaps and an early collaborator."""
    d = docs.where(~F.col("artist_name").isin(*excluded) & (F.size("works") > 0))
    dates = F.transform("works", lambda w: F.try_to_date(w["first_release_date"], "yyyy-MM-dd"))
    works = F.transform("works", lambda w: F.struct(F.try_to_date(w["first_release_date"], "yyyy-MM-dd").alias("date"), F.transform(w["collaborators"], lambda c: c["mbid"]).alias("collaborators")))
    d = d.withColumn("__start", F.array_min(F.array_compact(dates)))
    return d.where(F.col("__start").isNotNull() & early.gap_sane(dates) & early.early_collaborator(works, F.col("__start"), F.col("mbid"))).drop("__start")


def prepare(tables: dict[str, DataFrame], ids: DataFrame, as_of: str, years: int = 5) -> dict[str, DataFrame]:
    """docs, and the early features of those accepted."""
    docs = catalog.written_documents(tables, ids).drop("pos")
    return {"docs": docs, "features": matrix.clean_features(early.features(accepted(docs), as_of, years))}


def node_features(edges: DataFrame, nodes: DataFrame, attributes: dict[str, str], hubs: int = 5, betweenness_k: int | None = 256, closeness_k: int | None = 256) -> DataFrame:
    """All node measures, one row for each vertex of the edges. nodes: node and the attribute columns; attributes: column -> genre, label or role."""
    e = cut(graph_build.simple_graph(edges))
    tri = cut(graph_local.triangles(e))
    eig = cut(graph_iterate.eigenvector(e))
    parts = [
        graph_local.clustering(e, tri).drop("two_paths").withColumn("log_degree", F.log1p("degree")),
        graph_local.edge_scores(e, tri=tri),
        eig,
        graph_iterate.core_number(e),
        graph_traverse.betweenness(e, betweenness_k),
        graph_traverse.closeness(e, closeness_k),
        graph_iterate.distance_to(e, graph_iterate.top_hubs(eig, "eigencent", hubs)).withColumnRenamed("distance", "dist_to_hub_min"),
        graph_local.same_share(e, nodes, {c: f"same_{n}_share" for c, n in attributes.items()}),
        graph_local.triangle_mixing(e, nodes, attributes, tri=tri),
        graph_iterate.connected_components(e).select("node", "component_size"),
        graph_local.open_dyads(e),
    ]
    parts.append(graph_local.participation(e, graph_community.louvain(e)))
    out = graph_build.vertices(e)
    for p in parts:
        out = out.join(p, "node", "left")
    return out.select(*[c for c in NODE_COLUMNS if c in out.columns])


def catalog_edges(tables: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """The edges of the documents of features' artists, found in the catalog: no document is built or read."""
    owned = catalog.owned(tables, features.select(F.col("artist_mbid").alias("mbid")).distinct())
    return graph_build.owned_work_edges(owned.select("id16", F.col("work_id").alias("work")), catalog.dated_works(tables), catalog.unpacked("id16"))


def network(docs: DataFrame | None, features: DataFrame, dimensions: int = 32, tables: dict[str, DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """edges, node features and embeddings of the co-work graph of documents; with the catalog's tables docs are not needed."""
    if tables is None:
        semi = docs.join(features.select(F.col("artist_mbid").alias("mbid")).distinct(), "mbid", "left_semi")
        edges = cut(graph_build.cowork_edges(semi))
    else:
        edges = cut(catalog_edges(tables, features))
    nodes = features.select(F.col("artist_mbid").alias("node"), "primary_genre", "primary_label", "primary_role")
    return {"edges": edges, "nodes": node_features(edges, nodes, {"primary_genre": "genre", "primary_label": "label", "primary_role": "role"}, **options), "embeddings": graph_walks.node2vec(edges, dimensions).withColumnRenamed("node", "artist_mbid")}


def final(features: DataFrame, net: dict[str, DataFrame], metrics: DataFrame) -> DataFrame:
    return matrix.build_final(features, net["nodes"], net["embeddings"], metrics)


def metrics_by_id(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """links: mbid, url; fetched: artist_id, followers, popularity. Joined by the platform's id, never by position."""
    ids = links.select(F.col("mbid").alias("artist_mbid"), S.base62_id("url").alias("artist_id")).where("artist_id is not null")
    return fetched.where("artist_id is not null").withColumn("followers", F.coalesce("followers", F.lit(0))).join(ids, "artist_id").select("artist_id", "followers", "popularity", "artist_mbid")
