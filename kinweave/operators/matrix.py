"""The final model table: joins, key clean-up, column policy, fills and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators.relational import keep_first, keep_last
from kinweave.validate import require_columns

# Columns not for models, and column names of other versions.
DROPPED = (
    "window_years", "debut_date", "window_cutoff_date", "release_velocity_releases_per_day", "unique_collaborator_count", "all_labels_str",
    "all_genres_str", "all_roles_str", "debut_decade", "recency_index", "popularity", "debut_year",
)
RENAMED = {"eigen_centrality": "eigencent", "participation_coef": "community_participation"}
ZERO_COUNTS = (
    "releases_total", "tracks_total", "unique_collaborator_count", "label_diversity_count", "label_churn", "genre_count",
)
ZERO_MEASURES = (
    "releases_per_year", "avg_days_between_releases", "release_velocity_releases_per_day", "release_velocity_releases_per_year", "gap_median_days",
    "gap_std_days", "max_dry_spell_days", "front_loading_index", "collab_track_rate", "label_hhi", "duration_ms_mean", "duration_ms_median",
    "duration_ms_min", "duration_ms_max", "remix_rate", "acoustic_rate", "genre_entropy", "years_active", "recency_index",
)
UNKNOWN_TEXT = (
    "primary_label", "primary_genre", "primary_role", "artist_country", "artist_region_city",
)


def build_final(base: DataFrame, nodes: DataFrame, embeddings: DataFrame, metrics: DataFrame, order: str | None = None) -> DataFrame:
    """base with the network's columns: nodes left-join embeddings and metrics, restricted to base's ids, duplicates resolved, columns in order.

    Doubles: nodes and embeddings keep the first by `order` (an explicit column,
    if they have one), metrics the last.
    """
    require_columns(base, ["artist_mbid"], "base features")
    require_columns(embeddings, ["artist_mbid"], "embeddings")
    require_columns(metrics, ["artist_mbid", "artist_id"], "metrics")
    if "artist_mbid" not in nodes.columns:
        nodes = require_columns(nodes, ["node"], "node features").withColumnRenamed("node", "artist_mbid")
    nodes = nodes.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in nodes.columns and v not in nodes.columns})

    def one(df: DataFrame, keep) -> DataFrame:
        out = keep(df, ["artist_mbid"], [order]) if order in df.columns else df.dropDuplicates(["artist_mbid"])
        return out.drop(order) if order else out

    network = one(nodes, keep_first).join(one(embeddings, keep_first), "artist_mbid", "left").join(one(metrics, keep_last), "artist_mbid", "left")
    network = network.join(base.select("artist_mbid").distinct(), "artist_mbid", "left_semi")
    fresh = [c for c in network.columns if c not in base.columns]
    out = base.join(network.select("artist_mbid", *fresh), "artist_mbid", "left").drop(*DROPPED)
    first = [c for c in ("artist_mbid", "artist_name", "artist_id") if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def clean_features(df: DataFrame) -> DataFrame:
    """Completeness flags first, then zero and 'unknown' fills, for the columns that are there."""
    have = set(df.columns)
    absent = lambda c: F.col(c).isNull() | (F.col(c) == 0)
    flags = {f"missing_{n}": absent(c) for n, c in (("recordings", "tracks_total"), ("genres", "genre_count"), ("labels", "label_diversity_count"), ("releases", "releases_total")) if c in have}
    if "recency_index" in have:
        flags["recency_index_missing"] = F.col("recency_index").isNull()
    for c, name in (("artist_country", "location_country_known"), ("artist_region_city", "location_region_city_known")):
        if c in have:
            flags[name] = S.known(c) != "unknown"
    df = df.withColumns(flags) if flags else df
    fills = {c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in [*ZERO_COUNTS, *ZERO_MEASURES] if c in have} | {c: S.known(c) for c in UNKNOWN_TEXT if c in have}
    return df.withColumns(fills) if fills else df


def log_target(df: DataFrame, column: str = "followers", quantile: float = 0.995) -> DataFrame:
    """Rows up to the quantile; target = log1p(column + 1)."""
    from kinweave.operators.relational import below_quantile

    return below_quantile(df.where(F.col(column).isNotNull()), column, quantile).withColumn("target", F.log1p(F.col(column) + 1))


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """The seven unions of base, graph and embedding columns among those given."""
    from itertools import combinations

    from kinweave.schemas import EARLY_COLUMNS, NODE_COLUMNS

    groups = {"base": [c for c in EARLY_COLUMNS[2:] if c in columns and c not in DROPPED], "graph": [c for c in NODE_COLUMNS[1:] if c in columns], "n2v": [c for c in columns if c.startswith("n2v_")]}
    return {"+".join(k): [c for g in k for c in groups[g]] for n in (3, 2, 1) for k in combinations(groups, n)}
