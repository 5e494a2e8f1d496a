"""Explicit schemas: nothing is inferred from data."""

ARTIST_DOC = (
    "mbid string, artist_name string, roles string, country string, region_city string, "
    "works array<struct<id: bigint, name: string, first_release_date: string, genres: array<string>, collaborators: array<struct<mbid: string, role: string>>>>, "
    "recordings array<struct<id: bigint, name: string, length_ms: bigint, work_id: bigint, release_id: bigint>>, "
    "releases array<struct<id: bigint, title: string, date: string, release_group_id: bigint, label_ids: array<string>, label_names: array<string>>>"
)
METRICS = "artist_id string, followers bigint, popularity bigint, artist_mbid string"
EDGES = "u string, v string, weight bigint"
# The columns of the early features and of the node features, in order.
EARLY_COLUMNS = (
    "artist_mbid", "artist_name", "window_years", "debut_date", "window_cutoff_date", "releases_total", "releases_per_year",
    "avg_days_between_releases", "release_velocity_releases_per_day", "release_velocity_releases_per_year", "gap_median_days", "gap_std_days",
    "max_dry_spell_days", "front_loading_index", "tracks_total", "collab_track_rate", "unique_collaborator_count", "label_diversity_count",
    "label_churn", "label_hhi", "primary_label", "all_labels_str", "duration_ms_mean", "duration_ms_median", "duration_ms_min", "duration_ms_max",
    "remix_rate", "acoustic_rate", "genre_count", "genre_entropy", "primary_genre", "all_genres_str", "artist_country", "artist_region_city",
    "years_active", "debut_year", "debut_decade", "recency_index", "primary_role", "all_roles_str",
)
NODE_COLUMNS = (
    "node", "clust_local", "triangles", "open_wedges", "gwesp_score", "degree", "log_degree", "eigencent", "kcore", "betweenness", "closeness",
    "dist_to_hub_min", "same_genre_share", "same_label_share", "same_role_share", "tri_within_genre", "tri_within_label", "tri_within_role",
    "tri_cross_genre", "tri_cross_label", "tri_cross_role", "component_size", "open_dyads", "weak_tie_frac", "community_participation",
)
