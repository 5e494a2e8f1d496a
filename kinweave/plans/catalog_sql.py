"""DuckDB SQL of the catalog, reader and sink queries, written apart from them."""


def _gid(k: str) -> str:
    h = f"md5(CAST({k} AS VARCHAR))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


#: The names of the link types 1 to 6 of the test catalog.
TYPES = "(VALUES (1, 'writer'), (2, 'composer'), (3, 'producer'), (4, 'vocal'), (5, 'instrument'), (6, 'mix')) ty(id, name)"
LI = "li AS MATERIALIZED (SELECT l.*, o_custkey AS artist, l_orderkey * 10 + l_linenumber AS rec FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate) AS nth FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey WHERE nth = 1)"
COHORT = f"""every_id AS (SELECT c_custkey AS k, c_custkey AS pos FROM customer UNION ALL SELECT c_custkey, c_custkey + 10000000 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 50000000, c_custkey + 50000000 FROM customer WHERE c_custkey % 20 = 1),
cohort AS (SELECT k, {_gid("k")} AS mbid, min(pos) AS pos FROM every_id GROUP BY k)"""
WORKS = f"{LI}, ws AS MATERIALIZED (SELECT artist, l_partkey AS work_id FROM li WHERE l_linenumber <= 4 UNION SELECT artist, l_partkey FROM li WHERE l_linenumber <> 3)"
EVENT = "ev AS (SELECT o_orderkey AS release, CASE WHEN o_orderkey % 13 <> 0 THEN make_date(year(o_orderdate), CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate) ELSE 1 END, CASE WHEN o_orderkey % 3 <> 0 THEN day(o_orderdate) ELSE 1 END) END AS date FROM orders WHERE o_orderkey % 11 <> 0)"
RECS = f"{WORKS}, rr AS MATERIALIZED (SELECT DISTINCT ws.artist, li.rec, li.l_quantity, ws.work_id, li.l_orderkey AS release_id FROM ws JOIN li ON li.l_partkey = ws.work_id WHERE li.l_linenumber <> 3)"
RELS = f"{RECS}, {EVENT}, rel AS MATERIALIZED (SELECT DISTINCT artist, release_id FROM rr)"
ROLES = f"roles AS (SELECT artist, string_agg(DISTINCT name, ', ' ORDER BY name) AS roles FROM (SELECT artist, ty.name FROM li JOIN {TYPES} ON ty.id = l_linenumber WHERE l_linenumber <= 4 UNION ALL SELECT artist, coalesce(ty.name, 'performer') FROM li LEFT JOIN {TYPES} ON ty.id = l_linenumber WHERE l_linenumber >= 4) GROUP BY 1)"
TRACKS = "tr AS (SELECT 'a' || o_custkey AS owner, lower(trim(p_name)) AS title, CAST(o_orderdate AS DATE) AS day, 's' || (l_suppkey % 3) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
GOOD = "event_id % 100 <> 0"
#: The catalog's works, releases and recordings in each artist's first five years, and what is counted of them.
FEATURES = f"""WITH {RELS}, {COHORT}, {ROLES}, own AS (SELECT l_partkey AS work_id, min(CAST(l_shipdate AS DATE)) AS own FROM li WHERE l_partkey % 8 <> 0 GROUP BY 1),
wk AS (SELECT ws.artist, ws.work_id, p_size, own FROM ws JOIN part ON p_partkey = ws.work_id LEFT JOIN own ON own.work_id = ws.work_id),
rl AS (SELECT artist, release_id AS id, date, CASE WHEN release_id % 4 = 0 OR release_id % 30 >= 25 THEN '' WHEN release_id % 30 % 4 <> 0 THEN lower(n_name) ELSE 'L' || (release_id % 30) END AS label FROM rel LEFT JOIN ev ON ev.release = release_id LEFT JOIN nation ON n_nationkey = release_id % 30),
al AS (SELECT artist, date, 0 AS kind FROM rl UNION ALL SELECT artist, own, 1 FROM wk),
win AS (SELECT artist, d AS debut_date, CAST(d + INTERVAL 5 YEAR AS DATE) AS cutoff FROM (SELECT artist, coalesce(min(date) FILTER (kind = 0), min(date) FILTER (kind = 1)) AS d FROM al GROUP BY artist)),
won AS MATERIALIZED (SELECT rl.*, debut_date, cutoff FROM rl JOIN win USING (artist) WHERE date < cutoff),
g AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS gap, row_number() OVER w AS n, date_diff('day', debut_date, date) AS days, CASE WHEN date < debut_date + CAST(floor(date_diff('day', debut_date, cutoff) / 2) AS INTEGER) THEN 1.0 ELSE 0.0 END AS early FROM won WINDOW w AS (PARTITION BY artist ORDER BY date, id)),
m AS (SELECT artist, avg(CAST(days AS DOUBLE)) AS mx, avg(CAST(n AS DOUBLE)) AS my FROM g GROUP BY artist),
k AS (SELECT g.artist, sum((days - mx) * (n - my)) / nullif(sum((days - mx) * (days - mx)), 0) AS slope FROM g JOIN m USING (artist) GROUP BY g.artist),
cad AS (SELECT g.artist, count(*) AS releases_total, count(*) / nullif(greatest(0, date_diff('day', any_value(debut_date), least(any_value(cutoff), DATE '2002-01-01'))) / 365.25, 0) AS per_year, avg(gap) AS gap_mean, any_value(slope) AS slope, median(gap) AS gap_median, stddev_pop(gap) AS gap_sd, CAST(max(gap) AS DOUBLE) AS gap_max, avg(early) AS front FROM g JOIN k ON k.artist = g.artist GROUP BY g.artist),
vis AS (SELECT DISTINCT artist, id, date FROM won),
hd AS MATERIALIZED (SELECT rr.artist, rr.work_id, CAST(l_quantity * 1000 AS BIGINT) AS len FROM rr JOIN vis ON vis.artist = rr.artist AND vis.id = rr.release_id),
dv AS (SELECT rr.artist, rr.work_id, min(vis.date) AS derived FROM rr JOIN vis ON vis.artist = rr.artist AND vis.id = rr.release_id GROUP BY 1, 2),
wi AS (SELECT wk.artist, wk.work_id, p_size FROM wk LEFT JOIN dv ON dv.artist = wk.artist AND dv.work_id = wk.work_id JOIN win ON win.artist = wk.artist WHERE least(own, derived) < cutoff),
tm AS (SELECT hd.artist, hd.work_id, len, coalesce(wi.work_id % 2 = 0, false) AS collab FROM hd LEFT JOIN wi ON wi.artist = hd.artist AND wi.work_id = hd.work_id),
co AS (SELECT artist, count(*) AS tracks_total, (count(*) FILTER (collab)) / CAST(count(*) AS DOUBLE) AS collab_rate, avg(len) AS len_mean, median(len) AS len_median, min(len) AS len_min, max(len) AS len_max FROM tm GROUP BY artist),
un AS (SELECT artist, count(DISTINCT c) AS n FROM (SELECT DISTINCT artist, unnest(['m' || (work_id % 50) || ' composer', 'm' || (work_id % 7) || ' lyricist']) AS c FROM tm WHERE collab) GROUP BY artist),
lc AS (SELECT artist, date, id, label, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS changed FROM won WHERE label <> '' WINDOW w AS (PARTITION BY artist ORDER BY date, id)),
lf AS (SELECT artist, label, min(row(date, id)) AS first_seen, count(*) AS n, sum(changed) AS changed FROM lc GROUP BY 1, 2),
lb AS (SELECT artist, count(*) AS diversity, sum(changed) AS churn, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS hhi, arg_min(label, row(-n, label)) AS top, string_agg(lower(label), ', ' ORDER BY first_seen) AS labels FROM lf GROUP BY artist),
gn AS (SELECT artist, 'g' || (p_size % 10) AS genre, count(*) AS n FROM wi WHERE work_id % 6 <> 0 GROUP BY 1, 2),
gp AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY artist) AS DOUBLE) AS p FROM gn),
ge AS (SELECT artist, count(*) AS n, -sum(p * ln(p)) AS entropy, arg_min(genre, row(-n, genre)) AS top, string_agg(genre, ', ' ORDER BY genre) AS genres FROM gp GROUP BY artist),
tc AS (SELECT artist, min(date) AS a, max(date) AS b FROM al WHERE date IS NOT NULL GROUP BY artist)
SELECT mbid AS artist_mbid, c_name AS artist_name, 5 AS window_years, debut_date, cutoff AS window_cutoff_date, coalesce(releases_total, 0) AS releases_total, round(per_year, 6) AS releases_per_year, round(gap_mean, 6) AS avg_days_between_releases, round(slope, 6) AS release_velocity_releases_per_day,
  round(slope * 365.25, 6) AS release_velocity_releases_per_year, round(gap_median, 6) AS gap_median_days, round(gap_sd, 6) AS gap_std_days, gap_max AS max_dry_spell_days, round(front, 6) AS front_loading_index, coalesce(tracks_total, 0) AS tracks_total, round(collab_rate, 6) AS collab_track_rate,
  coalesce(un.n, 0) AS unique_collaborator_count, coalesce(diversity, 0) AS label_diversity_count, CAST(coalesce(churn, 0) AS BIGINT) AS label_churn, round(hhi, 6) AS label_hhi, lb.top AS primary_label, labels AS all_labels_str, round(len_mean, 6) AS duration_ms_mean, round(len_median, 6) AS duration_ms_median,
  len_min AS duration_ms_min, len_max AS duration_ms_max, CASE WHEN tracks_total > 0 THEN 0.0 END AS remix_rate, CASE WHEN tracks_total > 0 THEN 0.0 END AS acoustic_rate, coalesce(ge.n, 0) AS genre_count, round(entropy, 6) AS genre_entropy, ge.top AS primary_genre, genres AS all_genres_str,
  x.n_name AS artist_country, y.n_name AS artist_region_city, round(date_diff('day', a, DATE '2002-01-01') / 365.25, 6) AS years_active, CAST(year(a) AS INTEGER) AS debut_year, CAST(year(a) - year(a) % 10 AS INTEGER) AS debut_decade, CASE WHEN b IS NOT NULL THEN round(exp(-0.1 * greatest(0, date_diff('day', b, DATE '2002-01-01')) / 30.44), 6) END AS recency_index,
  coalesce(split_part(roles, ', ', 1), 'unknown') AS primary_role, coalesce(roles, '') AS all_roles_str
FROM cohort LEFT JOIN customer ON c_custkey = k LEFT JOIN nation x ON x.n_nationkey = c_nationkey LEFT JOIN nation y ON y.n_nationkey = (c_nationkey + 5) % 25 AND c_custkey % 3 <> 0 LEFT JOIN roles ON roles.artist = k LEFT JOIN win ON win.artist = k LEFT JOIN cad ON cad.artist = k
  LEFT JOIN co ON co.artist = k LEFT JOIN un ON un.artist = k LEFT JOIN lb ON lb.artist = k LEFT JOIN ge ON ge.artist = k LEFT JOIN tc ON tc.artist = k"""

SQL = {
    "nested_features": FEATURES,
    "catalog_entities": f"""WITH {RELS}, {COHORT}, {ROLES}, w AS (SELECT artist, count(*) AS n FROM ws GROUP BY 1), r AS (SELECT artist, count(*) AS n, sum(CAST(l_quantity * 1000 AS BIGINT)) AS len FROM rr GROUP BY 1), l AS (SELECT artist, count(*) AS n FROM rel GROUP BY 1)
SELECT mbid, c_name AS artist_name, x.n_name AS country, y.n_name AS region_city, roles, pos, coalesce(w.n, 0) AS n_works, coalesce(r.n, 0) AS n_recordings, coalesce(l.n, 0) AS n_releases, CAST(coalesce(len, 0) AS DOUBLE) AS total_length
FROM cohort LEFT JOIN customer ON c_custkey = k LEFT JOIN nation x ON x.n_nationkey = c_nationkey LEFT JOIN nation y ON y.n_nationkey = (c_nationkey + 5) % 25 AND c_custkey % 3 <> 0 LEFT JOIN roles ON roles.artist = k LEFT JOIN w ON w.artist = k LEFT JOIN r ON r.artist = k LEFT JOIN l ON l.artist = k""",
    "catalog_works": f"""WITH {WORKS}, f AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS d FROM li WHERE l_partkey % 8 <> 0 GROUP BY 1)
SELECT {_gid("artist")} AS mbid, work_id, p_name AS name, strftime(d, '%Y-%m-%d') AS first_release_date, CASE WHEN work_id % 6 <> 0 THEN 'g' || (p_size % 10) ELSE '' END AS genres,
  CASE WHEN work_id % 2 = 0 THEN 'm' || (work_id % 50) || ':composer|m' || (work_id % 7) || ':lyricist' ELSE '' END AS collaborators FROM ws JOIN part ON p_partkey = work_id LEFT JOIN f ON f.l_partkey = work_id""",
    "catalog_works_by_tags": f"""WITH {WORKS} SELECT {_gid("artist")} AS mbid, work_id, p_name AS name, CAST(NULL AS VARCHAR) AS first_release_date, 't' || (p_size % 10) AS genres, '' AS collaborators FROM ws JOIN part ON p_partkey = work_id""",
    "catalog_recordings": f"""WITH {RECS} SELECT {_gid("artist")} AS mbid, rec AS rec_id, 'R' || rec AS name, CAST(l_quantity * 1000 AS BIGINT) AS length_ms, work_id, release_id FROM rr""",
    "catalog_releases": f"""WITH {RELS} SELECT {_gid("artist")} AS mbid, release_id, 'T' || (release_id % 100) AS title, strftime(date, '%Y-%m-%d') AS date, release_id % 1000 AS release_group_id,
  CASE WHEN release_id % 4 <> 0 AND release_id % 30 < 25 THEN 'L' || (release_id % 30) ELSE '' END AS label_ids, CASE WHEN release_id % 4 <> 0 AND release_id % 30 < 25 AND release_id % 30 % 4 <> 0 THEN lower(n_name) ELSE '' END AS label_names
FROM rel LEFT JOIN ev ON ev.release = release_id LEFT JOIN nation ON n_nationkey = release_id % 30""",
    "nested_documents": f"""WITH {RELS}, {COHORT}, f AS (SELECT l_partkey, strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS d FROM li WHERE l_partkey % 8 <> 0 GROUP BY 1),
w AS (SELECT artist, count(*) AS n, md5(string_agg(work_id || ':' || p_name || ':' || coalesce(d, '-'), '|' ORDER BY work_id, p_name)) AS x FROM ws JOIN part ON p_partkey = work_id LEFT JOIN f ON f.l_partkey = work_id GROUP BY 1),
r AS (SELECT artist, count(*) AS n, md5(string_agg(rec || ':R' || rec || ':' || CAST(l_quantity * 1000 AS BIGINT) || ':' || work_id || ':' || release_id, '|' ORDER BY rec, CAST(l_quantity * 1000 AS BIGINT), work_id, release_id)) AS x FROM rr GROUP BY 1),
l AS (SELECT artist, count(*) AS n, md5(string_agg(release_id || ':T' || (release_id % 100) || ':' || coalesce(strftime(date, '%Y-%m-%d'), '-') || ':' || (release_id % 1000) || ':' || CASE WHEN release_id % 4 <> 0 AND release_id % 30 < 25 THEN 'L' || (release_id % 30) ELSE '' END || ':' ||
  CASE WHEN release_id % 4 <> 0 AND release_id % 30 < 25 AND release_id % 30 % 4 <> 0 THEN lower(n_name) ELSE '' END, '|' ORDER BY release_id)) AS x FROM rel LEFT JOIN ev ON ev.release = release_id LEFT JOIN nation ON n_nationkey = release_id % 30 GROUP BY 1)
SELECT mbid, c_name AS artist_name, pos, coalesce(w.n, 0) AS n_works, coalesce(r.n, 0) AS n_recordings, coalesce(l.n, 0) AS n_releases, coalesce(w.x, md5('')) AS works, coalesce(r.x, md5('')) AS recordings, coalesce(l.x, md5('')) AS releases
FROM cohort LEFT JOIN customer ON c_custkey = k LEFT JOIN w ON w.artist = k LEFT JOIN r ON r.artist = k LEFT JOIN l ON l.artist = k""",
    "catalog_resources": f"""SELECT {_gid("c_custkey")} AS mbid, ty.name AS type, 'http://x/' || c_custkey AS url, CAST(c_custkey % 7 + 1991 AS INTEGER) AS begin_year, CASE WHEN (c_custkey % 7 + 1) % 2 = 0 THEN 2005 END AS end_year FROM customer LEFT JOIN {TYPES} ON ty.id = c_custkey % 7 + 1 WHERE c_custkey % 5 <> 0""",
    "catalog_resources_with_empty": f"""SELECT {_gid("c_custkey")} AS mbid, CAST(c_custkey % 5 <> 0 AS BIGINT) AS n FROM customer""",
    "catalog_one_resource": f"""SELECT {_gid("c_custkey")} AS mbid, CAST(NULL AS VARCHAR) AS type, 'http://x/7' AS url, 1991 AS begin_year, CAST(NULL AS INTEGER) AS end_year FROM customer WHERE c_custkey = 7""".replace("CAST(NULL AS VARCHAR)", "'writer'"),
    "early_song_features": f"""WITH {WORKS}, n AS (SELECT artist, work_id, row_number() OVER (PARTITION BY artist ORDER BY work_id) AS i FROM ws), f AS (SELECT * FROM n WHERE i <= 10), p AS (SELECT artist, 'm' || (work_id % 50) AS m FROM f WHERE work_id % 2 = 0 UNION ALL SELECT artist, 'm' || (work_id % 7) FROM f WHERE work_id % 2 = 0), u AS (SELECT artist, count(DISTINCT m) AS n FROM p GROUP BY 1)
SELECT {_gid("f.artist")} AS mbid, count(*) AS n_songs, round(avg(CASE WHEN work_id % 2 = 0 THEN 2 ELSE 0 END), 6) AS avg_collaborators, count(DISTINCT work_id) AS unique_works, coalesce(any_value(u.n), 0) AS unique_collaborators FROM f LEFT JOIN u ON u.artist = f.artist GROUP BY f.artist""",
    "platform_works": f"""WITH {TRACKS}, g AS (SELECT owner, title, CASE WHEN s = 's0' THEN 's0' ELSE 's0,' || s END AS people, any_value(s) AS s, min(day) AS day FROM tr GROUP BY 1, 2, 3)
SELECT owner AS mbid, row_number() OVER (PARTITION BY owner ORDER BY title, people) AS work_id, title AS name, CAST(day AS VARCHAR) AS first_release_date, c_mktsegment || '|pop' AS genres, 's0:performer' || CASE WHEN s <> 's0' THEN '|' || s || ':performer' ELSE '' END AS collaborators
FROM g JOIN customer ON owner = 'a' || c_custkey""",
    "relatives_of_item": f"""WITH near AS (SELECT 2 AS k, 'child' AS r, 2 AS p WHERE false UNION ALL SELECT unnest([2, 3, 5, 8]), 'father', 5 UNION ALL SELECT s_suppkey, 'spouse', 3 FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'sibling', 4 FROM supplier WHERE s_suppkey % 3 = 0),
one AS (SELECT k, arg_max(r, row(p, r)) AS relation FROM near GROUP BY k)
SELECT 'Q' || k AS qid, CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN s_name ELSE 'Q' || k END AS name, 'J' || (k % 12) AS occupations, relation, k % 5 = 0 AS has_mbid, CASE WHEN k % 5 = 0 THEN {_gid("k")} END AS mbid FROM one JOIN supplier ON s_suppkey = k WHERE k % 12 BETWEEN 3 AND 10""",
    "subclass_closure": """WITH RECURSIVE pr AS (SELECT 'n' || p_partkey AS child, 'n' || (p_partkey // 3) AS parent FROM part), t(node) AS (SELECT unnest(['n2', 'n7']) UNION SELECT child FROM pr JOIN t ON parent = node) SELECT node FROM t""",
    "item_by_id": """SELECT 'Q10' AS item FROM supplier WHERE s_suppkey = 10""",
    "rich_lookup_fallback": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS name, c_mktsegment AS genre, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS place FROM customer""",
    "claim_values": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Q' || o_orderkey WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 't' || o_orderkey WHEN 4 THEN '1.5,' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS text FROM orders""",
    "name_search": """SELECT p_partkey, 'contains' AS how FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT p_partkey, 'prefix' FROM part WHERE starts_with(lower(p_name), 'blue') UNION ALL SELECT p_partkey, 'equals' FROM part WHERE p_brand = 'Brand#13'""",
    "alias_and_finite": """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'Rock' ELSE 'Hip Hop' END AS genre, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size AS DOUBLE) END AS x FROM part""",
    "json_lines_tolerant": f"""SELECT NOT ({GOOD}) AS corrupt, CASE WHEN {GOOD} THEN event_type END AS event_type, count(*) AS n, CAST(sum(CASE WHEN {GOOD} THEN event_id END) AS BIGINT) AS ids FROM events GROUP BY 1, 2""",
    "json_lines_skipped": f"""SELECT event_id, user_id, event_type FROM events WHERE {GOOD}""",
    "json_lines_strict": """SELECT event_id, user_id, event_type FROM events""",
    "raw_lines_kept": f"""SELECT event_id, user_id, event_type FROM events WHERE {GOOD}""",
    "json_map_written": """SELECT r_name AS key, n_name AS name, CAST(n_nationkey AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "json_array_read": """SELECT c_custkey AS id, c_name AS name FROM customer""",
    "json_array_or_object": """SELECT p_partkey * 10 + 1 AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey * 10 + 2 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey * 10 + 3 FROM part WHERE p_partkey % 2 = 1""",
    "csv_round_trip": """SELECT c_custkey, c_name || ', "q"' AS c_name, c_nationkey FROM customer""",
    "csv_as_text": """WITH c AS (SELECT CAST(c_custkey % 100 AS VARCHAR) AS id, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS num, c_mktsegment AS seg FROM customer WHERE c_custkey % 9 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY num NULLS FIRST, seg) AS i FROM c) SELECT id, num, seg FROM r WHERE i = 1""",
    "csv_to_map": """SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment FROM customer""",
    "id_list_round_trip": """SELECT CAST(c_custkey AS VARCHAR) AS mbid FROM customer WHERE c_custkey % 6 <> 0""",
    "dumped_ids": f"""SELECT upper({_gid("c_custkey")}) AS mbid, (SELECT count(*) FROM customer) AS n FROM customer""",
    "json_shards_round_trip": """SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""",
    "append_twice": """SELECT c_custkey, c_name FROM customer""",
    "streamed_once": """SELECT event_id, user_id, event_type FROM events""",
    "saved_table": f"""SELECT upper({_gid("c_custkey")}) AS gid, CAST(1 AS BIGINT) AS tables FROM customer""",
    "platform_metrics": """SELECT 'a' || c_custkey AS artist_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 ELSE 0 END AS followers, c_custkey % 100 AS popularity FROM customer WHERE c_custkey % 8 <> 0""",
    "platform_albums_tracks": """WITH a AS (SELECT 'al' || (o_orderkey % 700) AS album_id, CAST(o_custkey AS VARCHAR) AS request, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS release_date, lower(o_orderstatus) AS kind, row_number() OVER (PARTITION BY o_orderkey % 700 ORDER BY CAST(o_custkey AS VARCHAR), o_orderkey) AS i FROM orders),
t AS (SELECT 'al' || l_orderkey AS album_id, count(*) AS n_tracks, CAST(max(l_linenumber) AS BIGINT) AS last, CAST(sum(l_suppkey) AS BIGINT) AS length_ms FROM lineitem GROUP BY 1) SELECT a.album_id, request, release_date, kind, n_tracks, last, length_ms FROM a LEFT JOIN t ON t.album_id = a.album_id WHERE i = 1""",
    "platform_popularity": """SELECT DISTINCT 't' || (p_partkey % 500) AS id, p_partkey % 500 % 100 AS popularity FROM part WHERE p_partkey % 6 <> 0""",
    "platform_searches": """SELECT CAST(o_custkey AS VARCHAR) AS request, 'o' || arg_min(o_orderkey, row((o_orderkey * 7919) % 100003, length(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR))) AS first, 'o' || arg_min(o_orderkey, row(-(o_orderkey % 101), (o_orderkey * 7919) % 100003, length(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR))) FILTER (WHERE o_orderkey % 101 >= 20) AS best FROM orders GROUP BY o_custkey""",
    "platform_listeners": """SELECT CAST(c_custkey AS VARCHAR) AS request, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 3 END AS listeners, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 THEN c_custkey * 5 END AS playcount FROM customer""",
    "platform_chart": """SELECT c_custkey AS rank, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'm' || c_custkey END AS mbid, c_custkey * 2 AS listeners FROM customer WHERE c_custkey <= 100""",
    "platform_top_tracks": """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS request, 'o' || o_orderkey AS name, o_orderkey % 50 AS playcount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50 DESC, 'o' || o_orderkey) AS rank FROM orders) SELECT * FROM r WHERE rank <= 3""",
    "platform_tracklists": """SELECT CAST(l_orderkey AS VARCHAR) AS release_id, CAST(l_linenumber % 2 AS INTEGER) AS medium, CAST(l_linenumber AS INTEGER) AS position, 'r' || l_partkey AS recording_id, CASE WHEN l_suppkey % 2 = 0 THEN 'own' ELSE 'rec' END AS title, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity * 10 AS BIGINT) ELSE 77 END AS length_ms FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)""",
    "platform_relations": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 5 <> 0), a AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) SELECT CAST(l_orderkey AS VARCHAR) AS recording_id, count(DISTINCT l.l_partkey) AS works, count(DISTINCT l_suppkey) AS authors, count(DISTINCT row(l_suppkey, l_returnflag)) AS credits FROM l JOIN a ON a.l_partkey = l.l_partkey GROUP BY l_orderkey""",
    "accepted_documents": f"""WITH {WORKS}, f AS (SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS d FROM li WHERE l_partkey % 8 <> 0 GROUP BY 1), w AS (SELECT ws.artist, work_id, d FROM ws LEFT JOIN f ON f.l_partkey = work_id),
s AS (SELECT artist, min(d) AS start, count(*) AS n FROM w GROUP BY 1), g AS (SELECT artist, d, row_number() OVER v AS i, date_diff('day', lag(d) OVER v, d) AS gap FROM w WHERE d IS NOT NULL WINDOW v AS (PARTITION BY artist ORDER BY d)),
sane AS (SELECT artist FROM g GROUP BY artist HAVING count(*) < 3 OR max(CASE WHEN i IN (2, 3) THEN gap END) <= 7300)
SELECT {_gid("s.artist")} AS mbid, n AS n_works FROM s WHERE start IS NOT NULL AND artist IN (SELECT artist FROM sane) AND EXISTS (SELECT 1 FROM w WHERE w.artist = s.artist AND work_id % 2 = 0 AND d <= start + 1825)""",
    "cowork_edges": f"""WITH {RELS}, dated AS (SELECT artist, work_id FROM ws WHERE work_id % 8 <> 0 AND work_id IN (SELECT l_partkey FROM li) UNION SELECT rr.artist, work_id FROM rr JOIN ev ON ev.release = release_id WHERE date IS NOT NULL),
p AS (SELECT artist, work_id, {_gid("artist")} AS n FROM dated UNION SELECT artist, work_id, 'm' || (work_id % 50) FROM dated WHERE work_id % 2 = 0 UNION SELECT artist, work_id, 'm' || (work_id % 7) FROM dated WHERE work_id % 2 = 0)
SELECT x.n AS u, y.n AS v, count(*) AS weight FROM p x JOIN p y ON x.artist = y.artist AND x.work_id = y.work_id AND x.n < y.n GROUP BY 1, 2""",
    "metrics_by_platform_id": f"""SELECT lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS artist_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 2 ELSE 0 END AS followers, c_custkey % 100 AS popularity, {_gid("c_custkey")} AS artist_mbid FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""",
    "prepared_covariates": """WITH s AS (SELECT avg(ln(1 + abs(c_acctbal))) AS m, stddev_samp(ln(1 + abs(c_acctbal))) AS d FROM customer WHERE c_custkey % 9 <> 0) SELECT c_custkey AS node, c_custkey % 9 = 0 AS placeholder, CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE round((ln(1 + abs(c_acctbal)) - m) / d, 6) END AS size_z FROM customer, s""",
    "category_codes": """WITH v AS (SELECT c_mktsegment AS s, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS i FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 6 <> 0 AND c_mktsegment <> 'MACHINERY')) SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN i END AS segment_code FROM customer LEFT JOIN v ON s = c_mktsegment""",
    "sparse_columns_dropped": """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS common FROM customer""",
    "feature_sets": """WITH g(name, i, c, n) AS (VALUES ('base', 1, 'releases_total,label_hhi', 2), ('graph', 2, 'clust_local,degree,kcore', 3), ('n2v', 3, 'n2v_0', 1))
SELECT x.name AS name, CAST(x.n AS BIGINT) AS n, x.c AS columns FROM g x UNION ALL SELECT x.name || '+' || y.name, x.n + y.n, x.c || ',' || y.c FROM g x JOIN g y ON x.i < y.i UNION ALL SELECT 'base+graph+n2v', 6, 'releases_total,label_hhi,clust_local,degree,kcore,n2v_0'""",
    "parsed_params": """SELECT * FROM (VALUES ('max_depth', '8'), ('rate', '0.5'), ('name', 'cat'), ('flag', 'True')) t(name, value)""",
    "canonical_labels": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS label FROM part""",
    "chart_data_written": """WITH x AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT 'prices' AS chart, CAST(CAST(least(floor((x - lo) / (hi - lo) * 12) + 1, 12) AS BIGINT) AS VARCHAR) AS x, count(*) AS n FROM x, s GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2""",
    "example_written": """SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20""",
}
