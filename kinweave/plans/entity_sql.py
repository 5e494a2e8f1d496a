"""DuckDB SQL of the entity queries, written apart from them."""

REL = "rel AS (SELECT o_custkey AS artist, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS label, o_totalprice AS price, o_orderstatus AS kind FROM orders)"
REC = "rec AS (SELECT l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, CAST(l.l_shipdate AS DATE) AS shipped, o.o_custkey AS artist, o.o_orderkey AS release_id, CAST(o.o_orderdate AS DATE) AS date FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"
WIN = "win AS (SELECT artist, min(date) AS debut_date, CAST(min(date) + INTERVAL 5 YEAR AS DATE) AS window_cutoff_date FROM rel GROUP BY artist), won AS (SELECT rel.*, debut_date, window_cutoff_date FROM rel JOIN win USING (artist) WHERE date < window_cutoff_date)"
CADENCE = f"""WITH {REL}, {WIN},
g AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS gap, row_number() OVER w AS n, date_diff('day', debut_date, date) AS days,
  CASE WHEN date < debut_date + CAST(floor(date_diff('day', debut_date, window_cutoff_date) / 2) AS INTEGER) THEN 1.0 ELSE 0.0 END AS early
  FROM won WINDOW w AS (PARTITION BY artist ORDER BY date, id)),
s AS (SELECT artist, count(*) AS n, avg(CAST(days AS DOUBLE)) AS mx, avg(CAST(n AS DOUBLE)) AS my FROM g GROUP BY artist),
k AS (SELECT g.artist, sum((g.days - mx) * (g.n - my)) AS sxy, sum((g.days - mx) * (g.days - mx)) AS sxx FROM g JOIN s USING (artist) GROUP BY g.artist)
SELECT g.artist, any_value(debut_date) AS debut_date, any_value(window_cutoff_date) AS window_cutoff_date, count(*) AS releases_total,
  round(count(*) / nullif(greatest(0, date_diff('day', any_value(debut_date), least(any_value(window_cutoff_date), DATE '2002-01-01'))) / 365.25, 0), 6) AS releases_per_year,
  round(avg(gap), 6) AS avg_days_between_releases,
  round(any_value(sxy) / nullif(any_value(sxx), 0), 6) AS release_velocity_releases_per_day,
  round(any_value(sxy) / nullif(any_value(sxx), 0) * 365.25, 6) AS release_velocity_releases_per_year,
  round(median(gap), 6) AS gap_median_days, round(stddev_pop(gap), 6) AS gap_std_days, round(CAST(max(gap) AS DOUBLE), 6) AS max_dry_spell_days, round(avg(early), 6) AS front_loading_index
FROM g JOIN k ON g.artist = k.artist GROUP BY g.artist"""

SQL = {
    "early_window_cadence": CADENCE,
    "debut_fallback": f"""WITH {REL}, {REC}, r AS (SELECT artist, min(CASE WHEN label = '1-URGENT' THEN date END) AS d FROM rel GROUP BY artist), w AS (SELECT artist, min(shipped) AS d FROM rec GROUP BY artist)
SELECT artist, coalesce(r.d, w.d) AS debut_date, CAST(coalesce(r.d, w.d) + INTERVAL 5 YEAR AS DATE) AS window_cutoff_date FROM r FULL JOIN w USING (artist)""",
    "derived_work_dates": f"""WITH {REL}, {REC}, {WIN}, d AS (SELECT artist, l_partkey, min(date) AS derived FROM rec WHERE release_id IN (SELECT id FROM won) GROUP BY 1, 2), o AS (SELECT artist, l_partkey, min(shipped) AS own FROM rec GROUP BY 1, 2)
SELECT artist, l_partkey, own, derived, least(own, derived) AS first_date FROM o LEFT JOIN d USING (artist, l_partkey)""",
    "collab_rate": f"""WITH {REL}, {REC}, {WIN}, team AS (SELECT l_partkey, l_suppkey, count(DISTINCT artist) AS n FROM rec GROUP BY 1, 2),
t AS (SELECT r.artist, r.l_partkey, r.l_suppkey, n > 1 AS collab FROM rec r JOIN team USING (l_partkey, l_suppkey) WHERE r.release_id IN (SELECT id FROM won)),
u AS (SELECT t.artist, count(DISTINCT r.artist) AS c FROM t JOIN rec r USING (l_partkey, l_suppkey) WHERE collab GROUP BY 1)
SELECT t.artist, count(*) AS tracks_total, count(*) FILTER (WHERE collab) AS collab_tracks, round((count(*) FILTER (WHERE collab)) / CAST(count(*) AS DOUBLE), 6) AS collab_track_rate, coalesce(any_value(u.c), 0) AS unique_collaborator_count
FROM t LEFT JOIN u ON t.artist = u.artist GROUP BY t.artist""",
    "label_profile": f"""WITH {REL}, {WIN}, c AS (SELECT *, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS changed FROM won WINDOW w AS (PARTITION BY artist ORDER BY date, id)),
churn AS (SELECT artist, CAST(sum(changed) AS BIGINT) AS label_churn FROM c GROUP BY artist),
f AS (SELECT artist, label, min(row(date, id)) AS first_seen, count(*) AS n FROM won GROUP BY 1, 2),
t AS (SELECT artist, sum(n) AS total FROM f GROUP BY 1)
SELECT f.artist, count(*) AS label_diversity_count, round(sum((n / total) * (n / total)), 6) AS label_hhi, arg_min(label, row(-n, label)) AS primary_label, any_value(label_churn) AS label_churn, string_agg(lower(label), ', ' ORDER BY first_seen) AS all_labels_str
FROM f JOIN t USING (artist) JOIN churn ON churn.artist = f.artist GROUP BY f.artist""",
    "genre_entropy": f"""WITH {REC}, w AS (SELECT DISTINCT artist, l_partkey, p_type AS genre FROM rec JOIN part ON l_partkey = p_partkey), n AS (SELECT artist, genre, count(*) AS n FROM w GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY artist) AS p FROM n)
SELECT artist, count(*) AS genre_count, round(-sum(p * ln(p)), 6) AS genre_entropy, arg_min(genre, row(-n, genre)) AS primary_genre, string_agg(lower(genre), ', ' ORDER BY lower(genre)) AS all_genres_str FROM p GROUP BY artist""",
    "duration_title_profile": f"""WITH {REC} SELECT artist, (2 * CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) * 10000 + count(*)) // (2 * count(*)) / 1000000.0 AS duration_ms_mean, round(median(l_extendedprice), 6) AS duration_ms_median, min(l_extendedprice) AS duration_ms_min, max(l_extendedprice) AS duration_ms_max,
  round(avg(CASE WHEN contains(lower(p_name), 'ring') THEN 1.0 ELSE 0.0 END), 6) AS remix_rate, round(avg(CASE WHEN contains(lower(p_name), 'an') THEN 1.0 ELSE 0.0 END), 6) AS acoustic_rate FROM rec JOIN part ON l_partkey = p_partkey GROUP BY artist""",
    "temporal_controls": f"""WITH {REL} SELECT artist, round(date_diff('day', min(date), DATE '2002-01-01') / 365.25, 6) AS years_active, CAST(year(min(date)) AS INTEGER) AS debut_year, CAST(year(min(date)) - year(min(date)) % 10 AS INTEGER) AS debut_decade,
  round(exp(-0.1 * greatest(0, date_diff('day', max(date), DATE '2002-01-01')) / 30.44), 6) AS recency_index FROM rel GROUP BY artist""",
    "role_profile": """SELECT c_custkey AS artist, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) || ', writer' ELSE '' END AS all_roles_str, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) ELSE 'unknown' END AS primary_role FROM customer""",
    "market_kinds": f"""WITH {REL}, {REC}, m AS (SELECT artist, count(DISTINCT s_nationkey) AS markets FROM rec JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), k AS (SELECT artist, kind || ':' || count(*) AS t FROM rel GROUP BY artist, kind)
SELECT k.artist, string_agg(t, ',' ORDER BY t) AS kinds, any_value(markets) AS markets FROM k LEFT JOIN m ON m.artist = k.artist GROUP BY k.artist""",
    "popularity_thresholds": f"""WITH {REL} SELECT artist, (2 * CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) * 10000 + count(*)) // (2 * count(*)) / 1000000.0 AS mean_price, round(median(price), 6) AS median_price, min(price) AS min_price, max(price) AS max_price, round(avg(CASE WHEN price >= 100000 THEN 1.0 ELSE 0.0 END), 6) AS share_100k, round(avg(CASE WHEN price >= 200000 THEN 1.0 ELSE 0.0 END), 6) AS share_200k FROM rel GROUP BY artist""",
    "yearly_nearest_rank": f"""WITH {REC}, f AS (SELECT l_partkey, CAST(min(year(date)) AS INTEGER) AS year, max(l_extendedprice) AS price FROM rec GROUP BY 1), a AS (SELECT year, count(*) AS n, (2 * CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) * 10000 + count(*)) // (2 * count(*)) / 1000000.0 AS mean_price, median(price) AS median_price, min(price) AS min_price, max(price) AS max_price, list_sort(list(price)) AS s FROM f GROUP BY year)
SELECT year, n, mean_price, round(median_price, 6) AS median_price, min_price, max_price, s[CAST(least(n, greatest(1, round_even(0.25 * (n + 1), 0))) AS BIGINT)] AS p25, s[CAST(least(n, greatest(1, round_even(0.75 * (n + 1), 0))) AS BIGINT)] AS p75 FROM a""",
    "clean_fill_flags": f"""WITH {REL}, {WIN}, g AS (SELECT artist, date_diff('day', lag(date) OVER (PARTITION BY artist ORDER BY date, id), date) AS gap FROM won WHERE label IN ('1-URGENT', '2-HIGH')), a AS (SELECT artist, count(*) AS n, stddev_pop(gap) AS sd FROM g GROUP BY 1)
SELECT c_custkey AS artist_mbid, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS primary_role, coalesce(n, 0) AS releases_total, round(coalesce(sd, 0), 6) AS gap_std_days, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE 'unknown' END AS artist_country,
  CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS recency_index, n IS NULL OR n = 0 AS missing_releases, c_custkey % 3 <> 0 AS recency_index_missing, n_nationkey % 5 <> 0 AS location_country_known
FROM customer LEFT JOIN a ON a.artist = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "gap_sanity_filter": f"""WITH {REL}, o AS (SELECT artist, date, row_number() OVER w AS i, date_diff('day', lag(date) OVER w, date) AS gap FROM rel WINDOW w AS (PARTITION BY artist ORDER BY date))
SELECT artist, count(*) AS n_dates FROM o GROUP BY artist HAVING count(*) < 3 OR max(CASE WHEN i IN (2, 3) THEN gap END) <= 200""",
    "early_collab_exists": f"""WITH {REC}, w AS (SELECT artist, l_partkey, l_suppkey, min(shipped) AS date FROM rec GROUP BY 1, 2, 3), s AS (SELECT artist, min(date) AS start FROM w GROUP BY 1)
SELECT DISTINCT w.artist FROM w JOIN s USING (artist) JOIN w o ON o.l_partkey = w.l_partkey AND o.l_suppkey = w.l_suppkey AND o.artist <> w.artist WHERE w.date <= s.start + 365""",
    "workset_union": f"""WITH {REC} SELECT artist, l_partkey, min(n) AS work_name FROM (SELECT artist, l_partkey, CASE WHEN l_linenumber = 1 THEN p_name ELSE upper(p_name) END AS n FROM rec JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
    "earliest_event_top1": """WITH e AS (SELECT l_orderkey AS release, CASE WHEN l_linenumber % 4 <> 1 THEN year(l_shipdate) END AS y, CASE WHEN l_linenumber % 3 <> 2 THEN month(l_shipdate) END AS m, CASE WHEN l_linenumber % 2 = 0 THEN day(l_shipdate) END AS d FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY release ORDER BY y NULLS LAST, m NULLS LAST, d NULLS LAST) AS i FROM e) SELECT release, CASE WHEN y IS NOT NULL THEN make_date(y, coalesce(m, 1), coalesce(d, 1)) END AS date FROM r WHERE i = 1""",
    "release_flatten_labels": f"""WITH {REC} SELECT artist AS artist_id, release_id, max(p_name) AS title, min(shipped) AS date, max(l_partkey) AS release_group_id, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS label_ids, coalesce(string_agg(DISTINCT CASE WHEN p_brand <> 'Brand#11' THEN p_type END, '|' ORDER BY CASE WHEN p_brand <> 'Brand#11' THEN p_type END), '') AS label_names
FROM rec JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "cohort_placeholder_join": f"""WITH {REL}, r AS (SELECT artist, count(*) AS n FROM rel GROUP BY 1) SELECT CAST(c_custkey * 3 AS VARCHAR) AS mbid, c_custkey AS pos, coalesce(n, 0) AS n_releases FROM customer LEFT JOIN r ON r.artist = c_custkey * 3""",
    "source_url_map": """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS mbid, page_id, url FROM pages WHERE contains(lower(url), '1')), u AS (SELECT mbid, arg_max(url, page_id) AS url FROM p GROUP BY 1)
SELECT mbid, url, split_part(url, '/', -1) AS segment, CASE WHEN regexp_full_match(split_part(split_part(url, '/', -1), '?', 1), '[0-9A-Za-z]{22}') THEN split_part(split_part(url, '/', -1), '?', 1) END AS id22 FROM u""",
    "resource_groups": """SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, min(page_id) AS first_page, arg_max(page_id, row(length(html), page_id)) AS largest_page FROM pages GROUP BY 1""",
    "dedupe_keep_last": """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY user_id""",
    "dedupe_keep_first": """SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, event_id), 4) AS value FROM events GROUP BY 1, 2""",
    "json_props_extract": """SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1""",
    "resume_antijoin": """WITH done AS (SELECT user_id, CASE WHEN user_id % 50 = 0 THEN 'machinery' END AS name FROM events WHERE value > 20 AND user_id % 3 = 0)
SELECT c_custkey AS user_id, c_mktsegment AS name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM done WHERE user_id IS NOT NULL) AND lower(trim(c_mktsegment)) NOT IN (SELECT name FROM done WHERE name IS NOT NULL)""",
    "yearly_top_labels": f"""WITH {REL}, n AS (SELECT CAST(year(date) AS INTEGER) AS year, label, count(*) AS n FROM rel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, label) AS rank FROM n) SELECT * FROM r WHERE rank <= 3""",
    "top10_other": """WITH n AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS i FROM n) SELECT CASE WHEN i <= 10 THEN v ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""",
    "outlier_quantile_filter": f"""WITH {REL}, c AS (SELECT artist, round(sum(price), 2) AS followers FROM rel GROUP BY 1) SELECT artist, followers, round(ln(followers + 2), 6) AS target FROM c WHERE followers <= (SELECT quantile_cont(followers, 0.9) FROM c)""",
    "zscores": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS b FROM customer), s AS (SELECT avg(b) AS m, stddev_pop(b) AS d, avg(ln(1 + abs(b))) AS lm, stddev_samp(ln(1 + abs(b))) AS ld FROM c)
SELECT c_custkey, round(coalesce((b - m) / d, 0), 6) AS balance_z, 0.0::DOUBLE AS same_z, round(coalesce((ln(1 + abs(b)) - lm) / ld, 0), 6) AS size_z FROM c, s""",
    "minmax": """WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part) SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS p_retailprice_scaled, round((p_size - c) / CAST(d - c AS DOUBLE), 6) AS p_size_scaled FROM part, s""",
    "decile_bins": f"""WITH {REL}, c AS (SELECT artist, count(*) AS n_releases FROM rel GROUP BY 1), q AS (SELECT unnest(quantile_cont(n_releases, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM c), u AS (SELECT DISTINCT e FROM q), i AS (SELECT e FROM u WHERE e > (SELECT min(e) FROM u) AND e < (SELECT max(e) FROM u))
SELECT artist, n_releases, (SELECT count(*) FROM i WHERE e < n_releases) AS bin FROM c""",
    "stratified_split": f"""WITH {REL}, c AS (SELECT artist, sum(price) AS f FROM rel GROUP BY 1), q AS (SELECT unnest(quantile_cont(f, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM c), b AS (SELECT artist, (SELECT count(*) FROM q WHERE e < f) AS bin FROM c)
SELECT bin, count(*) AS n, CAST(floor(0.2 * count(*)) AS BIGINT) AS n_test FROM b GROUP BY bin""",
    "missing_rates": """SELECT 'c_name' AS column_name, round(avg(CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS missing_rate FROM customer UNION ALL SELECT 'c_acctbal', round(avg(CASE WHEN c_acctbal > 0 THEN 0.0 ELSE 1.0 END), 6) FROM customer UNION ALL SELECT 'c_nationkey', 0.0 FROM customer LIMIT 3""",
    "price_histogram": """WITH x AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT CAST(least(floor((x - lo) / (hi - lo) * 12) + 1, 12) AS BIGINT) AS bin, count(*) AS n FROM x, s GROUP BY 1""",
    "describe_balances": """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance, round(stddev_samp(c_acctbal), 6) AS std_balance, round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.75), 6) AS p75, round(quantile_cont(c_acctbal, 0.995), 6) AS p995 FROM customer GROUP BY 1""",
    "ranking_summary": """SELECT count(*) AS pool, round(avg(c_acctbal), 6) AS mean_score, round(median(c_acctbal), 6) AS median_score, (SELECT round(avg(s), 6) FROM (SELECT c_acctbal AS s FROM customer ORDER BY s DESC LIMIT 10)) AS top_mean FROM customer""",
    "regression_metrics": f"""WITH {REL}, r AS (SELECT ln(max(price)) AS a, ln(avg(price)) AS p FROM rel GROUP BY artist) SELECT round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(avg(abs(a - p)), 6) AS mae, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2 FROM r""",
    "role_classifier": """SELECT c_custkey, (['writer', 'performer', 'production', 'other', '', 'writer', 'production'])[c_custkey % 7 + 1] AS role_major, c_mktsegment AS genre_first FROM customer""",
    "date_parsers": """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT k, day, CASE k % 7 WHEN 0 THEN day WHEN 1 THEN date_trunc('month', day) WHEN 2 THEN date_trunc('year', day) WHEN 6 THEN day END::DATE AS loose FROM o)
SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN day END AS strict, loose, CAST(CASE k % 3 WHEN 0 THEN day WHEN 1 THEN date_trunc('month', day) ELSE date_trunc('year', day) END AS DATE) AS by_precision,
  CAST(CASE WHEN k % 7 IN (0, 1, 2) THEN year(day) WHEN k % 7 = 3 THEN 2001 END AS INTEGER) AS year, date_diff('day', DATE '0001-01-01', loose) + 1 AS day_number FROM p""",
    "uuid_normalise": """WITH h AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 5 <> 4 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS mbid, false AS was_normal FROM h""",
    "final_assembly": f"""WITH {REL}, m AS (SELECT artist, 's' || artist AS artist_id, round(arg_max(price, id), 2) AS followers FROM rel GROUP BY artist), n AS (SELECT c_custkey + 2 AS id, round(c_acctbal / 100, 4) AS eigencent FROM customer)
SELECT c.c_custkey AS artist_mbid, c_name AS artist_name, CASE WHEN n.id IS NOT NULL THEN artist_id END AS artist_id, c_mktsegment AS primary_role, eigencent, CASE WHEN n.id IS NOT NULL AND c.c_custkey % 2 = 0 THEN round(c_acctbal * 0.5, 4) END AS n2v_0, CASE WHEN n.id IS NOT NULL THEN followers END AS followers
FROM customer c LEFT JOIN n ON n.id = c.c_custkey LEFT JOIN m ON m.artist = c.c_custkey WHERE c.c_custkey % 10 <> 9""",
    "top_customers": """SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer ORDER BY balance DESC, c_custkey LIMIT 25""",
    "shared_and_missing_ids": """SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) AS known, (SELECT count(*) FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)) AS either""",
}
