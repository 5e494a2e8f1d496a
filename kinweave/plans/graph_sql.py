"""DuckDB SQL of the graph queries."""

M = "m AS (SELECT DISTINCT l_partkey, l_suppkey, o_custkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
E = f"{M}, e AS (SELECT a.n AS u, b.n AS v, count(*) AS weight FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.n < b.n GROUP BY 1, 2), a AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e), deg AS (SELECT src AS node, count(*) AS degree FROM a GROUP BY 1)"
T = f"{E}, t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v)"
SP = f"{T}, pt AS (SELECT a AS u, b AS v FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t), sp AS (SELECT e.u, e.v, coalesce(s.n, 0) AS shared FROM e LEFT JOIN (SELECT u, v, count(*) AS n FROM pt GROUP BY 1, 2) s ON e.u = s.u AND e.v = s.v)"
CL = f"{T}, tn AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1), cl AS (SELECT deg.node, degree, coalesce(n, 0) AS triangles, CASE WHEN degree >= 2 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clust_local, degree * (degree - 1) // 2 AS two_paths FROM deg LEFT JOIN tn ON tn.node = deg.node)"
ATTR = "attr AS (SELECT c_custkey AS node, c_mktsegment AS r, CASE WHEN c_nationkey > 2 THEN c_nationkey END AS k FROM customer)"


EM = E.replace("e AS (", "e AS MATERIALIZED (").replace("a AS (SELECT u AS", "a AS MATERIALIZED (SELECT u AS")
DEPTH = 14


def _levels(seed: str, name: str = "l", near: str = "near") -> str:
    """Breadth first from seed (source, node): level by level, each without the two levels before; depth is bounded."""
    x = [f"{name}0 AS MATERIALIZED (SELECT source, node FROM ({seed}))"]
    for k in range(1, DEPTH + 1):
        old = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {name}{j} o WHERE o.source = p.source AND o.node = a.dst)" for j in (k - 1, k - 2) if j >= 0)
        x.append(f"{name}{k} AS MATERIALIZED (SELECT DISTINCT p.source, a.dst AS node FROM {name}{k - 1} p JOIN a ON a.src = p.node WHERE true {old})")
    return ", ".join(x) + f", {near} AS (" + " UNION ALL ".join(f"SELECT source, node, {k} AS distance FROM {name}{k}" for k in range(DEPTH + 1)) + ")"


def _drawn(k: int, seed: int = 0) -> str:
    return f"SELECT node AS source, node FROM deg ORDER BY md5('{seed}:' || node), node LIMIT {k}"


def _betweenness(k: int) -> str:
    """Brandes by levels: numbers of shortest paths forward, dependencies backward."""
    x = [f"l0 AS MATERIALIZED (SELECT source, node, 1.0::DOUBLE AS s FROM ({_drawn(k)}))"]
    for i in range(1, DEPTH + 1):
        old = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{j} o WHERE o.source = p.source AND o.node = a.dst)" for j in (i - 1, i - 2) if j >= 0)
        x.append(f"l{i} AS MATERIALIZED (SELECT p.source, a.dst AS node, sum(p.s) AS s FROM l{i - 1} p JOIN a ON a.src = p.node WHERE true {old} GROUP BY 1, 2)")
    x.append(f"d{DEPTH} AS MATERIALIZED (SELECT source, node, s, 0.0::DOUBLE AS d FROM l{DEPTH})")
    for i in range(DEPTH - 1, 0, -1):
        x.append(f"d{i} AS MATERIALIZED (SELECT p.source, p.node, p.s, coalesce(sum(p.s / w.s * (1 + w.d)), 0) AS d FROM l{i} p LEFT JOIN (SELECT a.src, n.* FROM a JOIN d{i + 1} n ON n.node = a.dst) w ON w.src = p.node AND w.source = p.source GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT node, d FROM d{i}" for i in range(1, DEPTH + 1))
    return ", ".join(x) + f", b AS (SELECT node, sum(d) AS b FROM ({every}) GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg)"


def _core(rounds: int = 40) -> str:
    """Rounds of the h-index of the neighbours' values, begun at the degrees."""
    x = ["c0 AS MATERIALIZED (SELECT node, degree AS x FROM deg)"]
    for i in range(1, rounds + 1):
        x.append(f"c{i} AS MATERIALIZED (SELECT p.node, least(p.x, h) AS x FROM c{i - 1} p JOIN (SELECT src, max(least(r, x)) AS h FROM (SELECT a.src, q.x, row_number() OVER (PARTITION BY a.src ORDER BY q.x DESC) AS r FROM a JOIN c{i - 1} q ON q.node = a.dst) GROUP BY 1) z ON z.src = p.node)")
    return ", ".join(x) + f", core AS (SELECT node, CAST(x AS BIGINT) AS kcore FROM c{rounds})"


def _eigen(steps: int) -> str:
    x = ["x0 AS (SELECT node, 1.0::DOUBLE AS x FROM deg)"]
    for i in range(1, steps + 1):
        x.append(f"y{i} AS (SELECT p.node, p.x + q.s AS x FROM x{i - 1} p JOIN (SELECT a.src, sum(x) AS s FROM a JOIN x{i - 1} ON node = a.dst GROUP BY 1) q ON q.src = p.node)")
        x.append(f"x{i} AS (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return ", ".join(x)


def _rank(steps: int) -> str:
    x = ["x0 AS (SELECT node, 1.0 / (SELECT count(*) FROM deg) AS x FROM deg)"]
    for i in range(1, steps + 1):
        x.append(f"x{i} AS (SELECT a.dst AS node, 0.15 / (SELECT count(*) FROM deg) + 0.85 * sum(x / degree) AS x FROM a JOIN x{i - 1} p ON p.node = a.src JOIN deg ON deg.node = a.src GROUP BY 1)")
    return ", ".join(x)


COMP = f"{E}, r(node, label) AS (SELECT node, node FROM deg UNION SELECT a.dst, r.label FROM r JOIN a ON a.src = r.node WHERE r.label < a.dst), c AS (SELECT node, min(label) AS component FROM r GROUP BY 1)"
HUBS = "SELECT node AS source, node FROM deg ORDER BY degree DESC, node LIMIT"
QS = "(1 - exp(-0.5))"
SQL = {
    "copurchase_edges": f"WITH {E} SELECT u, v, weight FROM e",
    "size_adjusted_edges": f"WITH {M}, s AS (SELECT l_partkey, l_suppkey, count(*) AS k FROM m GROUP BY 1, 2) SELECT a.n AS u, b.n AS v, round(sum(1.0 / (k - 1)), 6) AS weight FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.n < b.n JOIN s ON s.l_partkey = a.l_partkey AND s.l_suppkey = a.l_suppkey GROUP BY 1, 2",
    "pair_examples": f"WITH {M} SELECT a.n AS u, b.n AS v, count(*) AS weight, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS examples FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.n < b.n JOIN part ON p_partkey = a.l_partkey GROUP BY 1, 2",
    "edge_cleanup": f"WITH {E} SELECT least(CAST(u AS VARCHAR), CAST(v AS VARCHAR)) AS u, greatest(CAST(u AS VARCHAR), CAST(v AS VARCHAR)) AS v FROM e",
    "last_edge_weight": "WITH l AS (SELECT o_custkey AS a, l_suppkey AS b, CASE WHEN l_linenumber > 1 THEN l_extendedprice END AS w, (o_orderkey * 100 + l_linenumber) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey), r AS (SELECT least(a, b) AS u, greatest(a, b) AS v, w, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq DESC) AS i FROM l) SELECT u, v, coalesce(w, 1.0) AS weight FROM r WHERE i = 1",
    "edges_within": f"WITH {E}, k AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) SELECT u, v FROM e WHERE u IN (SELECT * FROM k) AND v IN (SELECT * FROM k)",
    "graph_degree": f"WITH {E} SELECT node, degree, round(ln(1 + degree), 6) AS log_degree FROM deg",
    "degree_summary": f"WITH {E} SELECT round(avg(degree), 6) AS mean_degree, median(degree) AS median_degree, max(degree) AS max_degree, round(var_pop(degree), 6) AS var_degree FROM deg",
    "log_binned_degree": f"WITH {CL}, w AS (SELECT max(degree) AS top, log10(max(degree)) / 10 AS w FROM cl), j AS (SELECT CAST(floor(log10(degree) / w + 1e-9) AS BIGINT) AS bin, w, clust_local FROM cl, w WHERE degree < top) SELECT bin, round(pow(10, (bin + 0.5) * any_value(w)), 6) AS centre, count(*) AS n, round(avg(clust_local), 6) AS mean_clustering FROM j GROUP BY bin",
    "shared_partners_gwesp_weak": f"WITH {SP}, x AS (SELECT u AS node, shared FROM sp UNION ALL SELECT v, shared FROM sp) SELECT node, round(sum(1 - exp(-0.5 * shared)), 6) AS gwesp_score, round(avg(CASE WHEN shared <= 1 THEN 1.0 ELSE 0.0 END), 6) AS weak_tie_frac FROM x GROUP BY node",
    "triangles_clustering_wedges": f"WITH {CL} SELECT node, degree, triangles, round(clust_local, 6) AS clust_local, two_paths - triangles AS open_wedges, two_paths FROM cl",
    "transitivity_triads": f"WITH {CL}, s AS (SELECT count(*) AS n, CAST(sum(degree) AS BIGINT) // 2 AS m, CAST(sum(triangles) AS BIGINT) // 3 AS t, CAST(sum(two_paths) AS BIGINT) AS w, avg(clust_local) AS ac FROM cl) SELECT round(3.0 * t / w, 6) AS transitivity, round(ac, 6) AS average_clustering, t AS triads_3, w - 3 * t AS triads_2, m * (n - 2) - 2 * w + 3 * t AS triads_1, n * (n - 1) * (n - 2) // 6 - (m * (n - 2) - 2 * w + 3 * t) - (w - 3 * t) - t AS triads_0 FROM s",
    "homophily_shares": f"WITH {E}, {ATTR} SELECT src AS node, round(avg(CASE WHEN x.r IS NOT DISTINCT FROM y.r THEN 1.0 ELSE 0.0 END), 6) AS same_role_share, round(avg(CASE WHEN x.k IS NOT DISTINCT FROM y.k THEN 1.0 ELSE 0.0 END), 6) AS same_nation_share FROM a LEFT JOIN attr x ON x.node = src LEFT JOIN attr y ON y.node = dst GROUP BY 1",
    "triangle_mixing": f"""WITH {T}, {ATTR}, f AS (SELECT a, b, c, x.r = y.r AND y.r = z.r AS wr, x.r <> y.r AND y.r <> z.r AND x.r <> z.r AS cr, x.k IS NOT DISTINCT FROM y.k AND y.k IS NOT DISTINCT FROM z.k AS wk, x.k IS DISTINCT FROM y.k AND y.k IS DISTINCT FROM z.k AND x.k IS DISTINCT FROM z.k AS ck FROM t JOIN attr x ON x.node = a JOIN attr y ON y.node = b JOIN attr z ON z.node = c),
g AS (SELECT a AS node, wr, cr, wk, ck FROM f UNION ALL SELECT b, wr, cr, wk, ck FROM f UNION ALL SELECT c, wr, cr, wk, ck FROM f), s AS (SELECT node, count(*) FILTER (WHERE wr) AS wr, count(*) FILTER (WHERE cr) AS cr, count(*) FILTER (WHERE wk) AS wk, count(*) FILTER (WHERE ck) AS ck FROM g GROUP BY 1)
SELECT deg.node, coalesce(wr, 0) AS tri_within_role, coalesce(cr, 0) AS tri_cross_role, coalesce(wk, 0) AS tri_within_nation, coalesce(ck, 0) AS tri_cross_nation FROM deg LEFT JOIN s ON s.node = deg.node""",
    "open_dyads": f"WITH {E}, two AS (SELECT DISTINCT x.src, y.dst FROM a x JOIN a y ON x.dst = y.src WHERE x.src <> y.dst), o AS (SELECT two.src, count(*) AS n FROM two WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = two.src AND a.dst = two.dst) GROUP BY 1) SELECT node, coalesce(n, 0) AS open_dyads FROM deg LEFT JOIN o ON o.src = node",
    "graph_density_summary": f"WITH {E}, n AS (SELECT count(*) AS n FROM deg), mm AS (SELECT count(*) AS m FROM e) SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / (n * (n - 1)), 10) AS density FROM n, mm",
    "connected_components": f"WITH RECURSIVE {COMP}, s AS (SELECT component, count(*) AS k FROM c GROUP BY 1) SELECT node, component, k AS component_size FROM c JOIN s USING (component)",
    "component_sizes": f"WITH RECURSIVE {COMP}, s AS (SELECT component, count(*) AS k FROM c GROUP BY 1) SELECT k AS component_size, count(*) AS n_components, round(k * count(*) / (SELECT count(*) FROM c), 6) AS node_share FROM s GROUP BY k",
    "hub_distance": f"WITH {EM}, {_levels('SELECT 0 AS source, node FROM (' + HUBS + ' 5)')} SELECT deg.node, coalesce(CAST(distance AS DOUBLE), 'inf'::DOUBLE) AS distance FROM deg LEFT JOIN near ON near.node = deg.node",
    "eigen_steps": f"WITH {E}, {_eigen(8)} SELECT node, round(x, 8) AS eigencent FROM x8",
    "pagerank": f"WITH {EM}, {_rank(20)} SELECT node, round(x, 10) AS pagerank FROM x20",
    "path_lengths": f"WITH {EM}, {_levels(_drawn(10000))} SELECT CAST(distance AS BIGINT) AS distance, count(*) AS n FROM near WHERE distance > 0 GROUP BY 1",
    "path_length_summary": f"WITH {EM}, {_levels(_drawn(10000))}, p AS (SELECT distance FROM near WHERE distance > 0) SELECT round(avg(distance), 6) AS mean_distance, CAST(quantile_disc(distance, 0.5) AS BIGINT) AS median_distance, CAST(max(distance) AS BIGINT) AS max_distance FROM p",
    "modularity_given_partition": f"WITH {E}, x AS (SELECT p.c_mktsegment AS cu, q.c_mktsegment AS cv FROM e JOIN customer p ON p.c_custkey = u JOIN customer q ON q.c_custkey = v), mm AS (SELECT count(*) AS m FROM x), l AS (SELECT cu AS c, count(*) AS l FROM x WHERE cu = cv GROUP BY 1), d AS (SELECT c, count(*) AS d FROM (SELECT cu AS c FROM x UNION ALL SELECT cv FROM x) GROUP BY 1) SELECT round(sum(coalesce(l, 0) / m - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity, count(*) AS communities FROM d LEFT JOIN l ON l.c = d.c, mm",
    "participation": f"WITH {E} SELECT src AS node, round(avg(CASE WHEN p.c_mktsegment <> q.c_mktsegment THEN 1.0 ELSE 0.0 END), 6) AS community_participation FROM a JOIN customer p ON p.c_custkey = src JOIN customer q ON q.c_custkey = dst GROUP BY 1",
    "endpoint_template_fill": f"WITH {E}, f AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0), x AS (SELECT src, min(dst) AS b FROM a WHERE src % 4 = 0 AND dst % 4 <> 0 GROUP BY 1) SELECT src AS artist_mbid, c_name, c_mktsegment, b AS template FROM x JOIN f ON f.c_custkey = b",
    "sampled_subgraph": f"WITH {E}, p AS (SELECT c_custkey FROM customer ORDER BY md5('0:' || c_custkey), c_custkey LIMIT 200), k AS (SELECT u, v FROM e WHERE u IN (SELECT * FROM p) AND v IN (SELECT * FROM p)), n AS (SELECT count(*) AS n FROM (SELECT u FROM k UNION SELECT v FROM k)), mm AS (SELECT count(*) AS m FROM k) SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / (n * (n - 1)), 10) AS density FROM n, mm",
    "ergm_density_logit": f"WITH {E}, n AS (SELECT count(*) AS n FROM deg), mm AS (SELECT count(*) AS m FROM e), p AS (SELECT n, m, 2.0 * m / (n * (n - 1)) AS p, n * (n - 1) / 2.0 AS d FROM n, mm) SELECT n AS n_nodes, m AS n_edges, round(ln(p / (1 - p)), 6) AS theta, round(-2 * (m * ln(p) + (d - m) * ln(1 - p)), 6) AS deviance FROM p",
    "ergm_dyad_stats": f"""WITH {SP.replace("e AS (", "e AS MATERIALIZED (")}, drawn AS (SELECT node FROM deg ORDER BY md5('0:' || node), node LIMIT 20), non AS (SELECT DISTINCT least(x.node, y.node) AS u, greatest(x.node, y.node) AS v FROM deg x, drawn y WHERE x.node <> y.node),
dy AS MATERIALIZED (SELECT u, v, 1 AS edge FROM e UNION ALL SELECT u, v, 0 FROM non WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = non.u AND e.v = non.v)),
pp AS MATERIALIZED (SELECT x.src AS w, y.dst AS z, count(*) AS n FROM a x JOIN a y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY 1, 2),
side AS (SELECT dy.u, dy.v, count(*) AS shared, sum(pow({QS}, coalesce(p.n, 0) - edge) + pow({QS}, coalesce(q.n, 0) - edge)) AS s FROM dy JOIN a x ON x.src = dy.u JOIN a y ON y.src = dy.v AND y.dst = x.dst LEFT JOIN pp p ON p.w = dy.u AND p.z = x.dst LEFT JOIN pp q ON q.w = dy.v AND q.z = x.dst GROUP BY 1, 2),
fresh AS (SELECT dy.u, dy.v, edge, x.dst AS w, dy.v AS z FROM dy JOIN a x ON x.src = dy.u WHERE x.dst <> dy.v UNION ALL SELECT dy.u, dy.v, edge, x.dst, dy.u FROM dy JOIN a x ON x.src = dy.v WHERE x.dst <> dy.u),
dyadwise AS (SELECT u, v, sum(pow({QS}, coalesce(n, 0) - edge)) AS g FROM fresh LEFT JOIN pp ON pp.w = fresh.w AND pp.z = fresh.z GROUP BY 1, 2),
k AS (SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS r, abs(c_acctbal) AS b FROM customer)
SELECT dy.u, dy.v, edge, coalesce(side.shared, 0) AS shared, round(exp(0.5) * (1 - pow({QS}, coalesce(side.shared, 0))) + coalesce(s, 0), 6) AS gwesp, round(pow(1 - exp(-0.8), du.degree - edge) + pow(1 - exp(-0.8), dv.degree - edge), 6) AS gwdegree, round(coalesce(g, 0), 6) AS gwdsp,
  CAST(x.r = y.r AS INTEGER) AS match_role, round(x.b + y.b, 6) AS sum_balance, round(abs(x.b - y.b), 6) AS absdiff_balance
FROM dy LEFT JOIN side ON side.u = dy.u AND side.v = dy.v LEFT JOIN dyadwise w ON w.u = dy.u AND w.v = dy.v JOIN deg du ON du.node = dy.u JOIN deg dv ON dv.node = dy.v JOIN k x ON x.c_custkey = dy.u JOIN k y ON y.c_custkey = dy.v""",
    "closeness": f"WITH {EM}, {_levels('SELECT node AS source, node FROM deg')}, s AS (SELECT source, count(*) AS r, sum(distance) AS d FROM near GROUP BY 1) SELECT source AS node, round(CASE WHEN d > 0 THEN (r - 1) / CAST(d AS DOUBLE) * ((r - 1) / CAST((SELECT count(*) FROM deg) - 1 AS DOUBLE)) ELSE 0.0 END, 9) AS closeness FROM s",
    "sampled_closeness": f"WITH {EM}, {_levels(_drawn(50))}, s AS (SELECT node, count(*) AS r, sum(distance) AS d FROM near GROUP BY 1) SELECT deg.node, round(CASE WHEN d > 0 THEN r / CAST(d AS DOUBLE) ELSE 0.0 END, 9) AS closeness FROM deg LEFT JOIN s ON s.node = deg.node",
    "betweenness": f"WITH {EM}, {_betweenness(256)} SELECT deg.node, round(coalesce(b, 0) * (n / least(n, 256)) / ((n - 1) * (n - 2)), 9) AS betweenness FROM deg LEFT JOIN b ON b.node = deg.node, n",
    "kcore": f"WITH {EM}, {_core()} SELECT node, kcore FROM core",
    "kcore_profile": f"WITH {EM}, {_core()} SELECT kcore, count(*) AS n FROM core GROUP BY 1",
    "approximate_diameter": f"WITH {EM}, {_levels(HUBS + ' 1', 'x', 'far')}, {_levels('SELECT node AS source, node FROM (SELECT node FROM far ORDER BY distance DESC, node LIMIT 1)')} SELECT CAST(max(distance) AS BIGINT) AS diameter FROM near",
    "component_diameters": f"WITH {EM}, {_levels('SELECT node AS source, node FROM deg')}, c AS (SELECT source, min(node) AS component, max(distance) AS far FROM near GROUP BY 1) SELECT component, CAST(max(far) AS BIGINT) AS diameter FROM c GROUP BY 1",
    "hub_distances_from_sources": f"WITH {EM}, {_levels(HUBS + ' 5')} SELECT source, node, CAST(distance AS BIGINT) AS distance FROM near",
    "induced_sample": f"WITH {E}, s AS (SELECT i, node, row_number() OVER (PARTITION BY i ORDER BY md5(i || ':' || node), node) AS r FROM deg, range(10) t(i)), k AS (SELECT x.i, u, v FROM e JOIN s x ON x.node = u AND x.r <= 100 JOIN s y ON y.node = v AND y.r <= 100 AND y.i = x.i), g AS (SELECT min(i) AS i FROM (SELECT i FROM k GROUP BY i HAVING count(*) >= 5)), f AS (SELECT u, v FROM e ORDER BY md5('0:' || u || '-' || v), u, v LIMIT 5) SELECT u, v FROM k JOIN g ON g.i = k.i UNION ALL SELECT u, v FROM f WHERE (SELECT i FROM g) IS NULL",
    "sample_adjacency": f"WITH {E}, p AS (SELECT node FROM deg ORDER BY md5('0:' || node), node LIMIT 40) SELECT x.node AS row, y.node AS column, CAST(coalesce(weight, 0) AS DOUBLE) AS value FROM p x, p y LEFT JOIN e ON u = least(x.node, y.node) AND v = greatest(x.node, y.node)",
    "writer_edges": "WITH r AS (SELECT l_orderkey AS recording_id, 'S' || l_suppkey AS name, CASE WHEN l_suppkey % 7 <> 0 THEN 'm' || l_suppkey END AS mbid, CASE l_returnflag WHEN 'N' THEN 'composer' WHEN 'R' THEN 'lyricist' ELSE 'publisher' END AS relation FROM lineitem), k AS (SELECT DISTINCT recording_id, coalesce(mbid, name) AS n FROM r WHERE relation <> 'publisher') SELECT x.n AS u, y.n AS v, count(*) AS weight, string_agg(DISTINCT 'T' || (x.recording_id % 10), '; ' ORDER BY 'T' || (x.recording_id % 10)) AS examples FROM k x JOIN k y ON x.recording_id = y.recording_id AND x.n < y.n GROUP BY 1, 2",
    "author_dedupe": "WITH r AS (SELECT l_orderkey AS recording_id, 'S' || l_suppkey AS name, CASE WHEN l_suppkey % 7 <> 0 THEN 'm' || l_suppkey END AS mbid, CASE l_returnflag WHEN 'N' THEN 'composer' WHEN 'R' THEN 'lyricist' ELSE 'publisher' END AS relation FROM lineitem) SELECT recording_id, min(mbid) AS mbid, relation, min(name) AS name FROM r GROUP BY recording_id, coalesce(mbid, name), relation",
    "author_names": "WITH r AS (SELECT l_orderkey AS recording_id, 'S' || l_suppkey AS name, CASE WHEN l_suppkey % 7 <> 0 THEN 'm' || l_suppkey END AS mbid, CASE l_returnflag WHEN 'N' THEN 'composer' WHEN 'R' THEN 'lyricist' ELSE 'publisher' END AS relation FROM lineitem) SELECT DISTINCT mbid, name FROM r WHERE mbid IS NOT NULL",
}
_BY_NODE = ("triangles_clustering_wedges", "shared_partners_gwesp_weak", "kcore", "betweenness", "sampled_closeness", "homophily_shares", "triangle_mixing", "connected_components", "open_dyads")
#: The node table from the single measures' own SQL.
SQL["node_features"] = f"""SELECT CAST(d.node AS VARCHAR) AS node, clust_local, triangles, open_wedges, gwesp_score, d.degree, log_degree, kcore, betweenness, closeness, same_nation_share AS same_genre_share, same_role_share,
  tri_within_nation AS tri_within_genre, tri_within_role, tri_cross_nation AS tri_cross_genre, tri_cross_role, component_size, open_dyads, weak_tie_frac
FROM ({SQL["graph_degree"]}) d {" ".join(f"LEFT JOIN ({SQL[q]}) t{i} ON t{i}.node = d.node" for i, q in enumerate(_BY_NODE))}"""
SQL["ordered_target_statistic"] = """WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, md5('42:' || c_custkey) AS o FROM customer), m AS (SELECT avg(cents) AS m FROM c)
SELECT c_custkey, segment, cents, round((coalesce(sum(cents) OVER w, 0) + 1.0 * m) / (count(cents) OVER w + 1.0), 6) AS statistic FROM c, m WINDOW w AS (PARTITION BY segment ORDER BY o, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
