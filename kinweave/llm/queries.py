"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import common as C
from kinweave.llm import conversation_repair, entropy, filter_audit, host_reputation, langid, line_rules, minhash, mixing, packing, suffixes, toxicity, warc, winnowing


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(C.documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(C.documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(C.documents(spark, sf_dir), with_text=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.documents(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.documents(spark, sf_dir))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(C.documents(spark, sf_dir))


def op8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.cross_entropy_difference(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(warc.load(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_POWERS = " + ".join(f"coalesce(lead(c, {j}) OVER w, 0) * {pow(winnowing.BASE, 15 - j, winnowing.PRIME)}" for j in range(16))
_LOW = (1 << winnowing.POSITION) - 1
#: Every run of 16 characters by the definition of its polynomial, and every window of 32 of them.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER v, first_value(t) OVER v) AS nt, coalesce(lead(doc_id) OVER v, first_value(doc_id) OVER v) AS next_id FROM d WINDOW v AS (ORDER BY doc_id DESC)),
e AS MATERIALIZED (SELECT doc_id, next_id, t, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS x FROM o),
x AS (SELECT doc_id, 0 AS kind, t AS s FROM e UNION ALL SELECT doc_id, 1, x FROM e),
c AS (SELECT doc_id, kind, length(s) AS n, unnest(range(length(s))) AS i, CAST(unicode(unnest(string_split(s, ''))) AS BIGINT) AS c FROM x WHERE s <> ''),
h AS (SELECT doc_id, kind, n, i, ({_POWERS}) % {winnowing.PRIME} AS h FROM c WHERE n >= 16 WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
g AS (SELECT doc_id, kind, n, i, min(h * {_LOW + 1} + ({_LOW} - i)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS z FROM h WHERE i <= n - 16),
f AS MATERIALIZED (SELECT DISTINCT doc_id, kind, z // {_LOW + 1} AS h, {_LOW} - z % {_LOW + 1} AS p FROM g WHERE i <= greatest(n - 47, 0)
  UNION ALL SELECT doc_id, kind, list_reduce(list_prepend(0::BIGINT, list(c ORDER BY i)), lambda s, y: (s * {winnowing.BASE} + y + 1) % {winnowing.PRIME}), 0 FROM c WHERE n < 16 GROUP BY doc_id, kind),
p AS (SELECT doc_id, kind, string_agg(printf('%X', h) || ':' || printf('%X', p), ' ' ORDER BY p) AS s FROM f GROUP BY 1, 2),
u AS MATERIALIZED (SELECT DISTINCT doc_id, kind, h FROM f), k AS (SELECT doc_id, kind, count(*) AS n FROM u GROUP BY 1, 2),
se AS (SELECT a.doc_id, count(*) AS n FROM u a JOIN u b ON b.doc_id = a.doc_id AND b.kind = 1 AND b.h = a.h WHERE a.kind = 0 GROUP BY 1),
sn AS (SELECT e.doc_id, count(*) AS n FROM e JOIN u a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN u b ON b.doc_id = e.next_id AND b.kind = 0 AND b.h = a.h GROUP BY 1),
z AS (SELECT e.doc_id, length(t) AS n_chars, sha256(x) AS edited_sha256, coalesce(p.s, '') AS fingerprint, coalesce(q.s, '') AS edited_fingerprint, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(c.n, 0) AS c, coalesce(se.n, 0) AS ab, coalesce(sn.n, 0) AS ac
  FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.kind = 0 LEFT JOIN p q ON q.doc_id = e.doc_id AND q.kind = 1 LEFT JOIN k a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN k b ON b.doc_id = e.doc_id AND b.kind = 1
  LEFT JOIN k c ON c.doc_id = e.next_id AND c.kind = 0 LEFT JOIN se ON se.doc_id = e.doc_id LEFT JOIN sn ON sn.doc_id = e.doc_id)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CASE WHEN a + b - ab = 0 THEN 1.0 ELSE ab / CAST(a + b - ab AS DOUBLE) END AS near_edited, CASE WHEN a + c - ac = 0 THEN 1.0 ELSE ac / CAST(a + c - ac AS DOUBLE) END AS near_next FROM z
"""

#: All pairs of texts that share a run of five words, and reachability over those similar enough.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rep AS (SELECT text, min(doc_id) AS r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d GROUP BY text),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), chr(1)) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM rep WHERE len(w) > 0)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN c cx ON cx.r = x JOIN c cy ON cy.r = y WHERE k >= 0.8 * (cx.n + cy.n - k) - 1e-9
  UNION ALL SELECT (SELECT min(r) FROM rep WHERE len(w) = 0), r FROM rep WHERE len(w) = 0),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
t(node, label) AS (SELECT r, r FROM rep UNION SELECT b.y, t.label FROM t JOIN b ON b.x = t.node WHERE t.label < b.y),
m AS (SELECT node, min(label) AS label FROM t GROUP BY node)
SELECT d.doc_id, m.label AS class_id FROM d JOIN rep ON rep.text = d.text JOIN m ON m.node = rep.r
"""

_PHRASES = "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in line_rules.BOILERPLATE)
#: Lines and windows of words one by one, under the rules' production parameters.
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
k AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS nth FROM l),
f AS (SELECT doc_id, len(w) AS n, len(w) > 0 AND nth > 1 AS dup, len(w) > 0 AND (nth > 1 OR NOT regexp_matches(w[-1], '[.!?:;")''…”»。]$')
  OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.05 * octet_length(encode(x)) OR length(regexp_replace(x, '[^|]', '', 'g')) > 0.2 * len(w)
  OR length(regexp_replace(x, '[^!]', '', 'g')) > greatest(1, 0.3 * len(w)) OR regexp_matches(lower(x), '{_PHRASES}')) AS bad FROM k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_lines_removed, CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS n_words_removed FROM f GROUP BY doc_id),
v AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), chr(1)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM v)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h WHERE c > 1) GROUP BY doc_id),
z AS (SELECT v.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, coalesce(r.c, 0) AS n_repeat_words, n_lines, n_lines_removed, n_words_removed
  FROM v JOIN a ON a.doc_id = v.doc_id LEFT JOIN r ON r.doc_id = v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_words_removed >= 0.5 * n_words AS kept, n_lines, n_lines_removed, n_words_removed FROM z
"""

#: Every window of 50 bytes in hexadecimal with its first document; marked windows joined to runs.
OP7_SQL = """
WITH n AS (SELECT doc_id, h, length(h) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM n)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT w.doc_id, p FROM w JOIN f ON f.s = w.s WHERE first_id < w.doc_id),
i AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS gap FROM g),
j AS (SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM j GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (SELECT q.doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last FROM q JOIN n ON n.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN t ON t.doc_id = n.doc_id
"""

#: Base32 of a SHA-1: five hexadecimal digits are twenty bits, four characters.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) >> CAST(15 - 5 * k AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

_RULES = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in host_reputation.RULES)
_HOW = host_reputation.Reputation()


def _digamma(x: str) -> str:
    return f"(ln({x} + 8.0) - 0.5 / ({x} + 8.0) - 1.0 / 12 / pow({x} + 8.0, 2) + 1.0 / 120 / pow({x} + 8.0, 4) - {' - '.join(f'1.0 / ({x} + {i})' for i in range(8))})"


def _trigamma(x: str) -> str:
    return f"(1.0 / ({x} + 8.0) + 0.5 / pow({x} + 8.0, 2) + 1.0 / 6 / pow({x} + 8.0, 3) - 1.0 / 30 / pow({x} + 8.0, 5) + {' + '.join(f'1.0 / pow({x} + {i}, 2)' for i in range(8))})"


def _weight(table: str, parent: str) -> str:
    """(1 - rho) / rho of a level by the definition: squared distances of children's rates from their parent's."""
    return f"""(SELECT (1 - r) / r FROM (SELECT least(greatest(CASE WHEN most > 1e-12 THEN excess / most ELSE {_HOW.rho_unknown} END, {_HOW.rho_least}), {_HOW.rho_most}) AS r FROM (
  SELECT sum(d - v * (c - 1)) AS excess, sum(v * (n - nn / n - (c - 1))) AS most FROM (
    SELECT sum(x.n * pow(x.k / x.n - y.m, 2)) AS d, any_value(y.m * (1 - y.m)) AS v, count(*) AS c, sum(x.n) AS n, sum(CAST(x.n AS DOUBLE) * x.n) AS nn
    FROM {table} x JOIN (SELECT {parent} AS g, sum(k) / sum(n) AS m FROM {table} WHERE n > 0 GROUP BY 1) y ON y.g = x.{parent} WHERE x.n > 0 GROUP BY y.g))))"""


#: Rules by their text, counts by host, domain and suffix, shrunk from the top.
OP11_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS ({_RULES}),
m AS (SELECT page_id, host, path, max(struct_pack(n := length(f.h || f.p), h := f.h, p := f.p, v := f.v)) AS x FROM p LEFT JOIN f ON (p.host = f.h OR ends_with(p.host, '.' || f.h)) AND starts_with(p.path, f.p) GROUP BY page_id, host, path),
o AS (SELECT doc_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
a AS (SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, bad FROM p LEFT JOIN o ON o.doc_id = p.page_id),
h0 AS (SELECT name, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(name, '.') AS l FROM a GROUP BY name),
h1 AS (SELECT *, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') OR len(l) < 2 AS own, array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in _HOW.suffixes)}) AS two FROM h0),
h AS MATERIALIZED (SELECT name, n, k, CASE WHEN own THEN name WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain, CASE WHEN own THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h1),
d AS MATERIALIZED (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS MATERIALIZED (SELECT suffix, 0 AS whole, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
w AS (SELECT {_weight("s", "whole")} AS ws, {_weight("d", "suffix")} AS wd, {_weight("h", "domain")} AS wh, (SELECT (coalesce(sum(k), 0) + {_HOW.base_weight * _HOW.base_rate}) / (coalesce(sum(n), 0) + {_HOW.base_weight}) FROM s) AS rate),
b AS (SELECT name, wh * dr + h.k AS a, wh * (1 - dr) + h.n - h.k AS b FROM h JOIN (SELECT domain, (wd * sr + d.k) / (wd + d.n) AS dr FROM d JOIN (SELECT suffix, (ws * rate + s.k) / (ws + s.n) AS sr FROM s, w) USING (suffix), w) USING (domain), w),
v AS (SELECT name, 1 / (1 + exp(-({_digamma("a")} - {_digamma("b")} - {_HOW.z} * sqrt({_trigamma("a")} + {_trigamma("b")})))) > {_HOW.max_bad} AS blocked FROM b)
SELECT p.page_id, p.host, p.path, x.h || x.p AS rule, CASE WHEN x IS NOT NULL AND x.h IS NOT NULL THEN x.v WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN m ON m.page_id IS NOT DISTINCT FROM p.page_id AND m.host = p.host AND m.path = p.path JOIN v ON v.name = regexp_replace(regexp_replace(p.host, '^.*@', ''), ':[0-9]*$', '')
"""

#: Every filter, order and step evaluated by itself on each text.
OP12_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda j: substr('ABCDE', CAST(j + 1 AS BIGINT), 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
e AS (SELECT part, filter_order, step, o[step] AS j, n, good, toxic, fails[o[step] + 1] AS here, len(list_filter(o[1:step - 1], lambda j: fails[j + 1])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS failures FROM g, s),
a AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, j, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND here), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND here), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (here AND failures = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (NOT gone AND here AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND here AND toxic), 0) AS BIGINT) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, j) AS BIGINT) AS shapley FROM a
"""

#: Paths of every state turn by turn; a path is its cost in nine digits and its audit.
OP13_SQL = r"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS tab),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda s: CAST(unicode(s) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM x, z),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g),
n AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, r, i, before, CASE WHEN e = '' THEN 1 WHEN nth > 1 THEN 2 WHEN e IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM n),
t(q, to_q, cost, edits) AS (VALUES ('n', 'n', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('n', 'u', 5, 'I'), ('s', 'u', 5, 'I'), ('a', 'u', 5, 'I'), ('u', 'a', 5, 'I'), ('n', 'a', 10, 'II'), ('s', 'a', 10, 'II')),
m(q, to_q, cost, edit, r) AS (VALUES ('n', 'n', 2, 'D', NULL), ('s', 's', 2, 'D', NULL), ('u', 'u', 2, 'D', NULL), ('a', 'a', 2, 'D', NULL), ('n', 's', 0, 'K', 's'), ('n', 'u', 0, 'K', 'u'), ('s', 'u', 0, 'K', 'u'), ('a', 'u', 0, 'K', 'u'), ('u', 'a', 0, 'K', 'a'),
  ('n', 'u', 1, 'R', NULL), ('s', 'u', 1, 'R', NULL), ('a', 'u', 1, 'R', NULL), ('u', 'a', 1, 'R', NULL)),
w AS (SELECT t.q, m.to_q, t.cost + m.cost AS cost, t.edits || m.edit AS edits, m.r, m.edit = 'D' AS gone FROM t JOIN m ON m.q = t.to_q),
p(conv_id, i, q, z) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'n', '000000000' FROM conversations UNION ALL
  SELECT p.conv_id, f.i, w.to_q, min(printf('%09d', CAST(left(p.z, 9) AS BIGINT) + w.cost + CASE WHEN f.fault = 3 AND NOT w.gone THEN 5 ELSE 0 END) || substr(p.z, 10) || w.edits)
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN w ON w.q = p.q AND (w.r IS NULL OR w.r = f.r) AND (w.gone OR f.fault NOT IN (1, 2)) GROUP BY p.conv_id, f.i, w.to_q),
l AS (SELECT conv_id, max(i) AS n FROM p GROUP BY conv_id),
b AS (SELECT p.conv_id, min(printf('%09d', CAST(left(z, 9) AS BIGINT) + t.cost) || substr(z, 10) || t.edits) AS z FROM p JOIN l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i JOIN t ON t.q = p.q AND t.to_q IN ('n', 'a') GROUP BY p.conv_id),
k AS (SELECT conv_id, CAST(left(z, 9) AS BIGINT) AS cost, substr(z, 10) AS audit FROM b),
e AS (SELECT conv_id, unnest(regexp_extract_all(audit, 'I*[DKR]')) AS edit, generate_subscripts(regexp_extract_all(audit, 'I*[DKR]'), 1) AS i FROM k),
h AS (SELECT conv_id, i, edit, coalesce(sum(length(replace(edit, 'D', ''))) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM e),
y AS (SELECT conv_id, length(replace(audit, 'D', '')) AS lines, length(regexp_extract(audit, 'I*$')) AS tail, ['user', 'assistant'] AS own FROM k),
v AS (SELECT h.conv_id, h.i, list_transform(range(length(edit) - 1), lambda j: own[CAST((above + j + lines) % 2 AS BIGINT) + 1] || ':') || CASE right(edit, 1) WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [own[CAST((above + length(edit) - 1 + lines) % 2 AS BIGINT) + 1] || ':' || f.text] END AS x
  FROM h JOIN f ON f.conv_id IS NOT DISTINCT FROM h.conv_id AND f.i = h.i JOIN y ON y.conv_id IS NOT DISTINCT FROM h.conv_id),
s AS (SELECT conv_id, flatten(list(x ORDER BY i)) AS x FROM v GROUP BY conv_id),
a AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  sha256(array_to_string(coalesce(s.x, []) || list_transform(range(y.tail), lambda j: own[CAST(j % 2 + CASE WHEN y.tail = 1 THEN 1 ELSE 0 END AS BIGINT) + 1] || ':'), chr(10))) AS repaired_sha256
FROM k LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM k.conv_id JOIN y ON y.conv_id IS NOT DISTINCT FROM k.conv_id
"""

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_line_rules": op4_line_rules,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_suffixes": op7_suffixes,
    "op8_entropy": op8_entropy,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_host_reputation": op11_host_reputation,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_winnowing": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op4_line_rules": OP4_SQL,
    "op7_suffixes": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_host_reputation": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
