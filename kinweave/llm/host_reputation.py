"""URL filter: host and path rules, then host reputation by empirical Bayes. DataFrame operations only.

Rules come first: a rule fits its host and all subdomains where the url's path
starts with the rule's; the longest (host and path together, then host) wins.
What no rule fits is judged by its host's labelled outcomes:

1. Outcomes are counted by host, then by registered domain and suffix; counts are
   sums that tasks take first, so a host with a third of all pages is no group.
2. How far children differ from their parent (suffixes from all, domains from
   their suffix, hosts from their domain) is a correlation rho per level, by
   moments over all groups: with v = m (1 - m) of each parent's rate m and c
   children of n outcomes, N in all, the sum of n (p - m)^2 is expected to be
   v ((c - 1) (1 - rho) + rho (N - sum n^2 / N)). A beta prior with mean m and
   rho has (1 - rho) / rho outcomes' weight.
3. Rates are shrunk from the top: a suffix to the rate of all, a domain to its
   suffix, and a host's rate is a beta posterior around its domain's. A host
   without outcomes has its domain's prior.
4. A host is blocked where the lower posterior bound of its bad rate is above
   max_bad: on the log-odds scale, mean less z standard deviations (digamma and
   trigamma by their series), so a few bad pages of a little-known host don't block it.

A host's verdict goes back to its pages, a domain's rate to its hosts, by
looked_up(): keys with more than `share` of the rows are fewer than 1 / share,
known by digest, and are broadcast; the others are shuffled, and none of them
has more than that share.

Defined results: a null url, or one without ://, has host and path '' and the
reputation of host '', whose pages share it. Host names are lower-cased in A to Z
only and keep user names and ports for rules; reputation leaves both out. A host
that is an address or has one label is its own registered domain, with suffix ''.
An outcome belongs to the page of the same number; it is bad if any of its label
rows has quality 0 or toxic 1; label rows with neither value count nowhere. Rows
with equal page_id are separate pages that share outcomes; pages without page_id
have none. No labels: the rate of all is base_rate, and no host's bound is above
max_bad. No pages, no rows. Other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import common as C

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Reputation:
    rules: tuple[tuple[str, str, str], ...] = RULES  # a branch of the plan each: a few hundred at most
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")  # public suffixes of two labels
    max_bad: float = 0.3
    z: float = 1.6448536269514722  # 95 % of a normal distribution lie above its mean less z
    base_rate: float = 0.1  # of all pages, worth base_weight outcomes
    base_weight: float = 2.0
    rho_least: float = 0.001
    rho_most: float = 0.5
    rho_unknown: float = 0.05
    share: float = 1e-5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        found.append(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, none)


def places(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Name (without user and port), registered domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    own = name.rlike(r"\A[0-9.]+\z") | name.startswith("[") | (n < 2)
    last = {k: F.substring_index(name, ".", -k) for k in (1, 2, 3)}
    two = last[2].isin(*suffixes)
    return name, F.when(own, name).when(two, last[3]).otherwise(last[2]), F.when(own, F.lit("")).when(two, last[2]).otherwise(last[1])


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, count: str, share: float) -> DataFrame:
    """rows with the value of their key; table has each key once, with the number of its rows."""
    names = rows.columns
    total = table.agg(F.sum(count)).first()[0] or 0
    table = table.select(C.digest_of(F.col(key)).alias("__kw_key"), F.col(value).alias("__kw_value"), F.col(count).alias("__kw_count"))
    often = table.where(F.col("__kw_count") > F.lit(total * share)).drop("__kw_count")
    seldom = table.where(F.col("__kw_count") <= F.lit(total * share)).drop("__kw_count")
    rows = rows.withColumn("__kw_own", C.digest_of(F.col(key)))
    same = F.col("__kw_own") == F.col("__kw_key")
    large = rows.join(F.broadcast(often), same).select(*names, F.col("__kw_value").alias(value))
    small = rows.join(F.broadcast(often.select("__kw_key")), same, "left_anti").join(seldom, same).select(*names, F.col("__kw_value").alias(value))
    return large.unionByName(small)


def _spread(children: DataFrame, parent: str, how: Reputation) -> float:
    """rho of one level: children have n outcomes, k of them bad, and their parent."""
    v = F.col("k") / F.col("n") * (F.lit(1.0) - F.col("k") / F.col("n"))
    per = children.where("n > 0").groupBy(parent).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("c"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"))
    between = F.col("kk") - F.col("k").cast("double") * F.col("k") / F.col("n")
    r = per.agg(F.sum(between - v * (F.col("c") - 1)).alias("excess"), F.sum(v * (F.col("n") - F.col("nn") / F.col("n") - (F.col("c") - 1))).alias("most")).first()
    rho = r.excess / r.most if r.most and r.most > 1e-12 else how.rho_unknown
    return min(max(rho, how.rho_least), how.rho_most)


def digamma(x: Column) -> Column:
    y = x + F.lit(8.0)
    return F.ln(y) - F.lit(0.5) / y - F.lit(1 / 12) / (y * y) + F.lit(1 / 120) / (y * y * y * y) - sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(8)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    y = x + F.lit(8.0)
    return F.lit(1.0) / y + F.lit(0.5) / (y * y) + F.lit(1 / 6) / (y * y * y) - F.lit(1 / 30) / (y * y * y * y * y) + sum((F.lit(1.0) / ((x + F.lit(float(i))) * (x + F.lit(float(i)))) for i in range(8)), F.lit(0.0))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Of a beta(a, b) rate, by its log-odds' mean and deviation."""
    odds = digamma(a) - digamma(b) - F.lit(z) * F.sqrt(trigamma(a) + trigamma(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def outcomes(labels: DataFrame) -> DataFrame:
    """id, bad: one row per labelled page."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    said = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    return said.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.bool_or(bad).alias("bad"))


def reputations(parsed: DataFrame, seen: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """name, domain, suffix, pages, n, k, a, b, low, blocked: one row per host name. parsed: page_id, host; seen: id, bad."""
    pages = parsed.select("page_id", places(F.col("host"), how.suffixes)[0].alias("name"))
    # pages without a number meet no outcome, but must not meet in one task either
    pages = pages.withColumn("spread", F.when(F.col("page_id").isNull(), F.xxhash64("name", F.spark_partition_id())).otherwise(F.lit(0)))
    both = pages.join(seen.withColumn("s", F.lit(0).cast("long")), (F.col("page_id") == F.col("id")) & (F.col("spread") == F.col("s")), "left")
    hosts = both.groupBy("name").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("k"))
    _, domain, suffix = places(F.col("name"), how.suffixes)
    hosts = C.materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "host-outcomes")
    sums = [F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = C.materialise(hosts.groupBy("domain", "suffix").agg(*sums), "domain-outcomes")
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    rate = (whole.k + how.base_weight * how.base_rate) / (whole.n + how.base_weight)
    weight = {level: (1.0 - rho) / rho for level, rho in (("suffix", _spread(suffixes.withColumn("all", F.lit(0)), "all", how)), ("domain", _spread(domains, "suffix", how)), ("host", _spread(hosts, "domain", how)))}
    shrunk = lambda prior, w: (F.lit(w) * prior + F.col("k")) / (F.lit(w) + F.col("n"))
    suffixes = suffixes.withColumn("suffix_rate", shrunk(F.lit(rate), weight["suffix"])).select("suffix", "suffix_rate", "children")
    domains = looked_up(domains, "suffix", suffixes, "suffix_rate", "children", how.share)
    domains = domains.withColumn("domain_rate", shrunk(F.col("suffix_rate"), weight["domain"])).select("domain", "domain_rate", "children")
    hosts = looked_up(hosts, "domain", domains, "domain_rate", "children", how.share)
    a = F.lit(weight["host"]) * F.col("domain_rate") + F.col("k")
    b = F.lit(weight["host"]) * (F.lit(1.0) - F.col("domain_rate")) + F.col("n") - F.col("k")
    hosts = hosts.withColumn("a", a).withColumn("b", b).withColumn("low", lower_bound(F.col("a"), F.col("b"), how.z))
    return hosts.select("name", "domain", "suffix", "pages", "n", "k", "a", "b", "low", (F.col("low") > F.lit(how.max_bad)).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    host, path = split_url(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = C.materialise(reputations(parsed, outcomes(labels), how).select("name", "pages", "blocked"), "host-reputations")
    parsed = parsed.withColumn("ruled", rule_of(F.col("host"), F.col("path"), how.rules)).withColumn("name", places(F.col("host"), how.suffixes)[0])
    # only what no rule fits is looked up
    ruled = parsed.where("ruled IS NOT NULL").select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("verdict"))
    rest = looked_up(parsed.where("ruled IS NULL").select("page_id", "host", "path", "name"), "name", hosts, "blocked", "pages", how.share)
    return ruled.unionByName(rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))
