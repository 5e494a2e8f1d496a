"""Registered queries of the entity side: windows, cadence, labels, genres, nesting, readers' logic.

Roles of the driver's tables: customer is the entity, orders its releases
(priority as label), lineitem its recordings, (part, supplier) the work, part
the work's name and genre, nation and region its places. `as_of` is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import catalog, early, matrix, relational
from kinweave.sources import readers
from kinweave.validate import cut

AS_OF = "2002-01-01"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def releases(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("artist"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("kind"))


def recordings(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped"))
    o = releases(spark, d).select("artist", F.col("id").alias("release_id"), "date")
    return li.join(o, F.col("l_orderkey") == F.col("release_id")).drop("l_orderkey")


def parts(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")


def won(spark, d) -> DataFrame:
    r = releases(spark, d)
    return early.in_window(r, early.career_window(r))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cents(c: str):
    """An amount as a decimal: its means are exact, whatever the order of the sum."""
    return F.col(c).cast("decimal(18,2)")


def doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else f.name for f in df.schema])


# ---- queries -------------------------------------------------------------------


def early_window_cadence(spark, d):
    got = early.cadence(won(spark, d), AS_OF)
    w = early.career_window(releases(spark, d))
    return rounded(w.join(got, "artist"), "releases_per_year", "avg_days_between_releases", "release_velocity_releases_per_day", "release_velocity_releases_per_year", "gap_median_days", "gap_std_days", "max_dry_spell_days", "front_loading_index")


def debut_fallback(spark, d):
    r = releases(spark, d)
    dated = r.withColumn("date", F.when(F.col("label") == "1-URGENT", F.col("date")))
    works = recordings(spark, d).select("artist", F.col("shipped").alias("date"))
    return early.career_window(dated, works)


def derived_work_dates(spark, d):
    rec = recordings(spark, d).withColumn("work_id", F.col("l_partkey"))
    inside = won(spark, d).select("artist", F.col("id").alias("release_id"), F.col("date").alias("released")).distinct()
    own = rec.groupBy("artist", F.col("work_id").alias("id")).agg(F.min("shipped").alias("own"))
    return early.work_dates(own, rec.select("artist", "work_id", "release_id"), inside).withColumnsRenamed({"id": "l_partkey", "date": "first_date"})


def collab_rate(spark, d):
    rec = cut(recordings(spark, d).select("artist", "release_id", "l_partkey", "l_suppkey"))  # read four times
    work = F.struct("l_partkey", "l_suppkey")
    teams = rec.groupBy(work.alias("work")).agg(F.array_sort(F.collect_set("artist")).alias("collaborators"))
    inside = won(spark, d).select(F.col("id").alias("release_id"))
    tracks = rec.join(inside, "release_id", "left_semi").select("artist", work.alias("work"))
    return rounded(early.collaboration(tracks, teams), "collab_track_rate")


def label_profile(spark, d):
    return rounded(early.label_profile(won(spark, d)), "label_hhi")


def genre_entropy(spark, d):
    works = recordings(spark, d).join(parts(spark, d), "l_partkey").select("artist", "l_partkey", F.col("p_type").alias("genre")).distinct()
    return rounded(early.genre_profile(works), "genre_entropy")


def duration_title_profile(spark, d):
    rec = recordings(spark, d).join(parts(spark, d), "l_partkey").select("artist", F.col("p_name").alias("name"), cents("l_extendedprice").alias("length_ms"))
    return rounded(doubles(early.duration_title_profile(rec, "ring", "an")), "duration_ms_median", "remix_rate", "acoustic_rate")


def temporal_controls(spark, d):
    return rounded(early.temporal_controls(releases(spark, d), AS_OF), "years_active", "recency_index")


def role_profile(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("artist"), F.when(F.col("c_custkey") % 7 != 0, F.concat_ws(" , ", "c_mktsegment", F.lower("c_mktsegment"), F.lit("Writer"), F.lit(" "))).alias("roles"))
    return early.role_profile(c)


def market_kinds(spark, d):
    rec = recordings(spark, d).join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return early.market_kinds(releases(spark, d), rec.select("artist", F.col("s_nationkey").alias("market")))


def popularity_thresholds(spark, d):
    r = releases(spark, d).withColumn("price", cents("price"))
    return rounded(doubles(relational.threshold_profile(r, ["artist"], "price", {"share_100k": 100000, "share_200k": 200000})), "median_price", "share_100k", "share_200k")


def yearly_nearest_rank(spark, d):
    first = recordings(spark, d).groupBy("l_partkey").agg(F.min(F.year("date")).alias("year"), F.max(cents("l_extendedprice")).alias("price"))
    return rounded(doubles(relational.yearly_profile(first, "price")), "median_price")


def clean_fill_flags(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("artist_mbid"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("primary_role"), "c_nationkey")
    got = early.cadence(won(spark, d).where(F.col("label").isin("1-URGENT", "2-HIGH")), AS_OF).withColumnRenamed("artist", "artist_mbid").select("artist_mbid", "releases_total", "gap_std_days")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("artist_country"))
    df = c.join(got, "artist_mbid", "left").join(n, "c_nationkey", "left").drop("c_nationkey").withColumn("recency_index", F.when(F.col("artist_mbid") % 3 == 0, 0.5))
    return rounded(matrix.clean_features(df), "gap_std_days")


def _work_arrays(spark, d):
    rec = recordings(spark, d)
    teams = rec.groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_set("artist")).alias("collaborators"))
    own = rec.groupBy("artist", "l_partkey", "l_suppkey").agg(F.min("shipped").alias("date")).join(teams, ["l_partkey", "l_suppkey"])
    return own.groupBy("artist").agg(F.collect_list(F.struct("date", "collaborators")).alias("works"))


def gap_sanity_filter(spark, d):
    dates = releases(spark, d).groupBy("artist").agg(F.collect_list("date").alias("dates"))
    return dates.where(early.gap_sane(F.col("dates"), 200)).select("artist", F.size("dates").cast("long").alias("n_dates"))


def early_collab_exists(spark, d):
    w = _work_arrays(spark, d)
    start = F.array_min(F.transform("works", lambda x: x["date"]))
    return w.where(early.early_collaborator(F.col("works"), start, F.col("artist"), 365)).select("artist")


def workset_union(spark, d):
    rec = recordings(spark, d).join(parts(spark, d), "l_partkey")
    written = rec.where(F.col("l_linenumber") == 1).select("artist", "l_partkey", F.col("p_name").alias("work_name"))
    played = rec.where(F.col("l_linenumber") > 1).select("artist", "l_partkey", F.upper("p_name").alias("work_name"))
    return catalog.merge_works(written, played, ["artist", "l_partkey"], "work_name")


def _events(spark, d):
    s = F.col("l_shipdate").cast("date")
    n = F.col("l_linenumber")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("release"), F.when(n % 4 != 1, F.year(s)).alias("date_year"), F.when(n % 3 != 2, F.month(s)).alias("date_month"), F.when(n % 2 == 0, F.dayofmonth(s)).alias("date_day"))


def earliest_event_top1(spark, d):
    return catalog.earliest_event(_events(spark, d))


def release_flatten_labels(spark, d):
    rec = recordings(spark, d).join(parts(spark, d), "l_partkey")
    raw = rec.select(F.col("artist").alias("artist_id"), "release_id", F.col("p_name").alias("title"), F.col("shipped").alias("date"), F.col("l_partkey").alias("release_group_id"), F.col("p_brand").alias("label_id"), F.when(F.col("p_brand") != "Brand#11", F.col("p_type")).alias("label_name"))
    out = catalog.flat_releases(raw)
    return out.withColumn("label_ids", F.concat_ws("|", "label_ids")).withColumn("label_names", F.concat_ws("|", "label_names"))


def _docs(spark, d):
    rel = releases(spark, d).groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("id", F.col("date").cast("string").alias("date"), "label"))).alias("releases"))
    rec = recordings(spark, d).groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("release_id", "l_partkey", F.col("l_extendedprice").alias("length")))).alias("recordings"))
    return rel.join(rec, "artist", "full")


def cohort_placeholder_join(spark, d):
    cohort = read(spark, d, "customer").select((F.col("c_custkey") * 3).cast("string").alias("mbid"), F.col("c_custkey").alias("pos"))
    docs = _docs(spark, d).withColumn("mbid", F.col("artist").cast("string")).select("mbid", "releases")
    return catalog.placeholders(cohort, docs).select("mbid", "pos", F.size("releases").cast("long").alias("n_releases"))


def source_url_map(spark, d):
    p = read(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("mbid"), "page_id", "url")
    r = p.groupBy("mbid").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("resources"))
    got = catalog.url_map(r, "1")
    return got.select("mbid", "url", S.last_segment("url").alias("segment"), S.base62_id("url").alias("id22"))


def resource_groups(spark, d):
    p = read(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").alias("size"), "page_id")
    return catalog.resource_groups(p, "host", "page_id", "size")


def dedupe_keep_last(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return relational.keep_last(e, ["user_id"], ["event_id"])


def dedupe_keep_first(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))
    return relational.keep_first(e, ["user_id", "event_type"], ["event_id"])


def json_props_extract(spark, d):
    e = readers.json_field(read(spark, d, "events"), "props", "k", "bigint", "k")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def resume_antijoin(spark, d):
    e = read(spark, d, "events")
    todo = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("name"))
    done = e.where(F.col("value") > 20).select("user_id", F.when(F.col("user_id") % 50 == 0, F.concat(F.lit(" "), F.lit("machinery"))).alias("name"))
    return relational.not_done(todo, done.where("user_id % 3 = 0"), "user_id", "name").select("user_id", "name")


def yearly_top_labels(spark, d):
    n = releases(spark, d).groupBy(F.year("date").alias("year"), "label").agg(F.count("*").alias("n"))
    return relational.top_k(n, ["year"], [F.col("n").desc(), F.col("label")], 3).withColumn("rank", F.col("rank").cast("long"))


def top10_other(spark, d):
    return relational.top_or_other(read(spark, d, "part"), "p_brand", 10)


def outlier_quantile_filter(spark, d):
    c = releases(spark, d).groupBy("artist").agg(F.round(F.sum("price"), 2).alias("followers"))
    return rounded(matrix.log_target(c, "followers", 0.9), "target")


def zscores(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("balance"), F.lit(3.0).alias("same"))
    pop = relational.z_scores(c, ["balance", "same"])
    sample = relational.z_scores(c.select("c_custkey", (F.abs("balance")).alias("size")), ["size"], sample=True, log=True)
    return rounded(pop.join(sample, "c_custkey").select("c_custkey", "balance_z", "same_z", "size_z"), "balance_z", "same_z", "size_z")


def minmax(spark, d):
    return rounded(relational.min_max(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice_scaled", "p_size_scaled"), "p_retailprice_scaled", "p_size_scaled")


def decile_bins(spark, d):
    c = releases(spark, d).groupBy("artist").agg(F.count("*").alias("n_releases"))
    return relational.quantile_bins(c, "n_releases", 10).withColumn("bin", F.col("bin").cast("long"))


def stratified_split(spark, d):
    c = relational.quantile_bins(releases(spark, d).groupBy("artist").agg(F.sum("price").alias("followers")), "followers", 10)
    s = relational.stratified_split(c, "bin", "artist")
    return s.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


def missing_rates(spark, d):
    c = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    return rounded(relational.missing_rates(c), "missing_rate")


def price_histogram(spark, d):
    return relational.histogram(read(spark, d, "orders").where("o_totalprice > 0"), "o_totalprice", 12, log=True)


def describe_balances(spark, d):
    c = read(spark, d, "customer")
    out = relational.describe(c, ["c_mktsegment"], "c_acctbal", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p995": 0.995}, "balance")
    return rounded(out, "mean_balance", "std_balance", "p25", "p50", "p75", "p995")


def ranking_summary(spark, d):
    return rounded(relational.ranking_summary(read(spark, d, "customer"), "c_acctbal"), "mean_score", "median_score", "top_mean")


def regression_metrics(spark, d):
    r = releases(spark, d).groupBy("artist").agg(F.avg("price").alias("prediction"), F.max("price").alias("actual"))
    r = r.select((F.ln("actual")).alias("actual"), F.ln("prediction").alias("prediction"))
    return rounded(relational.regression_metrics(r, "actual", "prediction"), "rmse", "mae", "r2")


def role_classifier(spark, d):
    base = F.element_at(F.array(*map(F.lit, ["Lyricist", "lead vocal", "Sound Engineer", "dancer", "", "singer-writer", "co-producer"])), (F.col("c_custkey") % 7 + 1).cast("int"))
    c = read(spark, d, "customer").select("c_custkey", base.alias("role"), F.concat(F.lit(" ; ,"), "c_mktsegment", F.lit("|x")).alias("genres"))
    return c.select("c_custkey", S.role_class("role").alias("role_major"), S.first_token("genres").alias("genre_first"))


def date_parsers(spark, d):
    day = F.col("o_orderdate").cast("date")
    forms = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy"), F.lit("2001-02-30"), F.lit(""), F.lit("bad"), F.concat(F.lit(" "), F.date_format(day, "yyyy-M-d")))
    kind = F.element_at(F.array(*map(F.lit, ["day", "month", "year"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = read(spark, d, "orders").select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("s"), kind.alias("kind"), F.date_format(day, "yyyy-MM-dd").alias("full"))
    return o.select("o_orderkey", S.strict_date("s").alias("strict"), S.loose_date("s").alias("loose"), S.precision_date("full", "kind").alias("by_precision"), S.plausible_year("s", 1950, 2002).alias("year"), S.ordinal(S.loose_date("s")).cast("long").alias("day_number"))


def uuid_normalise(spark, d):
    h = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    forms = F.array(h, F.upper(dashed), F.concat(F.lit("{"), dashed, F.lit("}")), F.concat(F.lit("urn:uuid:"), dashed), F.substring(h, 1, 30))
    c = read(spark, d, "customer").select("c_custkey", F.element_at(forms, (F.col("c_custkey") % 5 + 1).cast("int")).alias("given"))
    return c.select("c_custkey", S.uuid("given").alias("mbid"), F.coalesce(S.is_uuid("given"), F.lit(False)).alias("was_normal"))


def final_assembly(spark, d):
    c = read(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("artist_mbid"), F.col("c_name").alias("artist_name"), F.col("c_mktsegment").alias("primary_role"), F.lit(5).alias("window_years")).where("artist_mbid % 10 <> 9")
    n = c.select((F.col("c_custkey") + 2).alias("node"), F.round(F.col("c_acctbal") / 100, 4).alias("eigen_centrality"), F.lit(1).alias("__o"))
    nodes = n.unionByName(n.where("node % 5 = 0").withColumn("eigen_centrality", F.lit(-1.0)).withColumn("__o", F.lit(2)))
    emb = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("artist_mbid"), F.round(F.col("c_acctbal") * 0.5, 4).alias("n2v_0"))
    m = releases(spark, d).select(F.col("artist").alias("artist_mbid"), F.concat(F.lit("s"), F.col("artist")).alias("artist_id"), F.round("price", 2).alias("followers"), F.lit(7).alias("popularity"), F.col("id").alias("__o"))
    return matrix.build_final(base, nodes, emb, m, "__o")


def top_customers(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))
    return relational.top_rows(c, [F.col("balance").desc(), F.col("c_custkey")], 25)


def shared_and_missing_ids(spark, d):
    cust = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return relational.id_overlap(cust, read(spark, d, "events").select(F.col("user_id").alias("id")), "id")


NAMES = [
    early_window_cadence, debut_fallback, derived_work_dates, collab_rate, label_profile, genre_entropy, duration_title_profile, temporal_controls, role_profile,
    market_kinds, popularity_thresholds, yearly_nearest_rank, clean_fill_flags, gap_sanity_filter, early_collab_exists, workset_union, earliest_event_top1,
    release_flatten_labels, cohort_placeholder_join, source_url_map, resource_groups, dedupe_keep_last, dedupe_keep_first, json_props_extract,
    resume_antijoin, yearly_top_labels, top10_other, outlier_quantile_filter, zscores, minmax, decile_bins, stratified_split, missing_rates, price_histogram,
    describe_balances, ranking_summary, regression_metrics, role_classifier, date_parsers, uuid_normalise, final_assembly, top_customers, shared_and_missing_ids,
]
QUERIES = {f.__name__: f for f in NAMES}
