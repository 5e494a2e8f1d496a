"""One row per entity from its early years: windows, cadence, labels, genres, durations, roles.

Inputs are flat tables with the column `artist`. Everything is a window or an
aggregation on that key, so one partitioning of the releases serves cadence,
labels and controls alike. Dates that are null are skipped; an entity without a
dated release has null measures and zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.functions import scalars as S
from kinweave.validate import as_date


def career_window(releases: DataFrame, works: DataFrame | None = None, years: int = 5) -> DataFrame:
    """artist, debut_date, window_cutoff_date. Works count only where no release is dated; the cutoff is exclusive."""
    r = releases.groupBy("artist").agg(F.min("date").alias("__r"))
    if works is not None:
        w = works.groupBy("artist").agg(F.min("date").alias("__w"))
        r = r.join(w, "artist", "full")
        debut = F.coalesce("__r", "__w")
    else:
        debut = F.col("__r")
    return r.select("artist", debut.alias("debut_date")).withColumn("window_cutoff_date", F.add_months("debut_date", 12 * years))


def in_window(rows: DataFrame, window: DataFrame) -> DataFrame:
    """Dated rows before the cutoff (all dated rows where there is none), with the window's columns."""
    joined = rows.join(window, "artist")
    return joined.where(F.col("date").isNotNull() & (F.col("window_cutoff_date").isNull() | (F.col("date") < F.col("window_cutoff_date"))))


def cadence(rows: DataFrame, as_of: str) -> DataFrame:
    """rows: in_window releases with `id`. Counts, gaps, velocity, front loading."""
    order = W.partitionBy("artist").orderBy("date", "id")
    days = F.datediff("date", "debut_date")
    r = rows.withColumn("gap", F.datediff("date", F.lag("date").over(order))).withColumn("n", F.row_number().over(order)).withColumn("days", days)
    end = F.coalesce(F.col("window_cutoff_date"), F.max("date").over(W.partitionBy("artist")))
    half = F.date_add("debut_date", F.floor(F.datediff(end, F.col("debut_date")) / 2).cast("int"))
    r = r.withColumn("early", (F.col("date") < half).cast("double"))
    elapsed = F.greatest(F.lit(0), F.datediff(F.least(F.first("window_cutoff_date"), as_date(as_of)), F.first("debut_date"))) / 365.25
    slope = F.regr_slope(F.col("n").cast("double"), F.col("days").cast("double"))
    return r.groupBy("artist").agg(
        F.count("*").alias("releases_total"),
        F.try_divide(F.count("*").cast("double"), F.nullif(elapsed, F.lit(0.0))).alias("releases_per_year"),
        F.avg("gap").alias("avg_days_between_releases"),
        slope.alias("release_velocity_releases_per_day"),
        (slope * 365.25).alias("release_velocity_releases_per_year"),
        F.percentile("gap", F.lit(0.5)).alias("gap_median_days"),
        F.stddev_pop("gap").alias("gap_std_days"),
        F.max("gap").cast("double").alias("max_dry_spell_days"),
        F.avg("early").alias("front_loading_index"),
    )


def most_common(rows: DataFrame, keys: list[str], item: str, out: str) -> DataFrame:
    """The most frequent item of each key, the smallest of equally frequent ones."""
    n = rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(item, F.struct(-F.col("__n"), F.col(item))).alias(out))


def label_profile(rows: DataFrame) -> DataFrame:
    """rows: in-window releases with id and label (canonical, maybe blank)."""
    order = W.partitionBy("artist").orderBy("date", "id")
    some = rows.where(F.coalesce(F.col("label"), F.lit("")) != "")
    some = some.withColumn("changed", (F.lag("label").over(order) != F.col("label")).cast("int"))
    churn = some.groupBy("artist").agg(F.sum(F.coalesce("changed", F.lit(0))).alias("label_churn"), S.ordered_set_text(F.transform(F.array_sort(F.collect_list(F.struct("date", "id", "label"))), lambda x: x["label"])).alias("all_labels_str"))
    n = some.groupBy("artist", "label").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("artist")))
    top = n.groupBy("artist").agg(F.count("*").alias("label_diversity_count"), F.sum(F.col("share") * F.col("share")).alias("label_hhi"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("primary_label"))
    return top.join(churn, "artist")


def genre_profile(rows: DataFrame) -> DataFrame:
    """rows: artist, genre (one row for each work and genre). Natural-log entropy."""
    n = rows.where(F.coalesce(F.col("genre"), F.lit("")) != "").groupBy("artist", "genre").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("artist")))
    return n.groupBy("artist").agg(
        F.count("*").alias("genre_count"),
        (-F.sum(F.col("p") * F.ln("p"))).alias("genre_entropy"),
        F.min_by("genre", F.struct(-F.col("n"), F.col("genre"))).alias("primary_genre"),
        F.concat_ws(", ", F.array_sort(F.collect_list(F.lower("genre")))).alias("all_genres_str"),
    )


def duration_title_profile(rows: DataFrame, remix: str = "remix", acoustic: str = "acoustic") -> DataFrame:
    """rows: artist, name, length_ms."""
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    share = lambda word: F.avg(F.contains(name, F.lit(word)).cast("double"))
    return rows.groupBy("artist").agg(
        F.avg("length_ms").alias("duration_ms_mean"),
        F.percentile("length_ms", F.lit(0.5)).alias("duration_ms_median"),
        F.min("length_ms").alias("duration_ms_min"),
        F.max("length_ms").alias("duration_ms_max"),
        share(remix).alias("remix_rate"),
        share(acoustic).alias("acoustic_rate"),
    )


def collaboration(recordings: DataFrame, works: DataFrame) -> DataFrame:
    """recordings: artist, work; works: work, collaborators (array, the artist among them). A work of one is solo."""
    flagged = recordings.join(works.select("work", (F.size("collaborators") > 1).alias("collab")), "work", "left").withColumn("collab", F.coalesce("collab", F.lit(False)))
    rate = flagged.groupBy("artist").agg(F.count("*").alias("tracks_total"), F.count_if("collab").alias("collab_tracks"), S.ratio(F.count_if("collab"), F.count("*")).alias("collab_track_rate"))
    # names are sent once for each work of an artist, not as an array with each recording
    people = works.where(F.size("collaborators") > 1).select("work", F.explode("collaborators").alias("c"))
    entries = recordings.select("artist", "work").distinct().join(people, "work").select("artist", "c").distinct()
    unique = entries.groupBy("artist").agg(F.count("*").alias("unique_collaborator_count"))
    return rate.join(unique, "artist", "left").withColumn("unique_collaborator_count", F.coalesce("unique_collaborator_count", F.lit(0)))


def temporal_controls(rows: DataFrame, as_of: str, decay: float = 0.1) -> DataFrame:
    """rows: artist, date (all dates). Years active, debut year and decade, exponential recency by months of 30.44 days."""
    now = as_date(as_of)
    debut, last = F.min("date"), F.max("date")
    return rows.where("date is not null").groupBy("artist").agg(
        (F.datediff(now, debut) / 365.25).alias("years_active"),
        F.year(debut).alias("debut_year"),
        (F.year(debut) - F.year(debut) % 10).alias("debut_decade"),
        F.exp(-decay * F.greatest(F.lit(0), F.datediff(now, last)) / 30.44).alias("recency_index"),
    )


def role_profile(rows: DataFrame) -> DataFrame:
    """rows: artist, roles (comma list). Most common role, 'unknown' without one, and the roles in order."""
    parts = F.filter(F.transform(F.split(F.coalesce("roles", F.lit("")), ","), S.clean), lambda x: x != "")
    each = rows.select("artist", F.explode(parts).alias("role"))
    top = most_common(each, ["artist"], "role", "primary_role")
    text = rows.groupBy("artist").agg(S.ordered_set_text(F.flatten(F.array_sort(F.collect_list(F.split(F.coalesce("roles", F.lit("")), ","))))).alias("all_roles_str"))
    return text.join(top, "artist", "left").withColumn("primary_role", F.coalesce("primary_role", F.lit("unknown")))


def gap_sane(dates: Column, limit: int = 365 * 20) -> Column:
    """False if at least three dates are there and one of the first two gaps exceeds limit days."""
    d = F.array_sort(F.array_compact(dates))
    gap = lambda i: F.datediff(F.get(d, F.lit(i + 1)), F.get(d, F.lit(i)))
    return F.when(F.size(d) < 3, F.lit(True)).otherwise((gap(0) <= limit) & (gap(1) <= limit))


def early_collaborator(works: Column, start: Column, own: Column, days: int | None = 5 * 365) -> Column:
    """Whether a dated work (struct date, collaborators) up to start + days, inclusive, has another collaborator."""
    def good(w):
        other = F.exists(w["collaborators"], lambda c: c != own)
        return other if days is None else w["date"].isNotNull() & (w["date"] <= F.date_add(start, days)) & other

    return F.coalesce(F.exists(works, good), F.lit(False))


def work_dates(works: DataFrame, recordings: DataFrame, inside: DataFrame) -> DataFrame:
    """works with derived (the earliest date of an in-window release with a recording of the work) and date, the earlier of own and derived.

    works: artist, id, own; recordings: artist, work_id, release_id; inside: artist, release_id, released.
    """
    played = recordings.join(inside, ["artist", "release_id"])
    derived = played.groupBy("artist", F.col("work_id").alias("id")).agg(F.min("released").alias("derived"))
    return works.join(derived, ["artist", "id"], "left").withColumn("date", F.least("own", "derived"))


def market_kinds(releases: DataFrame, markets: DataFrame) -> DataFrame:
    """artist, kinds ('kind:count' of each kind, sorted), markets (distinct ones). releases: artist, kind; markets: artist, market."""
    n = releases.where("kind is not null").groupBy("artist", "kind").agg(F.count("*").alias("n"))
    kinds = n.groupBy("artist").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string"))))).alias("kinds"))
    return kinds.join(markets.groupBy("artist").agg(F.countDistinct("market").alias("markets")), "artist", "left")


def first_works(works: Column, n: int) -> Column:
    """The first n entries of an array of works, all if there are fewer."""
    return F.slice(works, 1, n)


def song_features(docs: DataFrame, n: int) -> DataFrame:
    """artist, n_songs, avg_collaborators (entries per song), unique_collaborators and unique_works over the first n works of nested documents."""
    w = docs.select(F.col("mbid").alias("artist"), F.posexplode(first_works(F.col("works"), n)).alias("i", "w"))
    others = F.filter(F.coalesce(F.col("w.collaborators"), F.array().cast("array<struct<mbid: string, role: string>>")), lambda c: c["mbid"] != F.col("artist"))
    each = w.select("artist", F.col("w.id").alias("work"), F.transform(others, lambda c: c["mbid"]).alias("c"))
    per = each.groupBy("artist").agg(F.count("*").alias("n_songs"), F.avg(F.size("c")).alias("avg_collaborators"), F.countDistinct("work").alias("unique_works"))
    people = each.select("artist", F.explode("c").alias("p")).groupBy("artist").agg(F.countDistinct("p").alias("unique_collaborators"))
    return per.join(people, "artist", "left").withColumn("unique_collaborators", F.coalesce("unique_collaborators", F.lit(0)))


def named(df: DataFrame, column: str, text: str, how: str = "contains") -> DataFrame:
    """Rows whose name contains, starts with or equals a text, in any case and without outer white space."""
    name, text = S.clean(column), text.strip().lower()
    return df.where({"contains": F.contains(name, F.lit(text)), "prefix": F.startswith(name, F.lit(text)), "equals": name == text}[how])


def features(docs: DataFrame, as_of: str, years: int = 5) -> DataFrame:
    """The 40 early features of nested entity documents (schemas.ARTIST_DOC), one row per document."""
    from kinweave.schemas import EARLY_COLUMNS

    base = docs.select(F.col("mbid").alias("artist"), "artist_name", "roles", "country", "region_city")
    releases = docs.select(F.col("mbid").alias("artist"), F.explode("releases").alias("r")).select("artist", F.col("r.id").alias("id"), S.strict_date("r.date").alias("date"), S.canonical_label(F.col("r.label_names"), F.col("r.label_ids")).alias("label"))
    works = docs.select(F.col("mbid").alias("artist"), F.explode("works").alias("w")).select("artist", F.col("w.id").alias("id"), S.strict_date("w.first_release_date").alias("own"), F.col("w.genres").alias("genres"), F.col("w.collaborators").alias("collaborators"))
    recordings = docs.select(F.col("mbid").alias("artist"), F.explode("recordings").alias("c")).select("artist", "c.*")
    window = career_window(releases, works.withColumnRenamed("own", "date"), years)
    won = in_window(releases, window)
    inside = won.select("artist", F.col("id").alias("release_id"), F.col("date").alias("released")).distinct()
    dated = work_dates(works, recordings, inside)
    works_in = in_window(dated, window)
    heard = recordings.join(inside.select("artist", "release_id"), ["artist", "release_id"], "left_semi")
    key = F.struct("artist", F.col("work_id").alias("id"))
    tracks = heard.select("artist", key.alias("work"))
    teams = works_in.select(F.struct("artist", "id").alias("work"), F.transform("collaborators", lambda c: F.to_json(c)).alias("collaborators"))
    dates = releases.select("artist", "date").union(works.select("artist", "own"))
    out = base.join(window, "artist", "left")
    for part in (
        cadence(won, as_of),
        collaboration(tracks, teams),
        label_profile(won),
        duration_title_profile(heard),
        genre_profile(works_in.select("artist", F.explode("genres").alias("genre"))),
        temporal_controls(dates, as_of),
        role_profile(base.select("artist", "roles")),
    ):
        out = out.join(part, "artist", "left")
    zero = ["releases_total", "tracks_total", "unique_collaborator_count", "label_diversity_count", "label_churn", "genre_count"]
    out = out.fillna(0, zero).withColumn("window_years", F.lit(years))
    return out.withColumnsRenamed({"artist": "artist_mbid", "country": "artist_country", "region_city": "artist_region_city"}).select(*EARLY_COLUMNS)


def work_parts(works: DataFrame, listings: DataFrame, facts: DataFrame, remix: str = "remix", acoustic: str = "acoustic") -> DataFrame:
    """work_id, works, released, lengths, remixes, acoustics, releases: what measured() needs of each work, made once for all its artists.

    works: catalog.work_facts(); listings: catalog.listings(); facts: catalog.release_facts(). released and lengths have an
    entry for each listing, remixes and acoustics the release dates of those with the word in their name.
    """
    entry = F.struct(S.strict_date("first_release_date").alias("own"), "genres", F.transform("collaborators", lambda c: F.to_json(c)).alias("people"))
    w = works.select("work_id", entry.alias("__w")).groupBy("work_id").agg(F.collect_list("__w").alias("works"))
    r = facts.select("release_id", S.strict_date(F.date_format("date", "yyyy-MM-dd")).alias("date"), S.canonical_label(F.col("label_names"), F.col("label_ids")).alias("label"))
    name = F.lower(F.coalesce(F.col("rec_name"), F.lit("")))
    has = lambda word: F.collect_list(F.when(F.contains(name, F.lit(word)), F.col("date")))
    c = listings.join(r, "release_id").groupBy("work_id").agg(F.collect_list(F.struct("date", F.col("release_id").alias("id"), "label", "length_ms")).alias("__c"), has(remix).alias("remixes"), has(acoustic).alias("acoustics"))
    release = F.transform("__c", lambda x: F.struct(x["date"].alias("date"), x["id"].alias("id"), x["label"].alias("label")))
    c = c.select("work_id", F.col("__c")["date"].alias("released"), F.col("__c")["length_ms"].alias("lengths"), "remixes", "acoustics", release.alias("releases"))
    both = w.join(c, "work_id", "left")
    return both.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in c.schema if f.name != "work_id"})


def _run_starts(c: str) -> Column:
    """Where runs of equal entries start in a sorted array."""
    return F.array_compact(F.transform(c, lambda x, i: F.when((i == 0) | (x != F.get(c, i - 1)), i)))


def _runs(c: str, starts: str) -> Column:
    """(n, item) of the runs of a sorted array."""
    return F.transform(starts, lambda s, j: F.struct((F.coalesce(F.get(starts, j + 1), F.size(c)) - s).alias("n"), F.get(c, s).alias("item")))


def _most_frequent(runs: str) -> Column:
    """The most frequent item of runs, the smallest of equally frequent ones."""
    return F.array_min(F.transform(runs, lambda x: F.struct((-x["n"]).alias("n"), x["item"].alias("item"))))["item"]


def _median(c: str) -> Column:
    """Of a sorted array without nulls."""
    return (F.get(c, F.floor((F.size(c) - 1) / 2).cast("int")) + F.get(c, F.floor(F.size(c) / 2).cast("int"))) / F.lit(2.0)


def measured(docs: DataFrame, as_of: str, years: int = 5) -> DataFrame:
    """The 40 features of features(), of rows of mbid, artist_name, roles, country, region_city and parts, an array of work_parts() of the artist's works.

    All by functions of a row's arrays, so that neither recordings nor releases leave the row they came with.
    """
    from kinweave.schemas import EARLY_COLUMNS

    zero, now, cutoff, debut = F.lit(0).cast("long"), as_date(as_of), F.col("window_cutoff_date"), F.col("debut_date")
    total = lambda c, f=lambda x: x: F.aggregate(c, zero, lambda a, x: a + f(x).cast("long"))
    d = docs.withColumns({"releases": F.sort_array(F.flatten(F.col("parts")["releases"])), "__own": F.flatten(F.col("parts")["works"])["own"]})
    ends = {"__r0": F.array_min(F.col("releases")["date"]), "__r1": F.array_max(F.col("releases")["date"]), "__w0": F.array_min("__own"), "__w1": F.array_max("__own")}
    d = d.withColumns(ends).withColumn("debut_date", F.coalesce("__r0", "__w0")).withColumn("window_cutoff_date", F.add_months("debut_date", 12 * years))

    # releases in the window by date and id; one that several works bring is next to itself
    won = F.filter("releases", lambda x, i: (x["date"] < cutoff) & ((i == 0) | (F.get("releases", i - 1)["id"] != x["id"])))
    heard = F.transform("parts", lambda p: F.struct(
        p["works"].alias("works"), F.array_min(p["released"]).alias("first"), F.filter(p["lengths"], lambda x, i: F.get(p["released"], i) < cutoff).alias("lengths"),
        F.size(F.filter(p["remixes"], lambda x: x < cutoff)).alias("remixes"), F.size(F.filter(p["acoustics"], lambda x: x < cutoff)).alias("acoustics"),
    ))
    d = d.withColumns({"__won": won, "__heard": heard}).drop("releases", "parts", "__own")

    # works in the window: their own date or that of the first release heard
    inside = lambda h: F.filter(h["works"], lambda w: F.least(w["own"], F.when(h["first"] < cutoff, h["first"])) < cutoff)
    teams = F.transform("__heard", lambda h: F.struct(F.size(h["lengths"]).alias("n"), inside(h).alias("works")))
    d = d.withColumns({
        "__days": F.transform("__won", lambda x: F.datediff(x["date"], debut)), "__label": F.filter(F.col("__won")["label"], lambda x: x != ""), "__teams": teams,
        "__length": F.flatten(F.col("__heard")["lengths"]), "__remixes": total(F.col("__heard")["remixes"]), "__acoustics": total(F.col("__heard")["acoustics"]),
    }).drop("__won", "__heard")

    n, step = F.size("__days"), F.transform("__days", lambda x, i: x - F.get("__days", i - 1))
    sums = F.struct(*[zero.alias(c) for c in ("n", "x", "xx", "xy")])
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["x"] + x).alias("x"), (a["xx"] + x.cast("long") * x).alias("xx"), (a["xy"] + (a["n"] + 1) * x).alias("xy"))
    team = F.flatten(F.transform(F.filter("__teams", lambda t: t["n"] > 0), lambda t: F.flatten(F.filter(t["works"], lambda w: F.size(w["people"]) > 1)["people"])))
    role = F.split(F.coalesce("roles", F.lit("")), ",")
    d = d.withColumns({
        "__gaps": F.sort_array(F.array_compact(step)), "__sums": F.aggregate("__days", sums, add), "__labels": F.sort_array("__label"), "__lengths": F.sort_array(F.array_compact("__length")),
        "__genres": F.sort_array(F.filter(F.flatten(F.flatten(F.col("__teams")["works"])["genres"]), lambda x: x != "")),
        "__roles": F.sort_array(F.filter(F.transform(role, S.clean), lambda x: x != "")), "__people": F.size(F.array_distinct(team)).cast("long"),
        "tracks_total": total("__teams", lambda t: t["n"] * F.greatest(F.lit(1), F.size(t["works"]))),
        "__collab": total("__teams", lambda t: t["n"] * F.size(F.filter(t["works"], lambda w: F.size(w["people"]) > 1))),
    })
    kinds = ("__labels", "__genres", "__roles")
    d = d.withColumns({f"{c}_at": _run_starts(c) for c in kinds}).withColumns({f"{c}_n": _runs(c, f"{c}_at") for c in kinds})

    real = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    share = lambda c, f: F.aggregate(f"{c}_n", F.lit(0.0), lambda a, x: a + f(x["n"] / F.size(c)))
    m, k, tracks = F.size("__gaps"), real(n), F.size("__length")
    span = F.get("__days", n - 1) - F.get("__days", F.lit(0))
    x, xx, xy = (real(F.col("__sums")[c]) for c in ("x", "xx", "xy"))
    slope = F.try_divide(k * xy - x * (k * (k + 1) / 2), F.nullif(k * xx - x * x, F.lit(0.0)))
    elapsed = F.greatest(F.lit(0), F.datediff(F.least(cutoff, now), debut)) / 365.25
    half = F.floor(F.datediff(cutoff, debut) / 2).cast("int")
    a, b = F.least("__r0", "__w0"), F.greatest("__r1", "__w1")
    some = lambda c, value: F.when(F.size(c) > 0, value)
    out = d.withColumns({
        "artist_mbid": F.col("mbid"), "artist_country": F.col("country"), "artist_region_city": F.col("region_city"), "window_years": F.lit(years),
        "releases_total": n.cast("long"), "releases_per_year": some("__days", F.try_divide(k, F.nullif(elapsed, F.lit(0.0)))), "avg_days_between_releases": F.try_divide(real(span), F.nullif(real(m), F.lit(0.0))),
        "release_velocity_releases_per_day": slope, "release_velocity_releases_per_year": slope * 365.25, "gap_median_days": _median("__gaps"),
        "gap_std_days": some("__gaps", F.sqrt(real(m) * real(total("__gaps", lambda g: g.cast("long") * g)) - real(span) * real(span)) / real(m)), "max_dry_spell_days": real(F.array_max("__gaps")),
        "front_loading_index": some("__days", real(F.size(F.filter("__days", lambda t: t < half))) / k),
        "collab_track_rate": F.when(F.col("tracks_total") > 0, S.ratio(F.col("__collab"), F.col("tracks_total"))), "unique_collaborator_count": F.col("__people"),
        "label_diversity_count": F.size("__labels_n").cast("long"), "label_churn": F.size(F.filter("__label", lambda l, i: l != F.get("__label", i - 1))).cast("long"),
        "label_hhi": some("__labels", share("__labels", lambda p: p * p)), "primary_label": _most_frequent("__labels_n"), "all_labels_str": some("__labels", S.ordered_set_text(F.array_distinct("__label"))),
        "duration_ms_mean": some("__lengths", real(total("__lengths")) / F.size("__lengths")), "duration_ms_median": _median("__lengths"), "duration_ms_min": F.get("__lengths", F.lit(0)), "duration_ms_max": F.get("__lengths", F.size("__lengths") - 1),
        "remix_rate": some("__length", real("__remixes") / tracks), "acoustic_rate": some("__length", real("__acoustics") / tracks),
        "genre_count": F.size("__genres_n").cast("long"), "genre_entropy": some("__genres", -share("__genres", lambda p: p * F.ln(p))), "primary_genre": _most_frequent("__genres_n"),
        "all_genres_str": some("__genres", F.concat_ws(", ", F.array_sort(F.transform("__genres_n", lambda g: F.lower(g["item"]))))),
        "years_active": F.datediff(now, a) / 365.25, "debut_year": F.year(a), "debut_decade": F.year(a) - F.year(a) % 10, "recency_index": F.exp(-0.1 * F.when(b.isNotNull(), F.greatest(F.lit(0), F.datediff(now, b))) / 30.44),
        "primary_role": F.coalesce(_most_frequent("__roles_n"), F.lit("unknown")), "all_roles_str": S.ordered_set_text(role),
    })
    return out.select(*EARLY_COLUMNS)
