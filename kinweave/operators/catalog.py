"""Normalised catalog tables -> nested entity documents, as one lazy plan.

Tables are passed as a dict of DataFrames. Every branch starts from the cohort,
so small cohorts prune the large link tables by join; wide arrays are built by
one aggregation each and joined on the entity. Optional tables choose branches
in Python. Ordering is explicit: arrays are sorted, dates sort nulls last.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.functions import scalars as S
from kinweave.validate import cut, forget, scratch, settings

# Relation names of authorship, and the narrower contributor list.
AUTHOR_ROLES = (
    "writer", "composer", "lyricist", "librettist", "scriptwriter", "translator", "producer", "singer", "vocal", "artist", "engineer",
    "arranger", "instrument arranger", "orchestrator", "vocal arranger", "adapter", "revised by", "reconstructed by",
)
CONTRIBUTOR_ROLES = ("composer", "lyricist", "writer", "librettist")


def distinct_sorted(c) -> F.Column:
    return F.array_sort(F.collect_set(c))


def cohort_of(ids: DataFrame, column: str = "mbid") -> DataFrame:
    """mbid, pos: valid ids normalised, the first position of each.

    The digits are exploded, as one, so that they are found once a row, and by the tasks that ids was dealt to: the
    filter would else move to the scan, which is one task where the ids are one file.
    """
    if "pos" not in ids.columns:
        ids = ids.withColumn("pos", F.monotonically_increasing_id())
    bare = ids.select(F.explode(F.array(S.bare_uuid(column))).alias("__bare"), "pos")
    return bare.select(S.hyphened("__bare").alias("mbid"), "pos").where("mbid is not null").groupBy("mbid").agg(F.min("pos").alias("pos"))


def entities(artist: DataFrame, cohort: DataFrame) -> DataFrame:
    return artist.where("gid is not null").join(cohort, F.lower(artist["gid"]) == cohort["mbid"]).select(F.col("id").alias("artist_id"), "mbid", F.col("name").alias("artist_name"), "area", "begin_area", "pos")


def roles(t: dict[str, DataFrame], inp: DataFrame) -> DataFrame:
    """artist_id, roles: author roles of works and any relation to recordings, sorted and distinct."""
    author = inp.select("artist_id").join(t["l_artist_work"], F.col("artist_id") == F.col("entity0")).join(t["link"].withColumnRenamed("id", "lid"), F.col("link") == F.col("lid")).join(t["link_type"].where(F.col("name").isin(*AUTHOR_ROLES)).select(F.col("id").alias("tid"), "name"), F.col("link_type") == F.col("tid")).select("artist_id", "name")
    played = inp.select("artist_id").join(t["l_artist_recording"], F.col("artist_id") == F.col("entity0")).join(t["link"].withColumnRenamed("id", "lid"), F.col("link") == F.col("lid")).join(t["link_type"].select(F.col("id").alias("tid"), "name"), F.col("link_type") == F.col("tid"), "left").select("artist_id", F.coalesce("name", F.lit("performer")).alias("name"))
    return author.union(played).groupBy("artist_id").agg(F.concat_ws(", ", distinct_sorted("name")).alias("roles"))


def work_pairs(t: dict[str, DataFrame], inp: DataFrame) -> DataFrame:
    """inp's columns, artist_id among them, and work_id: ids of works written or performed, once each.

    inp is joined after both kinds are put together, so their rows are shuffled by artist once, and not at all those a small cohort leaves out.
    """
    link = t["link"].select(F.col("id").alias("lid"), "link_type")
    kinds = t["link_type"].where(F.col("name").isin(*AUTHOR_ROLES)).select(F.col("id").alias("link_type"))
    written = t["l_artist_work"].join(link, F.col("link") == F.col("lid")).join(kinds, "link_type").select(F.col("entity0").alias("artist_id"), F.col("entity1").alias("work_id"))
    credit = t["artist_credit_name"].select(F.col("artist").alias("artist_id"), "artist_credit").join(t["artist_credit"].select(F.col("id").alias("artist_credit")), "artist_credit")
    recorded = inp.select("artist_id").join(credit, "artist_id").join(t["recording"].select(F.col("id").alias("rec"), "artist_credit"), "artist_credit").join(t["l_recording_work"].select(F.col("entity0").alias("rec"), F.col("entity1").alias("work_id")), "rec")
    return written.union(recorded.select("artist_id", "work_id")).join(inp, "artist_id").select(*inp.columns, "work_id").distinct()


def workset(t: dict[str, DataFrame], inp: DataFrame) -> DataFrame:
    """artist_id, work_id, work_name: works written or performed, once each, with the smallest name."""
    names = t["work"].where("id is not null").groupBy(F.col("id").alias("work_id")).agg(F.min("name").alias("work_name"))
    return work_pairs(t, inp.select("artist_id")).join(names, "work_id").select("artist_id", "work_id", "work_name")


def earliest_event(events: DataFrame, key: str = "release") -> DataFrame:
    """key, date: each release's first event by year, month, day, nulls last, as a date (null without a year)."""
    order = F.struct(*[x for c in ("date_year", "date_month", "date_day") for x in (F.col(c).isNull(), F.col(c))])
    first = events.groupBy(key).agg(F.min_by(F.struct("date_year", "date_month", "date_day"), order).alias("e"))
    return first.select(key, F.when(F.col("e.date_year").isNotNull(), S.partial_date(F.col("e.date_year"), F.col("e.date_month"), F.col("e.date_day"))).alias("date"))


def listings(t: dict[str, DataFrame]) -> DataFrame:
    """work_id, rec_id, rec_name, length_ms, release_id: each recording of a work on each of its releases, once. Made before artists are joined, as a work's recordings are the same for all of them."""
    medium = t["medium"].select(F.col("id").alias("medium"), F.col("release").alias("release_id")).join(t["release"].select(F.col("id").alias("release_id")), "release_id", "left_semi")
    placed = t["track"].select(F.col("recording").alias("rec_id"), "medium").join(medium, "medium").select("rec_id", "release_id")
    rec = t["recording"].select(F.col("id").alias("rec_id"), F.col("name").alias("rec_name"), F.col("length").alias("length_ms"))
    x = t["l_recording_work"].select(F.col("entity1").alias("work_id"), F.col("entity0").alias("rec_id")).join(rec, "rec_id").join(placed, "rec_id")
    return x.where("work_id is not null").select("work_id", "rec_id", "rec_name", "length_ms", "release_id").distinct()


def release_facts(t: dict[str, DataFrame]) -> DataFrame:
    """release_id, title, date, release_group_id, label_ids, label_names: greatest title and group, sorted distinct labels without nulls."""
    r = t["release"].groupBy(F.col("id").alias("release_id")).agg(F.max("name").alias("title"), F.max("release_group").alias("release_group_id"))
    label = t["release_label"].select(F.col("release").alias("release_id"), "label").join(t["label"].select(F.col("id").alias("label"), F.col("gid").alias("label_id"), F.col("name").alias("label_name")), "label", "left")
    label = label.groupBy("release_id").agg(distinct_sorted("label_id").alias("label_ids"), distinct_sorted("label_name").alias("label_names"))
    none = F.array().cast("array<string>")
    x = r.join(earliest_event(t["release_event"]).withColumnRenamed("release", "release_id"), "release_id", "left").join(label, "release_id", "left")
    return x.select("release_id", "title", "date", "release_group_id", *[F.coalesce(c, none).alias(c) for c in ("label_ids", "label_names")])


def packed(c: str) -> F.Column:
    """The 16 bytes of an id, which shuffles better than its 36 characters."""
    return F.unhex(F.replace(F.col(c), F.lit("-"), F.lit("")))


def unpacked(c: str) -> F.Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def owned(t: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """artist_id, id16 (mbid packed), work_id: the cohort's works, named or not, kept in a table."""
    inp = cut(entities(t["artist"], cohort_of(ids)).select("artist_id", packed("mbid").alias("id16")).distinct())
    out = cut(work_pairs(t, inp), "zstd")
    forget(inp)
    return out


def listed(t: dict[str, DataFrame]) -> DataFrame:
    """listings() of named works, kept in a table. Other works are left out of the links, which shuffle better than what listings() has of them."""
    links = t["l_recording_work"].join(t["work"].select(F.col("id").alias("entity1")), "entity1", "left_semi")
    return cut(listings(t | {"l_recording_work": links}), "zstd")


def recording_rows(owned_: DataFrame, listed_: DataFrame) -> DataFrame:
    """mbid, rec_id, name, length_ms, work_id, release_id: the recordings of documents() one a row, with no array and no shuffle of such rows. A work's artists, two columns, are what the join holds for each of its recordings."""
    return listed_.join(owned_.select(unpacked("id16").alias("mbid"), "work_id"), "work_id").select("mbid", "rec_id", F.col("rec_name").alias("name"), "length_ms", "work_id", "release_id")


def entity_counts(cohort: DataFrame, described_: DataFrame, owned_: DataFrame, listed_: DataFrame, work: DataFrame, rounds: int | None = None) -> DataFrame:
    """nested_counts() of documents(), which are not built: the columns of described(), pos, n_works, n_recordings, n_releases, total_length.

    Works, recordings and releases are counted by work, then added up; what
    repeats() finds, the releases that two works of an artist share, is taken off.
    """
    zero = F.lit(0).cast("long")
    on = cut(listed_.select("work_id", "release_id").repartition("work_id").distinct(), "zstd")
    by_work = listed_.groupBy("work_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("length_ms").cast("double"), F.lit(0.0))).alias("length"))
    by_work = by_work.join(on.groupBy("work_id").agg(F.count("*").alias("m")), "work_id")
    named = work.where("id is not null").select(F.col("id").alias("work_id")).distinct().join(by_work, "work_id", "left")
    counts = owned_.join(named, "work_id").groupBy("artist_id", "id16").agg(F.count("*").alias("n_works"), F.sum(F.coalesce("n", zero)).alias("n_recordings"), F.sum(F.coalesce("m", zero)).alias("__m"), F.sum(F.coalesce("length", F.lit(0.0))).alias("total_length"))
    again = repeats(owned_, on, rounds).groupBy("artist_id").agg(F.count("*").alias("__again"))
    counts = cut(counts.join(again, "artist_id", "left").withColumn("n_releases", F.col("__m") - F.coalesce("__again", zero)).withColumn("mbid", unpacked("id16")).drop("id16", "__m", "__again"))
    forget(on)
    docs = described_.join(counts, ["artist_id", "mbid"], "left").drop("artist_id", "pos")
    n = [F.coalesce(c, zero).alias(c) for c in ("n_works", "n_recordings", "n_releases")]
    return cohort.join(docs, "mbid", "left").select("mbid", *[c for c in docs.columns if c not in ("mbid", *counts.columns)], "pos", *n, F.coalesce("total_length", F.lit(0.0)).alias("total_length")).orderBy("pos")


def dated_works(t: dict[str, DataFrame]) -> DataFrame:
    """work, people (the collaborators' mbids, distinct): works with a first release date of their own or a dated release, one row each, kept in a table."""
    day = lambda c: S.loose_date(F.date_format(c, "yyyy-MM-dd"))
    found = listings(t).select(F.col("work_id").alias("work"), "release_id").join(earliest_event(t["release_event"]).where("date is not null").select(F.col("release").alias("release_id")), "release_id")
    w = t["work"].where("id is not null").select(F.col("id").alias("work")).distinct().join(found.select("work").distinct().withColumn("found", F.lit(True)), "work", "left")
    if "work_first_release_date" in t:
        w = w.join(t["work_first_release_date"].select(F.col("work_id").alias("work"), day("first_date").alias("own")), "work", "left")
    else:
        w = w.withColumn("own", F.lit(None).cast("date"))
    people = "array<struct<mbid: string, role: string>>"
    if "work_contrib_roles" in t:
        w = w.join(t["work_contrib_roles"].select(F.col("work_id").alias("work"), F.from_json("collaborators", people)["mbid"].alias("people")), "work", "left")
    else:
        w = w.withColumn("people", F.lit(None).cast("array<string>"))
    w = w.where("found or own is not null")
    return cut(w.groupBy("work").agg(F.array_distinct(F.flatten(F.collect_list("people"))).alias("people")), "zstd")


def release_rows(facts: DataFrame, owned_: DataFrame, listed_: DataFrame, rounds: int | None = None) -> DataFrame:
    """mbid, release_id, title, date, release_group_id, label_ids, label_names: the releases of documents() one a row.

    A release comes with the smallest work by which an artist has it. The other
    works by which they have it too are few: repeats() finds these, and they are
    left out of the last join, after which rows of artist and release, many times
    the input, are not shuffled any more. Texts are made before it, too, as each
    is in many rows. Deletes listed_.
    """
    on = cut(listed_.select("work_id", "release_id").repartition("work_id").distinct(), "zstd")
    forget(listed_)
    again = repeats(owned_, on, rounds)
    dated = facts.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    with_facts = cut(on.join(dated, "release_id"), "zstd")
    forget(on)
    left_out = again.select("work_id", "artist_id", F.lit(None).cast("binary").alias("id16"), "release_id")
    both = owned_.select("work_id", "artist_id", "id16", F.lit(None).cast(left_out.schema["release_id"].dataType).alias("release_id")).union(left_out)
    who = both.repartition("work_id").groupBy("work_id", "artist_id").agg(F.collect_list("id16").alias("ids"), F.collect_set("release_id").alias("__out"))
    who = who.select("work_id", F.explode("ids").alias("id16"), "__out").select("work_id", unpacked("id16").alias("mbid"), "__out")
    x = who.join(with_facts, "work_id").where((F.size("__out") == 0) | ~F.array_contains("__out", F.col("release_id")))
    return x.select("mbid", "release_id", "title", "date", "release_group_id", "label_ids", "label_names")


def repeats(owned_: DataFrame, on: DataFrame, rounds: int | None = None) -> DataFrame:
    """artist_id, work_id, release_id: the works, beyond the smallest, by which an artist has a release, kept in a table. on: work_id, release_id, once each.

    A release's artists are gathered as arrays of numbers, a part of the releases
    at a time, and sorted: whoever is next to themself has it by several works.
    Only for these are rows of artist, work and release made. Artists are dealt to
    blocks where a release has more rows than a task should hold.
    """
    own = owned_.select("artist_id", "work_id")
    artists, works = (x.groupBy(c).agg(F.count("*").alias("n")) for x, c in ((own, "work_id"), (on, "release_id")))
    total, widest = artists.join(on.groupBy("work_id").agg(F.count("*").alias("m")), "work_id").agg(F.sum(F.col("n") * F.col("m")), F.max("n")).first()
    most = (widest or 0) * (works.agg(F.max("n")).first()[0] or 0)
    if most > TASK_ROWS:  # the bound may be far above any release
        most = on.join(artists, "work_id").groupBy("release_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    rounds, blocks = rounds or -(-(total or 0) // ROUND_ROWS) or 1, -(-(most or 0) // TASK_ROWS) or 1
    block = F.pmod(F.xxhash64("artist_id"), F.lit(blocks)).alias("__block")
    by_work = cut(own.repartition("work_id").groupBy("work_id", block).agg(F.collect_list("artist_id").alias("__artists")), "zstd")
    twice = F.array_distinct(F.filter("__all", lambda x, i: x == F.get("__all", i + 1)))
    nth = F.dense_rank().over(W.partitionBy("artist_id", "release_id").orderBy("work_id"))
    out = []
    for k in range(rounds):
        some = on.where(F.pmod(F.xxhash64("release_id"), F.lit(rounds)) == k) if rounds > 1 else on
        gathered = some.join(by_work, "work_id").select("release_id", "__block", "__artists").repartition("release_id", "__block")
        gathered = gathered.groupBy("release_id", "__block").agg(F.sort_array(F.flatten(F.collect_list("__artists"))).alias("__all"))
        found = gathered.select("release_id", F.explode(twice).alias("artist_id")).join(some, "release_id").join(own, ["artist_id", "work_id"], "left_semi")
        out.append(cut(found.withColumn("__nth", nth).where("__nth > 1").select("artist_id", "work_id", "release_id"), "zstd"))
    forget(by_work)
    return reduce(DataFrame.union, out)


def flat_releases(raw: DataFrame) -> DataFrame:
    """One row per artist and release: greatest title, earliest date, greatest group, sorted distinct labels without nulls."""
    return raw.groupBy("artist_id", "release_id").agg(F.max("title").alias("title"), F.min("date").alias("date"), F.max("release_group_id").alias("release_group_id"), distinct_sorted("label_id").alias("label_ids"), distinct_sorted("label_name").alias("label_names"))


def genres(t: dict[str, DataFrame]) -> DataFrame | None:
    """work_id, genres by the genre tables, or else the tag tables, or else none. They are the work's, whoever's it is."""
    for link, table, column in (("work_genre", "genre", "genre"), ("work_tag", "tag", "tag")):
        if link in t and table in t:
            named = t[link].select(F.col("work").alias("work_id"), column).join(t[table].select(F.col("id").alias(column), "name"), column)
            return named.groupBy("work_id").agg(distinct_sorted("name").alias("genres"))
    return None


PEOPLE = "array<struct<mbid: string, role: string>>"


def work_facts(t: dict[str, DataFrame]) -> DataFrame:
    """work_id, name (the smallest), first_release_date, genres, collaborators of the works with an id; a row for each date and list of collaborators given."""
    w = t["work"].where("id is not null").groupBy(F.col("id").alias("work_id")).agg(F.min("name").alias("name"))
    g, nothing = genres(t), lambda kind: F.lit(None).cast(kind)
    w = w.join(g, "work_id", "left") if g is not None else w.withColumn("genres", nothing("array<string>"))
    if "work_first_release_date" in t:
        w = w.join(t["work_first_release_date"].select("work_id", F.date_format("first_date", "yyyy-MM-dd").alias("first_release_date")), "work_id", "left")
    else:
        w = w.withColumn("first_release_date", nothing("string"))
    if "work_contrib_roles" in t:
        w = w.join(t["work_contrib_roles"].select("work_id", F.from_json("collaborators", PEOPLE).alias("collaborators")), "work_id", "left")
    else:
        w = w.withColumn("collaborators", nothing(PEOPLE))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return w.select("work_id", "name", "first_release_date", empty("genres", "array<string>"), empty("collaborators", PEOPLE))


def work_rows(t: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """mbid, work_id, name, first_release_date, genres, collaborators: the works of documents() one a row. Pairs of ids are all that is shuffled for each artist."""
    inp = entities(t["artist"], cohort_of(ids)).select("artist_id", packed("mbid").alias("id16")).distinct()
    pairs = work_pairs(t, inp).select("id16", "work_id")
    return pairs.join(work_facts(t), "work_id").select(unpacked("id16").alias("mbid"), "work_id", "name", "first_release_date", "genres", "collaborators")


def described(t: dict[str, DataFrame], inp: DataFrame) -> DataFrame:
    """artist_id, mbid, artist_name, pos, country, region_city, roles."""
    area = t["area"].select(F.col("id").alias("aid"), F.col("name").alias("aname"))
    places = inp.join(area, F.col("area") == F.col("aid"), "left").withColumnRenamed("aname", "country").drop("aid").join(area, F.col("begin_area") == F.col("aid"), "left").withColumnRenamed("aname", "region_city").drop("aid", "area", "begin_area")
    return places.join(roles(t, inp), "artist_id", "left")


def by_work(t: dict[str, DataFrame], on: DataFrame | None, facts: DataFrame | None, arrays: tuple[str, ...], made: dict[str, Callable[[F.Column], F.Column]] | None = None) -> DataFrame:
    """work_id and the arrays asked for: what each named work adds to its artists' arrays, put together once and not for each of them. on: listings(); facts: release_facts().

    made: what is made of an array's elements, by array; once here, as an element goes to many artists. Then the arrays
    hold structs of what orders the elements, id first, and of what was made of them.
    """
    made = made or {}
    w = work_facts(t).select("work_id", F.struct(F.col("work_id").alias("id"), "name", "first_release_date", "genres", "collaborators").alias("__w"))
    out = w.groupBy("work_id").agg(F.collect_list("__w").alias("works"))
    if "works" in made:
        out = out.withColumn("works", F.transform(F.sort_array("works"), lambda x, i: F.struct(x["id"].alias("id"), i.alias("i"), made["works"](x).alias("made"))))
    if "recordings" in arrays:
        rec, more = F.struct(F.col("rec_id").alias("id"), F.col("rec_name").alias("name"), "length_ms", "work_id", "release_id"), on
        if "recordings" in made:  # numbers in the order of all recordings stand for what orders them
            more = on.orderBy("rec_id", "rec_name", "length_ms", "work_id", "release_id").withColumn("__nth", F.monotonically_increasing_id())
            rec = F.struct(F.col("__nth").alias("id"), made["recordings"](rec).alias("made"))
        more = more.select("work_id", rec.alias("__c")).groupBy("work_id").agg(F.sort_array(F.collect_list("__c")).alias("recordings"))
        out = out.join(more, "work_id", "left")
    if "releases" in arrays:
        one = F.struct(F.col("release_id").alias("id"), "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "release_group_id", "label_ids", "label_names")
        if "releases" in made:
            one = F.struct(F.col("release_id").alias("id"), made["releases"](one).alias("made"))
        one = facts.select("release_id", one.alias("__r"))
        out = out.join(on.select("work_id", "release_id").distinct().join(one, "release_id").groupBy("work_id").agg(F.sort_array(F.collect_list("__r")).alias("releases")), "work_id", "left")
    return out.select("work_id", *arrays)


#: Artists that a row of a work's arrays is read for, on average; a work's artists beyond are dealt to more such rows.
OWNERS = 1 << 10


def with_owners(pairs: DataFrame, works: DataFrame) -> DataFrame:
    """works (a row for each work_id) and __owners, the ids of its artists. pairs: artist_id, work_id, once each.

    Rows of an artist and a work are made of these by reading alone, for whichever artists, so that no round joins them again.
    """
    many = pairs.groupBy("work_id").agg(F.count("*").alias("__n")).where(F.col("__n") > OWNERS)
    block = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("artist_id"), F.ceil(F.col("__n") / OWNERS))).alias("__block")
    owners = pairs.join(many, "work_id", "left").groupBy("work_id", block).agg(F.collect_list("artist_id").alias("__owners"))
    return owners.join(works, "work_id").drop("work_id", "__block")


def nested(who: DataFrame, sent: DataFrame, arrays: tuple[str, ...], made: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """The columns of who (mbid, artist_id and more, a row for each document) and the arrays asked for, of those that have an artist_id.

    sent: artist_id and the arrays of by_work(), a row for each artist and work; such rows are shuffled once for all
    arrays. Arrays are sorted by sort_array(), whose comparisons are compiled; a release that several works bring is next to itself then.
    """
    whole = gathered(who, sent, {c: F.sort_array(F.flatten(F.collect_list(c))) for c in arrays}, tasks)
    once = lambda x, i: (i == 0) | (F.get("releases", i - 1)["id"] != x["id"])
    whole = whole.withColumn("releases", F.filter("releases", once)) if "releases" in arrays else whole
    return whole.withColumns({c: F.col(c)["made"] for c in made}) if made else whole


def gathered(who: DataFrame, sent: DataFrame, parts: dict[str, F.Column], tasks: int | None = None) -> DataFrame:
    """The columns of who, of rows with an artist_id, and parts: aggregates of the artist's rows of sent (artist_id and more)."""
    rows = who.where("artist_id is not null").select("artist_id", F.struct(*who.columns).alias("__who")).unionByName(sent, allowMissingColumns=True)
    rows = rows.repartition(tasks, "artist_id") if tasks else rows.repartition("artist_id")
    whole = rows.groupBy("artist_id").agg(F.collect_list("__who").alias("__who"), *[x.alias(c) for c, x in parts.items()])
    return whole.select(F.explode("__who").alias("__who"), *parts).select("__who.*", *parts)


ARRAYS = ("works", "recordings", "releases")


def documents(t: dict[str, DataFrame], ids: DataFrame, arrays: tuple[str, ...] = ARRAYS, ordered: bool = True) -> DataFrame:
    """Nested documents in cohort order (pos), or in none, which saves a sort; ids without an entity as placeholders with empty arrays. Only the arrays asked for are built.

    One plan: rows of artist and recording, many times the input, are all on disk at once. written_documents() bounds that.
    """
    cohort = cohort_of(ids)
    who, pairs = _asked(t, cohort)
    wide = set(arrays) & {"recordings", "releases"}
    works = by_work(t, listings(t) if wide else None, release_facts(t) if "releases" in arrays else None, arrays)
    docs = nested(who, pairs.join(works, "work_id").drop("work_id"), arrays).unionByName(who.where("artist_id is null"), allowMissingColumns=True)
    out = _in_order(docs, arrays)
    return out.orderBy("pos") if ordered else out


def _asked(t: dict[str, DataFrame], cohort: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cohort with what describes it (nothing for placeholders), and its pairs of artist and work."""
    inp = entities(t["artist"], cohort)
    who = cohort.join(described(t, inp).drop("pos"), "mbid", "left")
    return who, work_pairs(t, inp.select("artist_id"))


def _in_order(docs: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    return _filled(docs).select("mbid", *[c for c in docs.columns if c not in ("mbid", "artist_id", "pos", *arrays)], *arrays, "pos")


#: Rows of artist and recording that a round makes, where they are counted, and where they are nested; the number of rounds follows from their count.
ROUND_ROWS, NESTED_ROWS = 1 << 28, 1 << 24
#: Rows of artist and recording that a round nests for each recording of a work, at least. A round reads all works' arrays, so rounds must not grow with the input.
NESTED_EACH = 1
#: Rows of artist and recording that one task nests, on average, at most.
TASK_ROWS = 1 << 20


def pair_rows(owners: DataFrame, listed_: DataFrame) -> int:
    """The number of (owner, listing) rows, counted by work and not made."""
    n, m = owners.groupBy("work_id").agg(F.count("*").alias("__n")), listed_.groupBy("work_id").agg(F.count("*").alias("__m"))
    return n.join(m, "work_id").agg(F.sum(F.col("__n") * F.col("__m")).alias("x")).first().x or 0


def rounds_for(owners: DataFrame, listed_: DataFrame, rows: int | None = None) -> int:
    """Rounds in which (owner, listing) rows are at most ROUND_ROWS each on average."""
    return -(-pair_rows(owners, listed_) // (rows or ROUND_ROWS)) or 1


def written_documents(t: dict[str, DataFrame], ids: DataFrame, arrays: tuple[str, ...] = ARRAYS, rows: int | None = None, kept: Callable[[DataFrame], DataFrame] | None = None, again: bool = False, made: dict[str, Callable[[F.Column], F.Column]] | None = None) -> DataFrame:
    """documents() as a written table, in no order, or what `kept` makes of them, document by document: then no document is written.

    A part of the artists at a time, drawn by hash: as many rounds as their (artist, recording) rows, counted before they are
    made, need. Each round's shuffle files go before the next, and what all rounds share (works with their arrays and artists) is written once.
    again: kept reads the documents several times; a round's are then written once, and go with the round.
    made: functions of an element, by array, whose values the arrays hold instead of the elements, in the elements' order.
    """
    who, pairs, on = _shared(t, ids, bool(set(arrays) & {"recordings", "releases"}))
    works = by_work(t, on, release_facts(t) if "releases" in arrays else None, arrays, made)

    def of_round(who: DataFrame, sent: DataFrame, tasks: int) -> DataFrame:
        docs = nested(who, sent, arrays, tuple(made or ()), tasks)
        return _in_order(docs.unionByName(who.where("artist_id is null"), allowMissingColumns=True), arrays)

    return _in_rounds(who, pairs, on, works, of_round, rows, kept, again)


def written_parts(t: dict[str, DataFrame], ids: DataFrame, of_works: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """What `kept` makes of the cohort's rows and the array `parts`, as a written table, in no order: the columns that of_works() makes beside work_id, for each work of the artist.

    of_works(work_facts(), listings(), release_facts()) makes one row for each work. Rounds are those of written_documents().
    """
    who, pairs, on = _shared(t, ids, True)
    works = of_works(work_facts(t), on, release_facts(t))
    columns = [c for c in works.columns if c != "work_id"]

    def of_round(who: DataFrame, sent: DataFrame, tasks: int) -> DataFrame:
        docs = gathered(who, sent.select("artist_id", F.struct(*columns).alias("parts")), {"parts": F.collect_list("parts")}, tasks)
        return _filled(docs.unionByName(who.where("artist_id is null"), allowMissingColumns=True))

    return _in_rounds(who, pairs, on, works, of_round, rows, kept)


def _shared(t: dict[str, DataFrame], ids: DataFrame, wide: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Tables of the cohort with what describes it, of its pairs of artist and work, and, if wide, of listings()."""
    cohort = cut(cohort_of(ids))
    who, pairs = _asked(t, cohort)
    who, pairs = cut(who, "zstd"), cut(pairs, "zstd")
    forget(cohort)
    return who, pairs, listed(t) if wide else None


def _in_rounds(who: DataFrame, pairs: DataFrame, on: DataFrame | None, works: DataFrame, of_round: Callable[[DataFrame, DataFrame, int], DataFrame], rows: int | None, kept: Callable[[DataFrame], DataFrame] | None, again: bool = False) -> DataFrame:
    """of_round(who, rows of artist and work, tasks) for a part of the artists at a time, and what kept makes of it, in a table. Deletes who, pairs and on."""
    spark = who.sparkSession
    sent = cut(with_owners(pairs, works), "zstd")
    total, each = (pair_rows(pairs, on), on.count()) if on is not None else (pairs.count(),) * 2
    forget(pairs, *([] if on is None else [on]))
    n = -(-total // (rows or max(NESTED_ROWS, NESTED_EACH * each))) or 1
    tasks = max(-(-total // (n * TASK_ROWS)), 3 * spark.sparkContext.defaultParallelism)
    path = scratch(spark, "documents")
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        for k in range(n):
            own = lambda c: F.pmod(F.xxhash64(c), F.lit(n)) == k  # noqa: E731, B023
            some = sent.withColumn("__owners", F.filter("__owners", own)) if n > 1 else sent
            one = some.select(F.explode("__owners").alias("artist_id"), *[c for c in sent.columns if c != "__owners"])
            docs = of_round(who.where(own(F.col("artist_id"))) if n > 1 else who, one, tasks)
            held = cut(docs, "zstd") if again else docs
            out = held if kept is None else kept(held)
            out.write.mode("append").option("compression", "zstd").parquet(path)
            if again:
                forget(held)
    forget(who, sent)
    return spark.read.schema(out.schema).parquet(path)


def _filled(docs: DataFrame) -> DataFrame:
    """Empty arrays for those that are missing."""
    return docs.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in docs.schema if f.dataType.typeName() == "array"})


def placeholders(cohort: DataFrame, docs: DataFrame) -> DataFrame:
    """Every cohort id in order, with empty arrays where there is no document."""
    out = _filled(cohort.join(docs, "mbid", "left"))
    return out.select("mbid", *[c for c in docs.columns if c != "mbid"], "pos").orderBy("pos")


def resources(t: dict[str, DataFrame], ids: DataFrame, include_empty: bool = False) -> DataFrame:
    """mbid, resources: array of (type, url, begin_year, end_year) per entity, sorted."""
    inp = entities(t["artist"], cohort_of(ids)).select("artist_id", "mbid")
    link = t["link"].select(F.col("id").alias("link"), "link_type", F.col("begin_date_year").alias("begin_year"), F.col("end_date_year").alias("end_year"))
    urls = t["l_artist_url"].select(F.col("entity0").alias("artist_id"), "link", F.col("entity1").alias("uid")).join(link, "link").join(t["link_type"].select(F.col("id").alias("link_type"), F.col("name").alias("type")), "link_type", "left").join(t["url"].select(F.col("id").alias("uid"), "url"), "uid")
    got = inp.join(urls, "artist_id", "left").groupBy("mbid").agg(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("type", "url", "begin_year", "end_year")))).alias("resources"))
    return got if include_empty else got.where(F.size("resources") > 0)


def url_map(resources_: DataFrame, word: str = "spotify") -> DataFrame:
    """mbid, url: the last url that has the word, in any case."""
    r = resources_.select("mbid", F.posexplode("resources").alias("i", "r")).where(F.lower("r.url").contains(word))
    return r.groupBy("mbid").agg(F.max_by("r.url", "i").alias("url"))


def grouped_tracks(tracks: DataFrame) -> DataFrame:
    """Catalog-less tracks (owner, title, album_date, artist_ids, artist_names) as works of each owner: grouped by lower title and the set of artists, earliest date, collaborators by name, numbered from 1."""
    key = tracks.withColumn("k_title", S.clean("title")).withColumn("k_artists", F.array_sort(F.array_distinct("artist_ids")))
    people = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("artist_ids").alias("id"), F.col("artist_names").alias("name")))))
    g = key.groupBy("owner", "k_title", "k_artists").agg(F.min("album_date").alias("first_release_date"), F.min("title").alias("name"), people.alias("people"))
    by_name = F.transform(F.array_sort(F.transform("people", lambda p: F.struct(F.lower(p["name"]).alias("k"), p["id"].alias("id"), p["name"].alias("name")))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    return g.withColumn("collaborators", by_name).withColumn("id", F.row_number().over(W.partitionBy("owner").orderBy("k_title", "k_artists")).cast("long")).drop("people", "k_title", "k_artists")


def platform_documents(artists: DataFrame, tracks: DataFrame, arrays: tuple[str, ...] = ARRAYS) -> DataFrame:
    """Nested documents from a platform's tables, in the shape of documents(): mbid (the platform's id), artist_name, roles, works, recordings, releases, in no order. Only the arrays asked for are built.

    artists: id, name, genres; tracks: owner, track_id, title, album_id, album,
    album_date, length_ms, label, artist_ids, artist_names. Every work has its
    artist's genres, as the platform knows none of its own.
    """
    works = grouped_tracks(tracks).join(artists.select(F.col("id").alias("owner"), "genres"), "owner", "left")
    people = F.transform("collaborators", lambda c: F.struct(c["id"].alias("mbid"), F.lit("performer").alias("role")))
    genres = F.array_sort(F.array_distinct(F.coalesce("genres", F.array().cast("array<string>"))))
    w = works.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("id", "name", F.col("first_release_date").cast("string").alias("first_release_date"), genres.alias("genres"), people.alias("collaborators")))).alias("works"))
    r = tracks.select("owner", F.col("track_id").alias("id"), F.col("title").alias("name"), "length_ms", F.col("album_id").alias("release_id")).distinct().groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("id", "name", "length_ms", "release_id"))).alias("recordings"))
    a = tracks.groupBy("owner", "album_id").agg(F.min("album").alias("title"), F.min("album_date").cast("string").alias("date"), distinct_sorted("label").alias("label_names")).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct(F.col("album_id").alias("id"), "title", "date", "label_names"))).alias("releases"))
    docs = artists.select(F.col("id").alias("mbid")).distinct()
    for name, part in (("works", w), ("recordings", r), ("releases", a)):
        if name in arrays:
            docs = docs.join(part.withColumnRenamed("owner", "mbid"), "mbid", "left")
    base = artists.select(F.col("id").alias("mbid"), F.col("name").alias("artist_name"), F.lit("performer").alias("roles"))
    return _filled(base.join(docs, "mbid", "left"))


def resource_groups(pages: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """group, n, first_page (smallest key), largest_page (key of the greatest size, the greatest key of several)."""
    return pages.groupBy(group).agg(F.count("*").alias("n"), F.min(key).alias("first_page"), F.max_by(key, F.struct(size, key)).alias("largest_page"))


def nested_counts(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """mbid, the carried columns, n_works, n_recordings, n_releases, total_length of nested documents."""
    length = F.aggregate(F.transform("recordings", lambda r: F.coalesce(r["length_ms"].cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return docs.select("mbid", *carry, *[F.size(c).cast("long").alias(f"n_{c}") for c in ("works", "recordings", "releases")], length.alias("total_length"))


def merge_works(written: DataFrame, played: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The union of two work lists, each work once, with the smallest of its names."""
    both = written.select(*keys, name).unionByName(played.select(*keys, name))
    return both.groupBy(*keys).agg(F.min(name).alias(name))


def lookup_by_id(facts: DataFrame, mbid: str) -> DataFrame:
    """The item (one row, the smallest) of (item, property, value) facts whose P434 value is a well-formed id."""
    if not re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", mbid):
        return facts.select("item").limit(0)
    return facts.where((F.col("property") == "P434") & (F.col("value") == mbid)).select("item").orderBy("item").limit(1)


# Properties that name relatives, with their rank, and of occupations, classes and ids.
RELATIVE_PROPERTIES = {"P22": ("father", 5), "P25": ("mother", 5), "P3373": ("sibling", 4), "P26": ("spouse", 3), "P40": ("child", 2), "P1038": ("relative", 1)}
OCCUPATION, SUBCLASS, CATALOG_ID = "P106", "P279", "P434"


def musical_relatives(facts: DataFrame, names: DataFrame, item: str, occupations: list[str], language: str = "en") -> DataFrame:
    """Relatives of an item whose occupation is one of the given ones or below them, as relatives().

    facts: item, property, value; names: item, language, name. A relative names
    the item or the item names them; a name in another language, or none, leaves
    the item's own id as its name.
    """
    relation = F.create_map(*[F.lit(x) for k, (name, _) in RELATIVE_PROPERTIES.items() for x in (k, name)])
    rank = F.create_map(*[F.lit(x) for k, (_, r) in RELATIVE_PROPERTIES.items() for x in (k, r)])
    links = facts.where(F.col("property").isin(*RELATIVE_PROPERTIES))
    there = links.where(F.col("item") == item).select(F.col("value").alias("qid"), "property")
    back = links.where(F.col("value") == item).select(F.col("item").alias("qid"), "property")
    near = there.union(back).select("qid", relation[F.col("property")].alias("relation"), rank[F.col("property")].alias("priority")).distinct()
    kinds = subclasses(facts.where(F.col("property") == SUBCLASS).select(F.col("item").alias("child"), F.col("value").alias("parent")), occupations)
    jobs = facts.where(F.col("property") == OCCUPATION).select(F.col("item").alias("qid"), F.col("value").alias("occupation")).join(kinds, F.col("occupation") == F.col("node"), "left_semi")
    ids = facts.where(F.col("property") == CATALOG_ID).select(F.col("item").alias("qid"), F.col("value").alias("mbid"))
    label = names.where(F.lower("language") == language.lower()).groupBy(F.col("item").alias("qid")).agg(F.min("name").alias("name"))
    return relatives(near.join(jobs, "qid").join(ids, "qid", "left").join(label, "qid", "left").withColumn("name", F.coalesce("name", "qid")))


def relatives(facts: DataFrame) -> DataFrame:
    """facts: qid, name, relation, priority, occupation, mbid. One row per relative: name, sorted occupations, the relation of highest priority, any mbid."""
    return facts.groupBy("qid").agg(F.min("name").alias("name"), distinct_sorted("occupation").alias("occupations"), F.max_by("relation", F.struct("priority", "relation")).alias("relation"), F.bool_or(F.col("mbid").isNotNull()).alias("has_mbid"), F.max("mbid").alias("mbid"))


def subclasses(pairs: DataFrame, roots: list[str], most: int = 50) -> DataFrame:
    """node: the roots and everything below them in (child, parent) pairs: a path of any length, cycles included."""
    from kinweave.validate import cut

    spark = pairs.sparkSession
    seen = front = spark.createDataFrame([(r,) for r in roots], "node string")
    for _ in range(most):
        front = cut(pairs.join(front, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))
    raise ValueError(f"the hierarchy is deeper than {most}")


def with_fallback(base: DataFrame, rich: DataFrame, key: str) -> DataFrame:
    """Columns of both by key; where both have a column the rich value, or else the base one."""
    r = rich.select(F.col(key), *[F.col(c).alias(f"__r_{c}") for c in rich.columns if c != key])
    j = base.join(r, key, "left")
    cols = [F.coalesce(F.col(f"__r_{c}"), F.col(c)).alias(c) if c != key and c in rich.columns else F.col(c) for c in base.columns]
    return j.select(*cols, *[F.col(f"__r_{c}").alias(c) for c in rich.columns if c not in base.columns])


def claim_value(kind: str | F.Column, value: F.Column) -> F.Column:
    """Text of a JSON claim value by its declared type."""
    k = F.col(kind) if isinstance(kind, str) else kind
    get = lambda p: F.get_json_object(value, p)
    return F.when(k == "wikibase-entityid", get("$.id")).when(k == "time", F.regexp_extract(get("$.time"), r"^[+]?(-?\d{4,}-\d{2}-\d{2})", 1)).when(k == "quantity", F.regexp_replace(get("$.amount"), r"^\+", "")).when(k == "monolingualtext", get("$.text")).when(k == "globecoordinate", F.concat_ws(",", get("$.latitude"), get("$.longitude"))).otherwise(value)
