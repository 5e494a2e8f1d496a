"""Answers of music platforms and encyclopaedias as tables.

http.fetch() or HttpSource brings (request, ordinal, body) rows, body being the
JSON text of one item; the functions here read such rows with declared schemas.
Nothing here opens a connection, so a stored snapshot of answers serves as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import keep_first, numbered, top_k
from kinweave.validate import cut, forget

PERSON = "struct<id: string, name: string>"
#: Bytes of numbers of credits that a round of credit_counts() sends; the number of rounds follows from their count.
ROUND_BYTES = 1 << 31


def _parsed(bodies: DataFrame, schema: str) -> DataFrame:
    return bodies.select("request", "ordinal", F.from_json("body", schema).alias("x"))


def first_hit(bodies: DataFrame, field: str = "id") -> DataFrame:
    """request, <field>: of each search the first hit's field; of hits at one place the shortest, then the smallest field."""
    hit = bodies.select("request", "ordinal", F.get_json_object("body", f"$.{field}").alias(field))
    place = F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", F.col(field).isNull(), F.length(field), field))
    return hit.groupBy("request").agg(F.min_by(field, place).alias(field))


def best_hit(bodies: DataFrame, least: int = 0) -> DataFrame:
    """request, id: the hit of highest score (the earliest of equal ones, then the shortest and smallest id), if it has at least `least`."""
    x = _parsed(bodies, "id string, score int").select("request", "ordinal", "x.*").where(F.col("score") >= least)
    place = F.struct(-F.col("score").cast("long"), F.col("ordinal").isNull(), "ordinal", F.col("id").isNull(), F.length("id"), "id")
    return x.groupBy("request").agg(F.min_by("id", place).alias("id"))


def metrics(bodies: DataFrame) -> DataFrame:
    """artist_id, followers (0 where there are none), popularity. Null items are dropped."""
    x = _parsed(bodies, "id string, followers struct<total: long>, popularity long").where("x.id is not null")
    return x.select(F.col("x.id").alias("artist_id"), F.coalesce("x.followers.total", F.lit(0).cast("long")).alias("followers"), F.col("x.popularity").alias("popularity"))


def albums(bodies: DataFrame) -> DataFrame:
    """request, id, name, release_date, kind: albums once each, the first met."""
    x = _parsed(bodies, "id string, name string, release_date string, album_type string").select("request", "ordinal", F.col("x.id").alias("id"), F.col("x.name").alias("name"), F.col("x.release_date").alias("release_date"), F.col("x.album_type").alias("kind"))
    return keep_first(x.where("id is not null"), ["id"], ["request", "ordinal"]).drop("ordinal")


def tracks(bodies: DataFrame) -> DataFrame:
    """album_id, position, track_id, title, length_ms, artist_ids, artist_names; position counts over pages from 1."""
    x = _parsed(bodies, f"id string, name string, duration_ms long, artists array<{PERSON}>").where("x.id is not null")
    return x.select(F.col("request").alias("album_id"), (F.col("ordinal") + 1).alias("position"), F.col("x.id").alias("track_id"), F.col("x.name").alias("title"), F.col("x.duration_ms").alias("length_ms"), F.col("x.artists.id").alias("artist_ids"), F.col("x.artists.name").alias("artist_names"))


def track_popularity(bodies: DataFrame) -> DataFrame:
    return _parsed(bodies, "id string, popularity long").where("x.id is not null").select(F.col("x.id").alias("id"), F.col("x.popularity").alias("popularity")).distinct()


def listener_stats(bodies: DataFrame) -> DataFrame:
    """request, listeners, playcount; an answer with an error has neither."""
    x = _parsed(bodies, "error int, message string, artist struct<stats: struct<listeners: string, playcount: string>>")
    ok = F.col("x.error").isNull()
    return x.select("request", *[F.when(ok, F.col(f"x.artist.stats.{c}").try_cast("long")).alias(c) for c in ("listeners", "playcount")])


def chart(bodies: DataFrame, target: int) -> DataFrame:
    """rank, name, mbid, listeners of the first `target` entries; rank counts over pages from 1, a blank mbid is null."""
    x = _parsed(bodies, "name string, mbid string, listeners string").where(F.col("ordinal") < target)
    return x.select((F.col("ordinal") + 1).alias("rank"), F.col("x.name").alias("name"), F.nullif(F.trim("x.mbid"), F.lit("")).alias("mbid"), F.col("x.listeners").try_cast("long").alias("listeners"))


def top_tracks(bodies: DataFrame, k: int = 15) -> DataFrame:
    """request, rank, name, playcount: the k most played tracks of each artist, ties by name."""
    x = _parsed(bodies, "name string, playcount string").select("request", F.col("x.name").alias("name"), F.col("x.playcount").try_cast("long").alias("playcount"))
    return top_k(x, ["request"], [F.col("playcount").desc_nulls_last(), F.col("name")], k).select("request", "rank", "name", "playcount")


def tracklists(bodies: DataFrame) -> DataFrame:
    """release_id, medium, position, recording_id, title, length_ms: releases with media and tracks, flattened; a track without a length has its recording's."""
    recording = "struct<id: string, title: string, length: long>"
    x = _parsed(bodies, f"id string, media array<struct<position: int, tracks: array<struct<position: int, title: string, length: long, recording: {recording}>>>>")
    t = x.select(F.col("x.id").alias("release_id"), F.explode("x.media").alias("m")).select("release_id", F.col("m.position").alias("medium"), F.explode("m.tracks").alias("t"))
    return t.select("release_id", "medium", F.col("t.position").alias("position"), F.col("t.recording.id").alias("recording_id"), F.coalesce("t.title", "t.recording.title").alias("title"), F.coalesce("t.length", "t.recording.length").alias("length_ms"))


def recording_works(bodies: DataFrame) -> DataFrame:
    """recording_id, work_id, work of each recording's relations to works."""
    x = _parsed(bodies, "id string, relations array<struct<type: string, work: struct<id: string, title: string>>>").select(F.col("x.id").alias("recording_id"), F.explode("x.relations").alias("r"))
    return x.where("r.work.id is not null").select("recording_id", F.col("r.work.id").alias("work_id"), F.col("r.work.title").alias("work")).repartition("recording_id").distinct()


def work_authors(bodies: DataFrame) -> DataFrame:
    """work_id, mbid, name, relation of each work's relations to artists, once each."""
    x = _parsed(bodies, "id string, relations array<struct<type: string, artist: struct<id: string, name: string>>>").select(F.col("x.id").alias("work_id"), F.explode("x.relations").alias("r"))
    return x.where("r.artist is not null").select("work_id", F.col("r.artist.id").alias("mbid"), F.col("r.artist.name").alias("name"), F.lower("r.type").alias("relation")).repartition("work_id").distinct()


def credit_counts(recorded: DataFrame, credited: DataFrame, rounds: int | None = None) -> DataFrame:
    """recording_id, works, authors, credits: of each recording's works that have authors, how many there are, of how many authors and of how many (author, relation).

    recorded: recording_id, work_id; credited: work_id, mbid, relation. Each
    recording needs all credits of its works, many times the input, so they are
    sent as numbers, one array a work, and to a part of the recordings at a time.
    There they are sorted and counted by _counted(), many recordings at once.
    """
    pairs = cut(recorded.where("recording_id is not null and work_id is not null").select("recording_id", "work_id").distinct())
    credit = cut(credited.where("work_id is not null").select("work_id", "mbid", "relation"))
    people = cut(numbered(credit.where("mbid is not null").select("mbid").distinct(), "mbid", "__person"))
    kinds = cut(numbered(credit.where("relation is not null").select("relation").distinct(), "relation", "__kind"))
    many = kinds.count() + 1  # 0 is no relation
    number = "int" if people.count() * many < 1 << 31 else "long"
    code = (F.col("__person") * many + F.coalesce(F.col("__kind") + 1, F.lit(0).cast("long"))).cast(number).alias("__code")
    coded = credit.join(people, "mbid", "left").join(kinds, "relation", "left").select("work_id", code).repartition("work_id")
    sets = cut(coded.groupBy("work_id").agg(F.array_distinct(F.collect_list("__code")).alias("__codes")))
    forget(credit, people, kinds)
    if rounds is None:
        n = pairs.groupBy("work_id").agg(F.count("*").alias("n")).join(sets.select("work_id", F.size("__codes").alias("m")), "work_id")
        bytes_ = 4 if number == "int" else 8
        rounds = -(-(n.agg(F.sum(F.col("n") * F.col("m")).alias("x")).first().x or 0) * bytes_ // ROUND_BYTES) or 1
    out = []
    for k in range(rounds):
        sent = pairs.where(F.pmod(F.xxhash64("recording_id"), F.lit(rounds)) == k).join(sets, "work_id").select("recording_id", "__codes")
        sent = sent.repartition("recording_id").sortWithinPartitions("recording_id")
        out.append(cut(sent.mapInArrow(lambda batches: _counted(batches, many), "recording_id string, works long, authors long, credits long")))
    forget(pairs, sets)
    return reduce(DataFrame.union, out)


def _counted(batches, many: int):
    """recording_id, works, authors, credits of rows (recording_id, numbers of a work's credits) that come sorted by recording_id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def firsts(ids):  # where another id begins
        return np.flatnonzero(np.concatenate(([True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))))

    def changed(x):
        out = np.ones(len(x), bool)
        out[1:] = x[1:] != x[:-1]
        return out

    def counted(rows):
        at, codes = firsts(rows.column(0)), rows.column(1)
        n, works = len(at), np.diff(np.append(at, len(rows)))
        owner = np.repeat(np.repeat(np.arange(n), works), np.diff(codes.offsets.to_numpy()))
        flat = codes.flatten().to_numpy().astype(np.int64)
        width = int(flat.max()) + 1 if len(flat) else 1
        if n * width < 1 << 63:
            flat = np.sort(owner * width + flat) - owner * width  # sorted by owner, who stay where they are, and number
        else:
            flat = flat[np.lexsort((flat, owner))]
        person, other = flat // many, changed(owner)
        authors = np.bincount(owner[other | changed(person)], minlength=n)
        credits = np.bincount(owner[(other | changed(flat)) & (flat != person * many)], minlength=n)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), *[pa.array(x.astype(np.int64)) for x in (works, authors, credits)]], ["recording_id", "works", "authors", "credits"])

    held = None
    for rows in batches:
        rows = rows if held is None else pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        last = firsts(rows.column(0))[-1] if len(rows) else 0
        if last:
            yield counted(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None and len(held):
        yield counted(held)
