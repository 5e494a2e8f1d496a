"""Building co-occurrence graphs: entities that share a work are linked.

Edges are (u, v, weight), u < v. A work with n participants gives n(n-1)/2
pairs; that product is what the graph is, so works are joined with themselves on
their key and pairs are counted with partial aggregation. Participants are made
distinct before the join; those of a popular work are dealt to blocks, so that
no task makes all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.validate import cut

#: Participants of a work that one task pairs with all others of it.
BLOCK = 1024
#: Rows of members, and of pairs, that one task holds on average.
TASK_ROWS = 1 << 20
#: People of a work whose pairs are made from one row.
PEOPLE = 64


def _pairs(m: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """m (keys, n and more) joined with itself: u < v, once a pair and key, with the further columns of u's row.

    A key's rows are dealt to blocks of u; every row is copied to each block as v.
    """
    large = m.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > BLOCK).select(*keys, F.ceil(F.col("__c") / BLOCK).alias("__blocks"))
    dealt = m.join(large, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1).cast("long")))
    a = dealt.withColumn("__block", F.pmod(F.xxhash64("n"), "__blocks")).drop("__blocks").withColumnRenamed("n", "u")
    b = dealt.select(*keys, F.col("n").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block"))
    if tasks:
        a, b = (x.repartition(tasks, *keys, "__block") for x in (a, b))
    return a.join(b, [*keys, "__block"]).where("u < v").drop("__block")


def _dealt_pairs(m: DataFrame, keys: list[str]) -> DataFrame:
    """_pairs() dealt by (u, v), by as many tasks as its counted rows need, so that no task's share grows with the input. m is written, as it is read several times."""
    m = cut(m)
    sizes = m.groupBy(*keys).agg(F.count("*").alias("__c"))
    rows, pairs = sizes.agg(F.sum("__c"), F.sum(F.col("__c") * (F.col("__c") - 1) / 2)).first()
    return _pairs(m, keys, _tasks(rows)).repartition(_tasks(pairs), "u", "v")


def _tasks(rows: float | None) -> int:
    return int((rows or 0) // TASK_ROWS) + 1


def pair_counts(members: DataFrame, key: str | list[str], node: str, weight: Column | None = None) -> DataFrame:
    """members: one row per (key, node). Edges weighted by the number of keys shared, or the sum of a column of the left row."""
    keys = [key] if isinstance(key, str) else key
    m = members.select(*keys, F.col(node).alias("n"), *([weight.alias("w")] if weight is not None else [])).where("n is not null").dropDuplicates([*keys, "n"])
    pairs = _dealt_pairs(m, keys)
    return pairs.groupBy("u", "v").agg((F.count("*") if weight is None else F.sum("w")).alias("weight"))


def cowork_edges(docs: DataFrame) -> DataFrame:
    """Edges of nested documents: per dated work of each document, all pairs of its owner and collaborators; a work in k documents counts k times."""
    releases = docs.select(F.col("mbid").alias("owner"), F.explode("releases").alias("r")).select("owner", F.col("r.id").alias("release_id"), S.loose_date("r.date").alias("rd"))
    recordings = docs.select(F.col("mbid").alias("owner"), F.explode("recordings").alias("c")).select("owner", F.col("c.release_id").alias("release_id"), F.col("c.work_id").alias("work"))
    derived = recordings.join(releases, ["owner", "release_id"]).groupBy("owner", "work").agg(F.min("rd").alias("derived"))
    works = docs.select(F.col("mbid").alias("owner"), F.explode("works").alias("w")).select("owner", F.col("w.id").alias("work"), S.loose_date("w.first_release_date").alias("own"), F.col("w.collaborators.mbid").alias("people"))
    dated = works.join(derived, ["owner", "work"], "left").where(F.least("own", "derived").isNotNull())
    people = F.array_distinct(F.array_compact(F.array_union(F.array("owner"), F.coalesce("people", F.array().cast("array<string>")))))
    return pair_counts(dated.select("owner", "work", F.explode(people).alias("person")), ["owner", "work"], "person")


def _pairs_of_arrays(rows: DataFrame, key: str, people: str, weight: str) -> DataFrame:
    """u < v, weight: all pairs of each row's distinct people, one row each; long arrays are dealt to blocks."""
    inside = F.explode(F.flatten(F.transform(people, lambda x, i: F.transform(F.slice(F.col(people), i + 2, F.size(people)), lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))))))
    short = rows.where(F.size(people) <= PEOPLE).select(inside.alias("p"), weight).select("p.u", "p.v", weight)
    long = rows.where(F.size(people) > PEOPLE).select(key, F.explode(people).alias("n"), weight)
    return short.union(_pairs(long, [key]).select("u", "v", weight))


def owned_work_edges(owned: DataFrame, works: DataFrame, owner: Column) -> DataFrame:
    """cowork_edges() without documents. owned: work and what `owner` is made of, once each; works: work, people, one row for each dated work (of any owner).

    Pairs among a work's people are the same for all its owners: they are made once and weigh as many. An owner who is not among them is
    paired with each.
    """
    some = works.select("work", F.array_distinct(F.array_compact("people")).alias("people")).where(F.size("people") > 0)
    n = owned.groupBy("work").agg(F.count("*").alias("weight"))
    among = _pairs_of_arrays(some.where(F.size("people") > 1).join(n, "work"), "work", "people", "weight")
    apart = owned.select("work", owner.alias("owner")).where("owner is not null").join(some, "work").where(~F.array_contains("people", F.col("owner"))).select("owner", F.explode("people").alias("person"))
    pairs = among.union(apart.select(F.least("owner", "person").alias("u"), F.greatest("owner", "person").alias("v"), F.lit(1).cast("long").alias("weight")))
    return pairs.groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def size_adjusted_edges(members: DataFrame, key: str | list[str], node: str) -> DataFrame:
    """Edges whose weight from a work of n participants is 1 / (n - 1)."""
    keys = [key] if isinstance(key, str) else key
    m = members.select(*keys, node).where(F.col(node).isNotNull()).distinct()
    sizes = m.groupBy(*keys).agg(F.count("*").alias("__n"))
    return pair_counts(m.join(sizes, keys), keys, node, F.try_divide(F.lit(1.0), F.col("__n") - 1))


def pair_examples(members: DataFrame, key: str | list[str], node: str, title: str) -> DataFrame:
    """u, v, weight and the sorted distinct titles of the shared works, joined by '; '."""
    keys = [key] if isinstance(key, str) else key
    m = members.select(*keys, F.col(node).alias("n"), F.col(title).alias("t")).dropDuplicates([*keys, "n"])
    pairs = _dealt_pairs(m, keys)
    return pairs.groupBy("u", "v").agg(F.count("*").alias("weight"), F.concat_ws("; ", F.array_sort(F.collect_set("t"))).alias("examples"))


def writer_graph(records: DataFrame, relations: list[str]) -> DataFrame:
    """Edges between the authors (name, mbid, relation) of each recording whose relation is wanted; the key is mbid or else name."""
    one = records.select("recording_id", "recording_title", F.explode("authors").alias("a")).where(F.lower("a.relation").isin(relations))
    one = one.withColumn("author", S.known(F.col("a.mbid"), "")).withColumn("author", F.when(F.col("author") == "", F.col("a.name")).otherwise(F.col("author")))
    return pair_examples(one.where("author is not null"), "recording_id", "author", "recording_title")


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected simple edges (u, v): trimmed, no blanks, loops or doubles. Isolated vertices are not in it."""
    strings = {c: dict(edges.dtypes)[c] == "string" for c in ("u", "v")}
    side = {c: S.strip(c) if s else F.col(c) for c, s in strings.items()}
    e = edges.select(side["u"].alias("a"), side["v"].alias("b")).where("a is not null and b is not null and a <> b")
    if any(strings.values()):
        e = e.where("a <> '' and b <> ''")
    return e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def last_weight(edges: DataFrame, order: str) -> DataFrame:
    """One edge per undirected pair, the last by `order`; a missing weight is 1."""
    pair = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), order)
    return pair.groupBy("u", "v").agg(F.max_by("weight", order).alias("weight"))


def within(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges with both ends among nodes."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    return edges.join(n, edges["u"] == n["__n"], "left_semi").join(n, F.col("v") == F.col("__n"), "left_semi")


def vertices(edges: DataFrame, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    return (ends if nodes is None else ends.union(nodes.select(F.col(node).alias("node")))).distinct()


def draw_order(node: str, seed: int = 0) -> Column:
    """A fixed pseudorandom order: MD5 of seed:id, so that any engine can draw the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(node).cast("string")))


def sample_nodes(nodes: DataFrame, node: str, k: int, seed: int = 0) -> DataFrame:
    """k nodes, the same at every run: the smallest by a hash of id and seed. The sampling is the feature."""
    return nodes.orderBy(draw_order(node, seed), node).limit(k)


def sampled_subgraph(edges: DataFrame, k: int, least_edges: int = 1, attempts: int = 10, seed: int = 0) -> DataFrame:
    """Edges among k sampled vertices. Draws with too few edges are repeated with the next seed, up to `attempts` of them; then least_edges sampled edges stand in."""
    nodes = vertices(edges)
    for i in range(attempts):
        got = within(edges, sample_nodes(nodes, "node", k, seed + i), "node")
        if got.limit(least_edges).count() >= least_edges:
            return got
    pair = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))))
    return edges.orderBy(pair, "u", "v").limit(least_edges)


def adjacency(edges: DataFrame, nodes: DataFrame, node: str, value: str) -> DataFrame:
    """row, column, value of the full symmetric matrix over the given nodes, 0 where there is no edge or no value. Its size is the nodes' square: for samples."""
    n = nodes.select(F.col(node).alias("__n")).distinct()
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col(value).cast("double").alias("__w"))
    cells = n.select(F.col("__n").alias("row")).join(n.select(F.col("__n").alias("column")), F.lit(True))
    j = cells.join(e, (F.least("row", "column") == F.col("u")) & (F.greatest("row", "column") == F.col("v")), "left")
    return j.select("row", "column", F.coalesce("__w", F.lit(0.0)).alias("value"))


def distinct_authors(records: DataFrame) -> DataFrame:
    """recording_id, mbid, relation, name: authors once per id and relation, the smallest name of several; without an id by name."""
    one = records.select("recording_id", F.explode("authors").alias("a")).select("recording_id", F.nullif(S.strip("a.mbid"), F.lit("")).alias("mbid"), F.lower("a.relation").alias("relation"), F.col("a.name").alias("name"))
    key = F.coalesce("mbid", "name").alias("__k")
    return one.groupBy("recording_id", key, "relation").agg(F.min("mbid").alias("mbid"), F.min("name").alias("name")).select("recording_id", "mbid", "relation", "name")


def author_names(records: DataFrame) -> DataFrame:
    """mbid, name: the last name of each author, by recording."""
    one = records.select("recording_id", F.explode("authors").alias("a")).where("a.mbid is not null")
    return one.groupBy(F.col("a.mbid").alias("mbid")).agg(F.max_by("a.name", F.struct("recording_id", "a.name")).alias("name"))
