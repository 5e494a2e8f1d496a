"""Node embeddings from weighted random walks and skip-gram with negative sampling.

Walks. A vertex's neighbours are rows, not an array: each has an interval of the
vertex's weight (in whole units, some 2^40 a vertex), and a vertex of n
neighbours is cut into n / 16 ranges of equal weight. A walker draws a number by
a hash of (seed, walker, step), which names a range and one interval in it, and
joins by (vertex, range): walkers at a hub meet as many keys as it has ranges,
and a hub's neighbours never travel together. Return and in-out parameters are
met by rejection: a drawn neighbour is taken with a chance in proportion to its
bias, which asks only whether the pair of it and the vertex before is an edge
(one join on the pair); walkers that took none draw again until all have moved.

Skip-gram. Vertices are dealt to blocks by hash and numbered inside them; walks
are arrays of these numbers. Pairs of centre and context are never rows: packed
as numbers, some thousand a row, they are written by their two blocks, so that a
round reads only what it trains. In a round every block of centres meets one
block of contexts, all in parallel; after as many rounds as blocks each pair has
been met once. A task holds the vectors of two blocks and streams the pairs
between them. Vectors are written after each round, so a lost executor costs a
round. Everything is drawn by hash or from a seed: the same walks and vectors at
every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.validate import cut, forget, scratch

#: Neighbours to a range of a vertex's weight, on average.
RANGE = 16
#: Neighbours whose weights are summed in one go.
RUN = 1024
UNITS = 1 << 40
#: Most vertices of a block on average (two blocks' vectors are in a task's memory), blocks that are trained side by side, and vertices below which a few are enough.
BLOCK, SIDE, FEW = 1 << 18, 12, 20_000
#: Walks whose pairs are packed in one go, and vectors to a row.
PACK, ROW = 1 << 14, 1 << 12
#: Draws that a walker makes at once where some are rejected.
TRIES = 6


def hoods(edges: DataFrame) -> DataFrame:
    """src, range, low, high, dst, and the whole weight (all) and a range's (width) of dst: a row for each range that a neighbour's interval touches."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("u").cast("string").alias("a"), F.col("v").cast("string").alias("b"), w.alias("w")).where("w > 0")
    links = one.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))
    sums = links.groupBy("src").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    units = F.greatest(F.lit(1).cast("long"), F.round(F.col("w") / F.col("s") * F.lit(float(UNITS))).cast("long"))
    rows = cut(links.join(sums, "src").select("src", "dst", units.alias("units"), "n", F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / RUN)).alias("run")))
    info = cut(rows.groupBy("src").agg(F.sum("units").alias("all"), F.ceil(F.sum("units") / F.ceil(F.max("n") / RANGE)).alias("width")))
    runs = rows.groupBy("src", "run").agg(F.sum("units").alias("u"))
    runs = runs.withColumn("base", F.sum("u").over(W.partitionBy("src").orderBy("run")) - F.col("u")).drop("u")  # a row for each RUN neighbours
    inside = F.sum("units").over(W.partitionBy("src", "run").orderBy("dst", "units").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("upto", inside).join(runs, ["src", "run"]).select("src", "dst", (F.col("base") + F.col("upto") - F.col("units")).alias("low"), (F.col("base") + F.col("upto")).alias("high"))
    placed = placed.join(info.select("src", F.col("width").alias("w")), "src").withColumn("range", F.explode(F.sequence(F.expr("low div w"), F.expr("(high - 1) div w")))).drop("w")
    return cut(placed.join(info.withColumnRenamed("src", "dst"), "dst").select("src", "range", "low", "high", "dst", "all", "width"))


def _drawn(walkers: DataFrame, hood: DataFrame, step: int, turn: int, tries: int, seed: int) -> DataFrame:
    """walkers with try, to (a neighbour drawn by weight), its all and width."""
    t = walkers.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))) if tries > 1 else walkers.withColumn("try", F.lit(0))
    t = t.withColumn("t", F.pmod(F.shiftrightunsigned(F.xxhash64("node", "walker", F.lit(step), F.lit(turn), "try", F.lit(seed)), 1), F.col("all"))).withColumn("r", F.expr("t div width")).drop("all", "width")
    return t.join(hood, (F.col("at") == F.col("src")) & (F.col("r") == F.col("range")) & (F.col("low") <= F.col("t")) & (F.col("t") < F.col("high"))).drop("src", "range", "low", "high", "t", "r").withColumnRenamed("dst", "to")


def walks(edges: DataFrame, length: int = 10, per_node: int = 8, seed: int = 42, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """node, walk (array of strings, `length` vertices). p, q: return and in-out parameters."""
    return _walked(edges, hoods(edges).withColumn("mark", F.col("dst")), length, per_node, seed, p, q)


def _walked(edges: DataFrame, hood: DataFrame, length: int, per_node: int, seed: int, p: float, q: float) -> DataFrame:
    """walks() whose arrays hold what the hood's column mark says of its dst."""
    begin = hood.select(F.col("dst").alias("node"), "all", "width", "mark").distinct()
    state = begin.withColumn("walker", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select("node", "walker", F.col("node").alias("at"), F.lit(None).cast("string").alias("before"), "all", "width", F.array("mark").alias("walk"))
    biased = (p, q) != (1.0, 1.0)
    pairs = cut(edges.select(F.inline(F.array(F.struct(F.col("u").cast("string").alias("x"), F.col("v").cast("string").alias("y")), F.struct(F.col("v").cast("string").alias("x"), F.col("u").cast("string").alias("y"))))).distinct()) if biased else None
    for step in range(1, length):
        if not biased or step == 1:
            after = cut(_moved(_drawn(state, hood, step, 0, 1, seed)))
        else:
            after = _accepted(state, hood, pairs, step, p, q, seed)
        if step > 1:
            forget(state)
        state = after
    return state.select("node", "walk")


def _moved(drawn: DataFrame) -> DataFrame:
    return drawn.select("node", "walker", F.col("to").alias("at"), F.col("at").alias("before"), "all", "width", F.concat("walk", F.array("mark")).alias("walk"))


def _accepted(state: DataFrame, hood: DataFrame, pairs: DataFrame, step: int, p: float, q: float, seed: int) -> DataFrame:
    """state after a step whose neighbours are taken by bias: 1 / p back, 1 to a neighbour of the vertex before, 1 / q elsewhere."""
    most, done, left, turn = max(1.0, 1 / p, 1 / q), None, state, 0
    while True:
        t = _drawn(left, hood, step, turn, TRIES, seed)
        t = t.join(pairs, (F.col("before") == F.col("x")) & (F.col("to") == F.col("y")), "left")
        bias = F.when(F.col("to") == F.col("before"), F.lit(1 / p)).when(F.col("x").isNotNull(), F.lit(1.0)).otherwise(F.lit(1 / q))
        chance = F.shiftrightunsigned(F.xxhash64("walker", "node", "try", F.lit(turn), F.lit(step), F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
        taken = t.where(chance * F.lit(most) < bias).groupBy("node", "walker").agg(F.min_by(F.struct("at", "to", "all", "width", "mark", "walk"), "try").alias("m")).select("node", "walker", "m.*")
        taken = cut(_moved(taken))
        done = taken if done is None else done.unionByName(taken)
        rest = cut(left.join(taken.select("node", "walker"), ["node", "walker"], "left_anti"))
        if turn:
            forget(left)
        left, turn = rest, turn + 1
        if left.isEmpty():
            forget(left)
            return cut(done)


def window_pairs(walked: DataFrame, window: int) -> DataFrame:
    """node, context: every two vertices of a walk at most `window` apart, both ways; order: where in which walk."""
    own = walked.select("walk", F.xxhash64("node", "walk").alias("h"), F.posexplode("walk").alias("i", "node"))
    near = F.slice("walk", F.greatest(F.lit(1), F.col("i") + 1 - window), F.least(F.col("i"), F.lit(window)) + 1 + window)
    return own.select("node", "h", "i", F.posexplode(near).alias("j", "context")).where("context <> node").select("node", "context", F.xxhash64("h", "i", "j").alias("order"))


def in_blocks(nodes: DataFrame, seed: int = 42, blocks: int | None = None) -> tuple[DataFrame, int]:
    """node, block, place (from 0, by name), mark (both in a long), kept in a table, and the number of blocks."""
    n = nodes.count()
    blocks = blocks or (SIDE * -(-n // (SIDE * BLOCK)) if n > FEW else 4)
    block = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(blocks)).cast("int")
    placed = nodes.select("node", block.alias("block")).withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("node")) - 1)
    return cut(placed.withColumn("mark", F.shiftleft(F.col("block").cast("long"), 32) + F.col("place"))), blocks


def skip_gram(walked: DataFrame, nodes: DataFrame, blocks: int, window: int = 10, dimensions: int = 32, negatives: int = 5, epochs: int = 3, rate: float = 0.05, seed: int = 42, batch: int = 256) -> DataFrame:
    """node, vector: centres' vectors. walked: node, walk (array of marks); nodes: in_blocks().

    What rounds pass on are rows (block, kind, first, data): vectors of places
    from `first`, of centres (kind 0) or contexts (1). A task gets these, the
    contexts' counts (2) and its packed pairs (3), in this order.
    """
    spark = walked.sparkSession
    total = walked.count()
    counts = walked.mapInArrow(lambda rows: _contexts(rows, window), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    counts = nodes.join(counts, "mark", "left").groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x["n"]).alias("n"))
    counts = cut(counts)
    path = scratch(spark, "pairs")
    kept = walked.repartition(-(-total // (8 * PACK)) or 1, "node").sortWithinPartitions("node", "walk")
    packed = kept.mapInArrow(lambda rows: _packed(rows, window, blocks), "block int, other int, first long, data binary")
    packed.withColumn("shift", F.pmod(F.col("other") - F.col("block"), F.lit(blocks))).write.partitionBy("shift").parquet(path)
    dealt = spark.read.schema("block int, other int, first long, data binary, shift int").parquet(path)
    sizes = counts.select("block", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), F.size("n").alias("size"))
    held = cut(sizes.mapInArrow(lambda rows: _begun(rows, dimensions, seed), "block int, kind int, first long, data binary"))
    rounds = blocks * epochs
    none = F.lit(None).cast("array<long>").alias("n")

    def trainer(nth: int):
        return lambda batches: _trained(batches, dimensions, negatives, rate * (1 - nth / rounds), seed + nth, batch)

    for nth in range(rounds):
        shift = nth % blocks
        of_context = F.pmod(F.col("block") - shift, F.lit(blocks))
        vectors = held.select(F.when(F.col("kind") == 0, F.col("block")).otherwise(of_context).alias("group"), "kind", F.lit(0).cast("long").alias("order"), "first", "data", none)
        weights = counts.select(of_context.alias("group"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("order"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("binary").alias("data"), "n")
        now = dealt.where(F.col("shift") == shift).select(F.col("block").alias("group"), F.lit(3).alias("kind"), F.xxhash64("first", F.lit(nth)).alias("order"), "first", "data", none)
        rows = vectors.unionByName(weights).unionByName(now).repartitionById(blocks, F.col("group")).sortWithinPartitions("group", "kind", "order", "first")
        trained = rows.mapInArrow(trainer(nth), "group int, kind int, first long, data binary")
        after = cut(trained.select(F.when(F.col("kind") == 0, F.col("group")).otherwise(F.pmod(F.col("group") + shift, F.lit(blocks))).alias("block"), "kind", "first", "data"))
        forget(held)
        held = after
    vectors = held.where("kind = 0").mapInArrow(lambda rows: _unpacked(rows, dimensions), "mark long, vector array<float>")
    return nodes.join(vectors, "mark").select("node", "vector")


def _matrices(batches, most: int):
    """The walks of batches as matrices of `most` rows (the last of fewer), wherever batches end."""
    import numpy as np

    held, n = [], 0
    for rows in batches:
        if not len(rows):
            continue
        walk = rows.column("walk")
        held.append(walk.flatten().to_numpy().reshape(len(rows), -1))
        n += len(rows)
        while n >= most:
            whole = np.concatenate(held)
            yield whole[:most]
            held, n = [whole[most:]], n - most
    if n:
        yield np.concatenate(held)


def _near(walk, window: int):
    """Centres and contexts of a matrix of walks, as window_pairs() has them."""
    import numpy as np

    n = walk.shape[1]
    at = [(i, j) for i in range(n) for j in range(max(0, i - window), min(n, i + window + 1)) if i != j]
    centre, context = (np.concatenate([walk[:, x[k]] for x in at]) if at else walk[:0, 0] for k in (0, 1))
    differ = centre != context
    return centre[differ], context[differ]


def _contexts(batches, window: int):
    """mark, n: how often each vertex is a context, counted for PACK walks at a time."""
    import numpy as np
    import pyarrow as pa

    for walk in _matrices(batches, PACK):
        mark, n = np.unique(_near(walk, window)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(n)], ["mark", "n"])


def _packed(batches, window: int, blocks: int):
    """block, other, first (a number of its own), data: places of centres, then of contexts, of the pairs between two blocks in PACK walks."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    for nth, walk in enumerate(_matrices(batches, PACK)):
        centre, context = _near(walk, window)
        key = (centre >> 32) * blocks + (context >> 32)
        order = np.argsort(key.astype(np.uint16) if blocks <= 256 else key, kind="stable")
        key, places = key[order], [(x[order] & 0xFFFFFFFF).astype(np.int32) for x in (centre, context)]
        cuts = np.flatnonzero(np.diff(key)) + 1 if len(key) else []
        ends = list(zip([0, *cuts], [*cuts, len(key)], strict=True)) if len(key) else []
        first = (TaskContext.get().partitionId() << 24) + nth
        data = [b"".join(x[s:e].tobytes() for x in places) for s, e in ends]
        kinds = [int(key[s]) for s, _ in ends]
        columns = [pa.array([k // blocks for k in kinds], pa.int32()), pa.array([k % blocks for k in kinds], pa.int32()), pa.array([first] * len(kinds), pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "other", "first", "data"])


def _rows(names, block: int, kind: int, vectors):
    """A block's vectors, ROW to a row."""
    import pyarrow as pa

    for s in range(0, len(vectors), ROW):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.array([s], pa.int64()), pa.array([vectors[s : s + ROW].tobytes()], pa.binary())], names)


def _begun(batches, dimensions: int, seed: int):
    """The vectors before training: small ones of centres, zeros of contexts."""
    import numpy as np

    for rows in batches:
        for block, kind, size in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            draw = np.random.default_rng([seed & 0x7FFFFFFF, block])
            vectors = (draw.random((size, dimensions)) - 0.5) / dimensions if kind == 0 else np.zeros((size, dimensions))
            yield from _rows(["block", "kind", "first", "data"], block, kind, vectors.astype(np.float32))


def _unpacked(batches, dimensions: int):
    import numpy as np
    import pyarrow as pa

    for rows in batches:
        for block, first, data in zip(*[rows.column(c).to_pylist() for c in ("block", "first", "data")], strict=True):
            flat = np.frombuffer(data, np.float32)
            m = len(flat) // dimensions
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * dimensions, pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array((block << 32) + first + np.arange(m), pa.int64()), lists], ["mark", "vector"])


class _Weighted:
    """Numbers drawn in proportion to weights: searchsorted() of uniform draws, begun from a table."""

    def __init__(self, weights):
        import numpy as np

        self.upto = np.cumsum(weights)
        self.total, self.cells = self.upto[-1], 4 * len(weights)
        self.guide = np.searchsorted(self.upto, np.arange(self.cells) * (self.total / self.cells), "right")

    def at(self, uniform):
        import numpy as np

        want, last = uniform * self.total, len(self.upto) - 1
        at = np.minimum(self.guide[(uniform * self.cells).astype(np.int64)], last)
        at -= (at > 0) & (self.upto[at - 1] > want)  # a cell's edge is rounded
        for _ in range(2):
            at = np.minimum(at + (self.upto[at] <= want), last)
        far = (self.upto[at] <= want) & (at < last)
        if far.any():
            at[far] = np.minimum(np.searchsorted(self.upto, want[far], "right"), last)
        return at


def _added(table, at, rows):
    """table[at] += rows, repeats and all, by the compiled form that add.at() has for one axis."""
    import numpy as np

    d = table.shape[1]
    np.add.at(table.reshape(-1), (at.reshape(-1, 1) * d + np.arange(d)).ravel(), rows.reshape(-1))


def _trained(batches, dimensions: int, negatives: int, rate: float, seed: int, size: int):
    """Rows of whole groups, sorted by group and kind: vectors of centres (0), of contexts (1), counts of contexts (2), then packed pairs (3). The vectors after all pairs."""
    import numpy as np

    names = ["group", "kind", "first", "data"]
    group, parts, a, b, weighted, draw = None, ([], []), None, None, None, None

    def whole(k):
        return np.concatenate([np.frombuffer(x, np.float32) for x in parts[k]] or [np.zeros(0, np.float32)]).reshape(-1, dimensions)

    def learn(centre, context):
        order = draw.permutation(len(centre))
        centre, context = centre[order], context[order]
        for s in range(0, len(centre), size):
            c, x = centre[s : s + size], context[s : s + size]
            others = weighted.at(draw.random((len(c), negatives)))
            to = np.concatenate((x[:, None], others), 1)
            u, v = a[c], b[to]
            z = 1 / (1 + np.exp(-np.clip(np.einsum("id,ikd->ik", u, v), -30, 30)))
            z[:, 0] -= 1
            z[:, 1:] *= others != x[:, None]  # a negative that is the context itself
            z = (-rate * z).astype(np.float32)
            _added(a, c, np.einsum("ik,ikd->id", z, v))
            _added(b, to, z[:, :, None] * u[:, None, :])

    def out():
        for kind, vectors in ((0, whole(0) if a is None else a), (1, whole(1) if b is None else b)):
            yield from _rows(names, group, kind, vectors)

    for rows in batches:
        for g, k, data, n in zip(rows.column("group").to_pylist(), rows.column("kind").to_pylist(), rows.column("data"), rows.column("n"), strict=True):
            if g != group:
                if group is not None:
                    yield from out()
                group, parts, a, b, weighted, draw = g, ([], []), None, None, None, np.random.default_rng([seed & 0x7FFFFFFF, g])
            if k < 2:
                parts[k].append(data.as_py())
            elif k == 2:
                weighted = _Weighted(np.maximum(n.values.to_numpy().astype(float), 1e-9) ** 0.75)
            else:
                if a is None:
                    a, b = whole(0), whole(1)
                    parts = ([], [])
                learn(*np.frombuffer(data.as_py(), np.int32).reshape(2, -1).astype(np.int64))
    if group is not None:
        yield from out()


def node2vec(edges: DataFrame, dimensions: int = 32, length: int = 10, per_node: int = 8, window: int = 10, seed: int = 42, p: float = 1.0, q: float = 1.0, iterations: int = 3, blocks: int | None = None) -> DataFrame:
    """node, n2v_0 .. n2v_<d-1>."""
    hood = hoods(edges)
    nodes, blocks = in_blocks(hood.select(F.col("dst").alias("node")).distinct(), seed, blocks)
    marked = cut(hood.join(nodes.select(F.col("node").alias("dst"), "mark"), "dst"))
    walked = _walked(edges, marked, length, per_node, seed, p, q)
    v = skip_gram(walked, nodes, blocks, window, dimensions, epochs=iterations, seed=seed)
    return v.select("node", *[F.col("vector")[i].alias(f"n2v_{i}") for i in range(dimensions)])
