"""Repair of conversation structure by the cheapest edits: a fold of Spark SQL's aggregate() over sorted turns.

A conversation is in order when its role initials spell (s?(ua)+)?. Each turn is
kept (cost 0), reroled to user or assistant (1) or deleted (2; a must for blank
and duplicate turns); an empty user or assistant turn is inserted for 5; a
truncated turn that isn't deleted costs 5 more. Among the cheapest repairs the
one whose edits' initials (D, I, K, R) come first in ASCII is taken.

1. Windows flag the faults: blank, a repeat of an earlier turn's role and text,
   truncated. The window that finds repeats holds the turns of one role and text.
2. A conversation's turns go to blocks by turn number, a block of too many equal
   numbers to blocks of their own, so a block has block_turns turns at most and
   no conversation is gathered as a whole with its texts. A block is a row with
   its sorted array of turn structs.
3. aggregate() folds a block from each of the four states in which it can begin
   (nothing, s, u, a) and carries four (cost, audit) structs, one for each state
   it can have come to; a null struct is a state out of reach, which least()
   passes over. Insertions are tried before each turn and at the end.
4. A second aggregate() puts a conversation's blocks together, four structs
   again. Of two repairs with equal cost neither audit begins with the other (it
   would be by inserts, which cost), so the least of the longer ones comes from
   the least of the shorter, in turns as in blocks.
5. The audit goes back to the blocks in slices; each block writes its repaired
   lines, natively. A digest of a conversation is the one sequential thing: lines
   sorted by block pass through a running SHA-256, a batch of them in memory.

Rows: a conversation's audit and its blocks' audits, one byte an edit, are held
together, as the result is.

Defined results: a null in any column reads as one space (role and text; in the
damage's key also conv_id and turn). Conversations without conv_id are one. Rows
of a conversation with equal turn come by role and text, so repeated rows stand
side by side and the later ones are duplicates. A role's initial is its first
character, any other than s, u or a fits nowhere and '' is no initial. A
conversation that lost all its rows has zeros, an empty audit and the digest of
''. No rows, no conversations. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinweave.llm import common as C

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
PATH = "struct<cost:bigint,audit:string>"
#: A path for each state: nothing yet, s, u, a.
STATE = f"struct<n:{PATH},s:{PATH},u:{PATH},a:{PATH}>"


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, lost: rows after the damage; dropped rows stay, marked lost, so that no conversation vanishes."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") == 0, F.lit("")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(copies).alias("copy")).drop("copy")


def as_given(turns: DataFrame) -> DataFrame:
    """Rows as damaged() has them, without damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.lit(False).alias("lost"))


def blocks(rows: DataFrame, block_turns: int = 256) -> DataFrame:
    """conv, block, part, turns, and what the block counts: one row per block of sorted turns."""
    digest = C.digest_of(F.col("text"))
    alike = W.partitionBy("conv", "role", "digest", "lost").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", F.lit(BLANK)).when(F.col("nth") > 1, F.lit(DUPLICATE)).when(last.rlike("[.!?]"), F.lit(0)).otherwise(F.lit(TRUNCATED))
    block = F.coalesce(F.floor(F.col("turn") / F.lit(block_turns)), F.lit(-(1 << 62)))  # turns without number come first
    rows = rows.withColumn("digest", digest).withColumn("nth", F.row_number().over(alike)).withColumn("block", block).withColumn("fault", fault)
    # within the numbers of a block: what changes from row to row, and parts of it where numbers repeat
    here = W.partitionBy("conv", "block").orderBy(F.col("lost"), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    rows = rows.withColumn("at", F.row_number().over(here) - 1).withColumn("new", (F.col("turn").isNotNull() & (F.col("at") == 0)) | ~F.col("turn").eqNullSafe(F.lag("turn").over(here)))
    rows = rows.withColumn("part", F.floor(F.col("at") / F.lit(block_turns)))
    turn = F.struct("at", F.substring("role", 1, 1).alias("initial"), "fault", "role", "text")
    there = ~F.col("lost")
    return rows.groupBy("conv", "block", "part").agg(
        F.sort_array(F.collect_list(F.when(there, turn))).alias("turns"),
        F.min(F.when(there, F.col("turn"))).alias("least_turn"), F.max(F.when(there, F.col("turn"))).alias("most_turn"),
        F.count_if(there & F.col("turn").isNotNull() & F.col("new")).alias("turn_numbers"),
        *[F.count_if(there & (F.col("fault") == x)).alias(n) for x, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
    )


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _more(path: Column, cost: Column | int, edit: str | Column) -> Column:
    """A path and one more edit; out of reach stays so."""
    longer = F.struct((path["cost"] + cost).cast("long").alias("cost"), F.concat(path["audit"], edit if isinstance(edit, Column) else F.lit(edit)).alias("audit"))
    return F.when(path.isNotNull(), longer)


def _inserted(state: Column, use) -> Column:
    """use(paths n, s, u, a after any insertions): one user turn unless one is open, then one assistant turn."""
    user = F.least(state["u"], _more(F.least(state["n"], state["s"], state["a"]), INSERT, "I"))
    return _let(user, lambda u: _let(F.least(state["a"], _more(u, INSERT, "I")), lambda a: use(state["n"], state["s"], u, a)))


def _paths(n: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(n.alias("n"), s.alias("s"), u.alias("u"), a.alias("a")).cast(STATE)


def _step(state: Column, turn: Column) -> Column:
    """The four paths after a turn, from those before it."""
    keepable = ~turn["fault"].isin(BLANK, DUPLICATE)
    more = F.when(turn["fault"] == TRUNCATED, F.lit(UNFINISHED)).otherwise(F.lit(0))

    def moved(path: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return F.when(keepable, _more(path, more + F.when(own, F.lit(KEEP)).otherwise(F.lit(REROLE)), F.when(own, F.lit("K")).otherwise(F.lit("R"))))

    def after(n: Column, s: Column, u: Column, a: Column) -> Column:
        begun = F.when(keepable & (turn["initial"] == "s"), _more(n, more + KEEP, "K"))
        asked = _let(F.least(n, s, a), lambda x: moved(x, "u"))
        return _paths(_more(n, DELETE, "D"), F.least(_more(s, DELETE, "D"), begun), F.least(_more(u, DELETE, "D"), asked), F.least(_more(a, DELETE, "D"), moved(u, "a")))

    return _inserted(state, after)


def _begin(state: str) -> Column:
    here = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _paths(*[here if q == state else F.lit(None).cast(PATH) for q in "nsua"])


def _joined(state: Column, block: Column) -> Column:
    """Paths of what went before, and a block's four folds: the paths after the block."""
    onward = lambda p, q: F.when(p.isNotNull() & q.isNotNull(), F.struct((p["cost"] + q["cost"]).alias("cost"), F.concat(p["audit"], q["audit"]).alias("audit")))
    return _paths(*[F.least(*[onward(state[p], block[f"from_{p}"][q]) for p in "nsua"]) for q in "nsua"])


def _illegal(before: Column, after: Column) -> Column:
    """Number of places where two arrays of initials, side by side, break the alternation."""
    return F.coalesce(F.size(F.filter(F.zip_with(before, after, lambda a, b: F.concat(a, b)), lambda x: ~x.isin("su", "ua", "au"))), F.lit(0))


def _but_last(array: Column) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0)))


def _but_first(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array), F.lit(1)))


def plans(table: DataFrame) -> DataFrame:
    """conv and what is reported of it, with sizes: the turns of each of its blocks, in order."""
    initials = F.transform("turns", lambda t: t["initial"])
    n = F.size("turns")
    folded = table.select(
        "*", n.alias("n_turns"), _illegal(_but_last(initials), _but_first(initials)).alias("inner"),
        F.struct("block", "part", n.alias("n_turns"), F.get(initials, F.lit(0)).alias("first"), F.get(initials, n - 1).alias("last"), *[F.aggregate("turns", _begin(p), _step).alias(f"from_{p}") for p in "nsua"]).alias("one"),
    )
    per = folded.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.when(F.col("n_turns") > 0, F.col("one")))).alias("blocks"),
        F.min("least_turn").alias("least_turn"), F.max("most_turn").alias("most_turn"), *[F.sum(c).alias(c) for c in ("turn_numbers", "blank", "duplicate", "truncated", "inner")],
    )
    best = _inserted(F.aggregate("blocks", _begin("n"), _joined), lambda n, s, u, a: F.least(n, a))
    seams = _illegal(F.transform(_but_last(F.col("blocks")), lambda b: b["last"]), F.transform(_but_first(F.col("blocks")), lambda b: b["first"]))
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turn_numbers"), F.lit(0))
    per = per.withColumn("best", best)
    return per.select(
        "conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("inner") + seams).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), b["part"].alias("part"), b["n_turns"].alias("n_turns"))).alias("sizes"),
    )


def slices(plan: DataFrame) -> DataFrame:
    """conv, block, part, edits (one string a turn: its insertions, then its edit), before (lines above the block), tail (insertions below it), system."""
    edits = F.regexp_extract_all("audit", F.lit("I*[DKR]"), F.lit(0))
    lines = lambda e: F.length(F.replace(F.array_join(e, ""), F.lit("D"), F.lit("")))
    cut = plan.where(F.size("sizes") > 0).select("conv", "audit", "sizes", edits.alias("edits"))

    def onward(state: Column, b: Column) -> Column:
        own = F.slice(F.col("edits"), state["start"] + 1, b["n_turns"])
        one = F.struct(b["block"].alias("block"), b["part"].alias("part"), own.alias("edits"), state["lines"].alias("before"))
        return F.struct((state["start"] + b["n_turns"]).alias("start"), (state["lines"] + lines(own)).alias("lines"), F.concat(state["cut"], F.array(one)).alias("cut"))

    none = F.array().cast("array<struct<block:bigint,part:bigint,edits:array<string>,before:int>>")
    cut = cut.select("conv", F.aggregate("sizes", F.struct(F.lit(0).alias("start"), F.lit(0).alias("lines"), none.alias("cut")), onward).alias("x"), F.length(F.regexp_extract("audit", r"I*\z", 0)).alias("tail"))
    # s?(ua)+ has an odd number of lines only with the s
    return cut.select("conv", ((F.col("x.lines") + F.col("tail")) % 2).alias("system"), "tail", F.size("x.cut").alias("n_blocks"), F.posexplode("x.cut").alias("nth", "y")).select(
        "conv", "y.*", "system", F.when(F.col("nth") == F.col("n_blocks") - 1, F.col("tail")).otherwise(F.lit(0)).alias("tail")
    )


def repaired(table: DataFrame, plan: DataFrame) -> DataFrame:
    """conv, block, part, lines: the repaired conversation, `role:text` a line."""
    cut = slices(plan)
    names = ("conv", "block", "part")
    cut = cut.select(*[F.col(c).alias(f"c_{c}") for c in names], "edits", "before", "system", "tail")
    both = table.join(cut, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("block") == F.col("c_block")) & (F.col("part") == F.col("c_part")))
    own_role = lambda at: F.when((at - F.col("system")) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = lambda at, n: F.when(n > 0, F.transform(F.sequence(at, at + n - 1), lambda i: F.concat(own_role(i), F.lit(":")))).otherwise(F.array().cast("array<string>"))

    def onward(state: Column, x: Column) -> Column:
        turn, edit = x["turns"], x["edits"]
        inserts = F.length(edit) - 1
        at = state["at"] + inserts
        role = F.when(edit.endswith("K"), turn["role"]).otherwise(own_role(at))
        line = F.when(edit.endswith("D"), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), turn["text"])))
        return F.struct((at + F.size(line)).alias("at"), F.concat(state["lines"], added(state["at"], inserts), line).alias("lines"))

    end = F.aggregate(F.arrays_zip("turns", "edits"), F.struct(F.col("before").alias("at"), F.array().cast("array<string>").alias("lines")), onward)
    both = both.select(*names, "system", "tail", end.alias("end"))
    return both.select(*names, F.concat(F.col("end.lines"), added(F.col("end.at"), F.col("tail"))).alias("lines"))


def digests(lines: DataFrame) -> DataFrame:
    """conv, sha256 of a conversation's lines joined by newlines; lines pass through a running hash, so none is held whole."""
    C.small_batches(lines.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        conv, held, out = None, None, []
        for b in batches:
            for key, part in zip(b.column("conv").to_pylist(), b.column("lines"), strict=True):
                if held is None or key != conv:
                    if held is not None:
                        out.append((conv, held.hexdigest()))
                    conv, held, first = key, hashlib.sha256(), True
                for line in part.as_py():
                    if not first:
                        held.update(b"\n")
                    held.update(line.encode())
                    first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["conv", "sha256"])
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([held.hexdigest()])], ["conv", "sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "block", "part").select("conv", "lines").mapInArrow(run, "conv long, sha256 string")


def repair(rows: DataFrame, block_turns: int = 256) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and its repaired lines (conv, block, part, lines)."""
    table = C.materialise(blocks(rows, block_turns), "turn-blocks")
    plan = C.materialise(plans(table), "repair-plans")
    lines = repaired(table, plan)
    digest = digests(lines).select(F.col("conv").alias("d_conv"), "sha256")
    report = plan.join(digest, F.col("conv").eqNullSafe(F.col("d_conv")), "left").withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return report.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), lines


def damage_and_repair(turns: DataFrame) -> DataFrame:
    return repair(damaged(turns))[0]
