"""Network-formation models by pseudo-likelihood: dyads as rows, change statistics as columns, logistic regression.

All edges enter; of the non-edges a hash sample does, weighted by the inverse of
its rate, since dyads grow with the square of the vertices. Sampled pairs are
made by hashing draws, never by a product of the vertices.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import order_statistics
from kinweave.operators.graph_build import vertices
from kinweave.operators.graph_local import both_ways, degree, density, two_steps
from kinweave.operators.graph_traverse import Csr, held
from kinweave.operators.relational import numbered, z_scores
from kinweave.validate import cut

# Decays of the geometrically weighted terms.
GWESP, GWDEGREE, GWDSP = 0.5, 0.8, 0.5


def density_model(edges: DataFrame) -> DataFrame:
    """The edges-only model in closed form: theta = logit(density), and its deviance."""
    d = density(edges)
    n = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    m, p = F.col("n_edges"), F.col("density")
    return d.select("n_nodes", "n_edges", F.ln(p / (1 - p)).alias("theta"), (-2 * (m * F.ln(p) + (n - m) * F.ln(1 - p))).alias("deviance"))


def sampled_dyads(edges: DataFrame, per_edge: float = 5.0, seed: int = 1) -> DataFrame:
    """u, v, edge (1 or 0), weight: every edge, and distinct random non-edges, about per_edge for each edge, weighted to stand for all."""
    spark = edges.sparkSession
    v = cut(numbered(vertices(edges), "node", "i"))
    n, m = v.count(), edges.count()
    all_pairs = n * (n - 1) // 2
    draws = int(max(per_edge * m, 64)) if all_pairs > m else 0
    pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(max(n, 1)))
    pairs = spark.range(draws).select(pick(1).alias("a"), pick(2).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = v.select(F.col("i"), F.col("node"))
    pairs = pairs.join(names.select(F.col("i").alias("a"), F.col("node").alias("u")), "a").join(names.select(F.col("i").alias("b"), F.col("node").alias("v")), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    non = pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti")
    k = non.count()
    rate = max(all_pairs - m, 0) / k if k else 0.0
    return edges.select("u", "v", F.lit(1).alias("edge"), F.lit(1.0).alias("weight")).union(non.select("u", "v", F.lit(0), F.lit(rate)))


def change_statistics(dyads: DataFrame, edges: DataFrame) -> DataFrame:
    """dyads with shared partners and the change statistics of gwesp, gwdegree and gwdsp for adding the pair (an edge is first taken away).

    gwdegree uses the ends' degrees without the pair. gwesp is the pair's own
    edgewise term plus, for each shared partner, the rise of the two side edges'
    terms, whose partner counts are taken without this pair. gwdsp: the new link
    makes each end a partner of the other end and its neighbours, see
    dyadwise_rise().
    """
    edges = cut(edges)
    a = both_ways(edges)
    d = dyads.select("u", "v", "edge")
    mid = d.join(a.select(F.col("src").alias("u"), F.col("dst").alias("w")), "u").join(a.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"])
    from kinweave.operators.graph_local import shared_partners

    s = shared_partners(edges)
    side = s.select(F.col("u").alias("a"), F.col("v").alias("b"), "shared")
    own = mid.select("u", "v", "edge", "w", F.least("u", "w").alias("a1"), F.greatest("u", "w").alias("b1"), F.least("v", "w").alias("a2"), F.greatest("v", "w").alias("b2"))
    j = own.join(side.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("shared").alias("s1")), ["a1", "b1"]).join(side.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("shared").alias("s2")), ["a2", "b2"])
    q = 1 - math.exp(-GWESP)
    rise = lambda c: F.pow(F.lit(q), F.col(c) - F.col("edge"))
    per = j.groupBy("u", "v").agg(F.count("*").alias("shared"), F.sum(rise("s1") + rise("s2")).alias("sides"))
    deg = degree(edges).select("node", "degree")
    out = dyads.join(per, ["u", "v"], "left").fillna(0, ["shared"]).fillna(0.0, ["sides"])
    out = out.join(deg.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    qd = 1 - math.exp(-GWDEGREE)
    out = out.join(dyadwise_rise(dyads, edges, 1 - math.exp(-GWDSP)), ["u", "v"], "left").fillna(0.0, ["gwdsp"])
    return out.select(
        *dyads.columns,
        "shared",
        (math.exp(GWESP) * (1 - F.pow(F.lit(q), F.col("shared"))) + F.col("sides")).alias("gwesp"),
        (F.pow(F.lit(qd), F.col("du") - F.col("edge")) + F.pow(F.lit(qd), F.col("dv") - F.col("edge"))).alias("gwdegree"),
        "gwdsp",
    )


def dyadwise_rise(dyads: DataFrame, edges: DataFrame, q: float) -> DataFrame:
    """u, v, gwdsp: the sum of q ** (shared partners of w and v, without the pair itself) over the other neighbours w of u, and the same with the ends exchanged.

    Linking u and v gives w and v one more partner, u, and a dyad's term rises by
    q ** partners. Tasks hold the graph where it is small enough; else the
    partners come from a join.
    """
    one = F.struct("u", "v", "edge", F.col("u").alias("x"), F.col("v").alias("y"))
    both = dyads.select("u", "v", "edge").select(F.inline(F.array(one, F.struct("u", "v", "edge", F.col("v").alias("x"), F.col("u").alias("y")))))
    g, kind = held(edges), dict(edges.dtypes)["u"]
    if g is None:
        a = cut(both_ways(edges))
        partners = two_steps(a).groupBy(F.col("src").alias("w"), F.col("dst").alias("y")).agg(F.count("*").alias("n"))
        j = both.join(a.select(F.col("src").alias("x"), F.col("dst").alias("w")), "x").where("w <> y").join(partners, ["w", "y"], "left")
        return j.groupBy("u", "v").agg(F.sum(F.pow(F.lit(q), F.coalesce("n", F.lit(0)) - F.col("edge"))).alias("gwdsp"))
    shared = edges.sparkSession.sparkContext.broadcast((g.nodes, g.to, g.at))

    def run(batches):
        import numpy as np
        import pandas as pd

        nodes, to, at = shared.value
        c = Csr.__new__(Csr)
        c.nodes, c.to, c.at = nodes, to, at
        names = np.array(nodes)
        for pdf in batches:
            out = np.zeros(len(pdf))
            x, y = (np.searchsorted(names, pdf[k].to_numpy()) for k in "xy")
            edge = pdf["edge"].to_numpy()
            order = np.argsort(y, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(y[order])) + 1) if len(order) else []:
                end = y[rows[0]]
                partners = np.bincount(c.neighbours(c.neighbours(np.array([end]))[1])[1], minlength=len(names))
                i, w = c.neighbours(x[rows])
                i, w = i[w != end], w[w != end]
                out[rows] = np.bincount(i, q ** (partners[w] - edge[rows][i]), len(rows))
            yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "s": out})

    parts = both.repartition(edges.sparkSession.sparkContext.defaultParallelism, "y").sortWithinPartitions("y").mapInPandas(run, f"u {kind}, v {kind}, s double")
    return parts.groupBy("u", "v").agg(F.sum("s").alias("gwdsp"))


def covariates(dyads: DataFrame, nodes: DataFrame, key: str, match: list[str] = (), add: list[str] = (), difference: list[str] = ()) -> DataFrame:
    """match_<c> (equal values), sum_<c> and absdiff_<c> of the ends' attributes; unknown text matches 'unknown'."""
    text = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c) for c in match}
    n = nodes.select(F.col(key), *text.values(), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in dict.fromkeys([*add, *difference])])
    rest = [c for c in n.columns if c != key]
    j = dyads.join(n.select(F.col(key).alias("u"), *[F.col(c).alias(f"u_{c}") for c in rest]), "u").join(n.select(F.col(key).alias("v"), *[F.col(c).alias(f"v_{c}") for c in rest]), "v")
    u, v = (lambda c: F.col(f"u_{c}")), (lambda c: F.col(f"v_{c}"))
    made = [(u(c) == v(c)).cast("int").alias(f"match_{c}") for c in match] + [(u(c) + v(c)).alias(f"sum_{c}") for c in add] + [F.abs(u(c) - v(c)).alias(f"absdiff_{c}") for c in difference]
    return j.select(*dyads.columns, *made)


def pair_covariate(dyads: DataFrame, pairs: DataFrame, value: str, name: str) -> DataFrame:
    """edgecov_<name>: a number that belongs to the pair itself, in either order of its ends; 0 for pairs without one. Several of a pair add up."""
    known = pairs.select(F.least("u", "v").alias("__a"), F.greatest("u", "v").alias("__b"), F.col(value).cast("double").alias("__x"))
    known = known.groupBy("__a", "__b").agg(F.sum("__x").alias("__x"))
    j = dyads.join(known, (F.least("u", "v") == F.col("__a")) & (F.greatest("u", "v") == F.col("__b")), "left")
    return j.select(*dyads.columns, F.coalesce("__x", F.lit(0.0)).alias(f"edgecov_{name}"))


def block_dyads(edges: DataFrame, nodes: DataFrame, key: str, block: str, within: float = 5.0, between: float = 2.0, seed: int = 1) -> DataFrame:
    """u, v, edge, weight, match_<block>: every edge, and random non-edges drawn apart within blocks and between them.

    within and between are draws for each edge. Within blocks a vertex is drawn first and then a partner of its block, so pairs
    of a block are drawn alike; the weights make each block's non-edges, and those between blocks, stand for all of theirs.
    An unknown block is a block; so is a vertex that nodes lacks.
    """
    spark, salt = edges.sparkSession, lambda i: F.xxhash64("id", F.lit(i), F.lit(seed))
    named = vertices(edges).join(nodes.select(F.col(key).alias("node"), F.col(block).cast("string").alias("block")), "node", "left").select("node", F.coalesce("block", F.lit("unknown")).alias("block"))
    v = cut(numbered(named, "node", "i"))
    sizes = cut(v.groupBy("block").agg(F.count("*").alias("size"), F.min("i").alias("least")))
    inside = order_statistics.numbered(v, ["block"], F.xxhash64("node", F.lit(seed)), ["node"], "j")
    inside = cut(inside.select("node", "block", "i", (F.col("j") - 1).alias("j")))
    n, m = v.count(), edges.count()
    of = inside.select("node", "block")
    linked = edges.select("u", "v").join(of.withColumnsRenamed({"node": "u", "block": "bu"}), "u").join(of.withColumnsRenamed({"node": "v", "block": "bv"}), "v")
    linked = cut(linked)
    one = spark.range(int(max(within * m, 64))).select(F.pmod(salt(1), F.lit(max(n, 1))).alias("i"), salt(2).alias("draw"))
    one = one.join(inside.select("i", "node", "block", "j"), "i").join(sizes.select("block", "size"), "block").where("size > 1")
    other = F.pmod(F.col("draw"), F.col("size"))
    one = one.select("block", F.col("node").alias("a"), "j", other.alias("k")).where("j <> k")
    own = one.join(inside.select("block", F.col("j").alias("k"), F.col("node").alias("b")), ["block", "k"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("block").alias("bu"), F.col("block").alias("bv")).distinct()
    two = spark.range(int(max(between * m, 64))).select(F.pmod(salt(3), F.lit(max(n, 1))).alias("x"), F.pmod(salt(4), F.lit(max(n, 1))).alias("y")).where("x <> y")
    ends = inside.select("i", "node", "block")
    two = two.join(ends.select(F.col("i").alias("x"), F.col("node").alias("a"), F.col("block").alias("p")), "x").join(ends.select(F.col("i").alias("y"), F.col("node").alias("b"), F.col("block").alias("q")), "y").where("p <> q")
    swap = F.col("a") > F.col("b")
    apart = two.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("bu"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("bv")).distinct()
    non = cut(own.unionByName(apart).join(edges.select("u", "v"), ["u", "v"], "left_anti"))
    stratum = F.when(F.col("bu") == F.col("bv"), F.col("bu"))  # null: between blocks
    drawn = non.groupBy(stratum.alias("s")).agg(F.count("*").alias("k"))
    links = linked.groupBy(stratum.alias("s")).agg(F.count("*").alias("m"))
    pairs = sizes.select(F.col("block").alias("s"), (F.col("size") * (F.col("size") - 1) / 2).alias("pairs"))
    all_inside = sizes.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("x")).first().x or 0.0
    pairs = pairs.unionByName(spark.createDataFrame([(None, n * (n - 1) / 2 - all_inside)], "s string, pairs double"))
    rate = drawn.join(pairs.withColumnRenamed("s", "ps"), F.col("s").eqNullSafe(F.col("ps"))).join(links.withColumnRenamed("s", "ls"), F.col("s").eqNullSafe(F.col("ls")), "left")
    rate = rate.select(F.col("s").alias("rs"), ((F.col("pairs") - F.coalesce("m", F.lit(0))) / F.col("k")).alias("weight"))
    match = (F.col("bu") == F.col("bv")).cast("int").alias(f"match_{block}")
    zero = non.join(rate, stratum.eqNullSafe(F.col("rs"))).select("u", "v", F.lit(0).alias("edge"), "weight", match)
    return linked.select("u", "v", F.lit(1).alias("edge"), F.lit(1.0).alias("weight"), match).unionByName(zero)


def inference(dyads: DataFrame, estimates: dict[str, float]) -> DataFrame:
    """term, estimate, std_error, z, p: of fit()'s estimates, by the Fisher information of the pseudo-likelihood, one aggregation of its terms' products.

    As always with pseudo-likelihood, they take the pairs as independent.
    """
    terms = [t for t in estimates if t not in ("edges", "deviance", "aic", "bic")]
    x = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    eta = sum((F.lit(float(estimates[t])) * c for t, c in zip(["edges", *terms], x, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-eta))
    w = F.col("weight") * p * (1 - p)
    k = len(x)
    sums = dyads.agg(*[F.sum(w * x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    info = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    error = np.sqrt(np.diag(np.linalg.pinv(info)))
    rows = [(t, float(estimates[t]), float(e), float(estimates[t] / e), math.erfc(abs(estimates[t] / e) / math.sqrt(2))) for t, e in zip(["edges", *terms], error, strict=True)]
    return dyads.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")


def prepared(nodes: DataFrame, numbers: list[str], placeholder: str) -> DataFrame:
    """log1p z-scores (sample deviation) over real vertices, 0 for placeholders: <c>_z."""
    real = z_scores(nodes.where(~F.col(placeholder)), numbers, sample=True, log=True)
    empty = nodes.where(F.col(placeholder)).withColumns({f"{c}_z": F.lit(0.0) for c in numbers})
    return real.unionByName(empty)


def fit(dyads: DataFrame, terms: list[str], max_iter: int = 50) -> dict[str, float]:
    """term -> estimate ('edges' is the intercept), with 'deviance', 'aic' and 'bic'."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=terms, outputCol="__x").transform(dyads.withColumn("edge", F.col("edge").cast("double"))) if terms else None
    if x is None:
        total = dyads.agg(F.sum(F.col("edge") * F.col("weight")).alias("m"), F.sum("weight").alias("n")).first()
        p = total["m"] / total["n"]
        got, n = {"edges": math.log(p / (1 - p))}, total["n"]
        deviance = -2 * (total["m"] * math.log(p) + (n - total["m"]) * math.log(1 - p))
    else:
        model = LogisticRegression(featuresCol="__x", labelCol="edge", weightCol="weight", maxIter=max_iter).fit(x)
        row = model.transform(x).withColumn("__p", vector_to_array("probability")[1]).agg(F.sum(-2 * F.col("weight") * F.when(F.col("edge") == 1, F.ln("__p")).otherwise(F.ln(1 - F.col("__p")))).alias("d"), F.sum("weight").alias("n")).first()
        got, deviance, n = {"edges": float(model.intercept)} | {t: float(c) for t, c in zip(terms, model.coefficients, strict=True)}, row["d"], row["n"]
    k = len(got)
    return got | {"deviance": deviance, "aic": deviance + 2 * k, "bic": deviance + k * math.log(n)}


def ladder(dyads: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """model, term, estimate for a dictionary of formulas, each fitted by itself; a formula that fails has its reason as the term, and no estimate."""
    rows = []
    for name, terms in models.items():
        try:
            rows += [(name, t, float(v)) for t, v in fit(dyads, terms).items()]
        except (ValueError, ZeroDivisionError) as why:
            rows.append((name, f"failed: {why}", None))
    return dyads.sparkSession.createDataFrame(rows, "model string, term string, estimate double")
