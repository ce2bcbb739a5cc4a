"""Surrogate scaling on text and embeddings.

Text surrogates: all (replication, s) are fitted together by conjugate
gradients from sums over the stored train rows; the coefficients meet the validation rows
in a grouped join, and all sets are judged by sums. Embedding surrogates: fitted and
judged from moment matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import influence as I
from ..operators.moments import Moments, collect_moments, gram_vectors, moments_of, unpack
from ..operators.quantiles import exact_quantiles_of
from ..operators.sparse_ridge import Fit, Sparse, sparse_ridge_fits
from ..operators.splits import pool_stop_scale_split
from ..operators.surrogate import ifvar_of, mse_of, ridge_path
from ..operators.terms import term_counts, tfidf, vocabulary
from ..session import materialise

FIT_SCHEMA = "replication long, s long, fit string, feature string, alpha double, place int, intercept double, coef array<double>"
JUDGED_SCHEMA = (
    "replication long, s long, fit string, feature string, alpha double, place int, judged string, role string, "
    "n long, rr double, ar double, aarr double"
)
ROWS_AT_ONCE = 4096  # of the validation sets, in one task
FIT_NUMBERS = 1_000_000  # of coefficients that the driver stores at once

# Sizes of the train pool and of the two validation sets.
POOL, STOP, SCALE = 5000, 1000, 2000

#: The fit behind each objective, and whether it stops by the MSE.
OBJECTIVES = {
    "mse": ("plain", True),
    "mse_stop_ifvar": ("plain", False),
    "ifvar_weighted": ("ifvar_weighted", False),
    "ifvar_exact": ("ifvar_exact", False),
}


def text_cells(
    texts: DataFrame,
    id_: str,
    terms: str,
    y: str,
    weights: Column,
    replications: Sequence[int],
    seed: int,
    pool: int = POOL,
    stop: int = STOP,
    scale: int = SCALE,
    max_features: int = 20_000,
    min_df: int = 2,
) -> tuple[DataFrame, int]:
    """Labelled texts as sparse TF-IDF rows dealt to the roles of each replication, and the number of columns.

    ``weights`` is an array with one IF weight per target. Every replication
    deals out pool + stop + scale texts anew; fewer texts stop the job.
    """
    n = texts.count()
    if n < pool + stop + scale:
        raise ValueError(f"{n} labelled texts for {pool} + {stop} + {scale} in the pool, stop and scale sets")
    counts = term_counts(texts, id_, terms)
    vocab = materialise(vocabulary(counts, n, max_features, min_df), "vocabulary")
    sparse = tfidf(counts, id_, vocab)
    mean = texts.agg(F.avg(y).alias("m")).scalar()
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    rows = texts.select(id_, F.col(y).alias("y"), weights.alias("a"), mean.alias("base"))
    members = pool_stop_scale_split(texts.select(id_), id_, replications, pool, stop, scale, seed)
    # the narrow side is hashed and the vectors stream by: they are never sorted
    cells = members.join(rows, id_).hint("shuffle_hash").join(sparse, id_, "left")
    cells = cells.withColumns({"idx": F.coalesce("idx", empty[0]), "val": F.coalesce("val", empty[1])}).withColumnRenamed(id_, "id")
    return materialise(cells, "cells"), vocab.count()


def surrogate_fits(
    rows: DataFrame, features: Sequence[str], n_columns: int, s_grid: Sequence[int], alphas: Sequence[float], clip: float | None, kinds: Sequence[str]
) -> DataFrame:
    """Coefficients of every (replication, s, kind of fit, feature, alpha).

    All are solved together over the stored train rows: a task holds one block
    of them at a time, whatever s is.
    """
    spark, names = rows.sparkSession, list(features)
    train = rows.where("role = 'train_pool'").select(F.col("replication").alias("group"), F.col("train_rank").alias("rank"), "y", "a", "idx", "val")
    first = {r["group"]: r["rank"] for r in train.groupBy("group").agg(F.min("rank").alias("rank")).collect()}
    cells = [(rep, int(s)) for rep in sorted(first) for s in sorted(set(s_grid)) if s > 0 and s >= first[rep]]
    squares = {}
    if "ifvar_weighted" in kinds:
        for rep, s in cells:
            mine = (F.col("group") == rep) & (F.col("rank") <= s)
            squares |= {(rep, s, j): F.when(mine, F.col("a")[j] * F.col("a")[j]) for j in range(len(names))}
    weights = square_weights(train, squares, clip)
    wanted = []
    for rep, s in cells:
        wanted += [("plain", "", Fit(rep, s))] if "plain" in kinds else []
        for j, name in enumerate(names):
            if "ifvar_weighted" in kinds:
                wanted.append(("ifvar_weighted", name, Fit(rep, s, "weighted", j, *weights[rep, s, j])))
            if "ifvar_exact" in kinds:
                wanted.append(("ifvar_exact", name, Fit(rep, s, "exact", j)))
    fields = ["replication", "s", "fit", "feature", "alpha", "place", "intercept", "coef"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
    out, held = [], []

    def store() -> None:
        table = pa.table({f: pa.array(list(v), t) for f, v, t in zip(fields, zip(*held), types)})
        out.append(materialise(spark.createDataFrame(table, FIT_SCHEMA), "fits"))
        held.clear()

    solved = sparse_ridge_fits(train, [f for *_, f in wanted], n_columns, alphas) if wanted else ()
    for (kind, name, f), (_, path) in zip(wanted, solved):
        held += [(f.group, f.last, kind, name, float(alphas[k]), k, float(path[0, k]), path[1:, k]) for k in range(len(alphas))]
        if len(held) * (n_columns + 1) > FIT_NUMBERS:
            store()
    if held:
        store()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FIT_SCHEMA)


def square_weights(train: DataFrame, squares: Mapping[tuple, Column], clip: float | None) -> dict[tuple, tuple[float | None, float]]:
    """Cap (none, or a positive quantile) and mean of the capped values of each column of squared IF weights."""
    if not squares:
        return {}
    caps = dict.fromkeys(squares)
    if clip is not None and 0 < clip < 1:
        found = exact_quantiles_of(train, {str(k): c for k, c in squares.items()}, [clip])
        caps = {k: q if (q := found[str(k)][0]) is not None and q > 0 else None for k in squares}
    # least would pass over the nulls of other rows
    means = train.agg(*[F.avg(c if caps[k] is None else F.when(c > caps[k], caps[k]).otherwise(c)) for k, c in squares.items()]).first()
    return {k: (caps[k], means[i]) for i, k in enumerate(squares)}


def judged_fits(rows: DataFrame, fits: DataFrame, features: Sequence[str], n_columns: int) -> DataFrame:
    """Of every fit, per feature it is judged for and validation role: n and the sums of r^2, a r and (a r)^2.

    Validation rows are dealt to chunks of about ``ROWS_AT_ONCE``, each of which
    meets the coefficients of its replication; a fit common to all features is
    judged for each of them in the same pass, by its weights. The sums are added
    up natively.
    """
    names = list(features)
    held = rows.where("role in ('stop', 'scale')").select("id", "replication", "role", "y", "a", "idx", "val")
    most = held.groupBy("replication").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-int(most) // ROWS_AT_ONCE))
    held = held.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).drop("id")
    spread = fits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x = Sparse.of(left.column("idx"), left.column("val"), n_columns)
            y, a = np.asarray(left.column("y")), np.array(left.column("a").to_pylist(), float)
            role = np.array(left.column("role").to_pylist())
            for start in range(0, right.num_rows, 64):
                fit = right.slice(start, 64)
                coef = np.array([c or [0.0] * n_columns for c in fit.column("coef").to_pylist()], float).T.reshape(n_columns, -1)
                r = y[:, None] - np.asarray(fit.column("intercept")) - x.dot(coef)
                head = fit.select(["replication", "s", "fit", "feature", "alpha", "place"]).to_pylist()
                for k, h in enumerate(head):
                    for j, name in enumerate(names):
                        if h["feature"] in ("", name):
                            for which in ("stop", "scale"):
                                e = r[role == which, k]
                                ae = a[role == which, j] * e
                                out.append({**h, "judged": name, "role": which, "n": len(e), "rr": float(e @ e), "ar": float(ae.sum()), "aarr": float(ae @ ae)})
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 3]
        fields = ["replication", "s", "fit", "feature", "alpha", "place", "judged", "role", "n", "rr", "ar", "aarr"]
        return pa.table({f: pa.array([o[f] for o in out], t) for f, t in zip(fields, kinds)})

    keys = ["replication", "chunk"]
    parts = held.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(judge, JUDGED_SCHEMA)
    by = ["replication", "s", "fit", "feature", "alpha", "place", "judged", "role"]
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "rr", "ar", "aarr")])


def surrogate_scaling(
    rows: DataFrame,
    features: Sequence[str],
    n_columns: int,
    s_grid: Sequence[int],
    alphas: Sequence[float],
    clip: float | None = 0.99,
    objectives: Sequence[str] = tuple(OBJECTIVES),
) -> DataFrame:
    """IF variance of each surrogate per (replication, s, feature, objective).

    ``rows`` are labelled rows with id, replication, role (train_pool, stop,
    scale), train_rank, y, base (the constant prediction), ``a`` (one weight per
    feature) and sparse text columns idx, val. s = 0 is the constant.
    Strictly smaller wins among the alphas, so the first keeps a tie.
    """
    kinds = list(dict.fromkeys(OBJECTIVES[o][0] for o in objectives))
    fits = surrogate_fits(rows, features, n_columns, s_grid, alphas, clip, kinds)
    if 0 in s_grid:
        constant = rows.groupBy("replication").agg(F.max("base").alias("intercept"))
        fits = fits.unionByName(constant.selectExpr("replication", "0L AS s", "'constant' AS fit", "'' AS feature", "CAST(NULL AS double) AS alpha", "0 AS place", "intercept", "CAST(array() AS array<double>) AS coef"))
    sums = judged_fits(rows, fits, features, n_columns)
    n, ar, aarr = F.col("n"), F.col("ar"), F.col("aarr")
    variance = F.when(n > 1, F.greatest(aarr - ar * ar / n, F.lit(0.0)) / (n - 1))
    scores = sums.withColumns({"mse": F.col("rr") / n, "ifvar": variance})
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    by = ["replication", "s", "fit", "judged", "alpha", "place"]
    wide = scores.groupBy(*by).agg(of("stop", "mse").alias("stop_mse"), of("stop", "ifvar").alias("stop_ifvar"), of("scale", "ifvar").alias("ifvar"))
    uses = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(o).alias("name"), F.lit(by_mse).alias("by_mse")) for o, (kind, by_mse) in {**{o: OBJECTIVES[o] for o in objectives}, "constant": ("constant", True)}.items()])
    tried = wide.withColumn("o", F.explode(F.filter(uses, lambda o: o["kind"] == F.col("fit"))))
    # the plain objective does not look at the weights when it stops
    shown = F.when(F.col("o.by_mse"), F.col("stop_mse")).otherwise(F.col("stop_ifvar"))
    first = W.partitionBy("replication", "s", "judged", "o.name").orderBy("shown", "place")
    best = tried.withColumn("shown", shown).withColumn("turn", F.row_number().over(first)).where("turn = 1")
    fitted = F.col("fit") != "constant"
    chosen = best.select(
        "replication",
        "s",
        F.col("judged").alias("feature"),
        F.col("o.name").alias("training_objective"),
        "ifvar",
        F.col("alpha").alias("selected_alpha"),
        F.when(fitted, F.col("stop_mse")).alias("stop_mse"),
        F.when(fitted, F.col("shown")).alias("stop_ifvar"),
    )
    zero = F.max(F.when(F.col("s") == 0, F.col("ifvar"))).over(W.partitionBy("replication", "feature"))
    return chosen.withColumn("__0", zero).withColumn("ifvar_ratio_to_s0", F.when(F.col("__0") > 0, F.col("ifvar") / F.col("__0"))).drop("__0")


@dataclass(frozen=True)
class ScreenMethod:
    name: str
    weighted: bool
    stop: str


# The ridge heads compared in the embedding screen.
SCREEN_METHODS = (
    ScreenMethod("ridge_mse_stop_mse", False, "mse"),
    ScreenMethod("ridge_mse_stop_ifvar", False, "ifvar"),
    ScreenMethod("ridge_ifweighted_stop_ifvar", True, "ifvar"),
)


def parse_method(text: str) -> ScreenMethod:
    """name:objective:stop_metric to a method."""
    known = {m.name: m for m in SCREEN_METHODS}
    if text in known:
        return known[text]
    parts = text.split(":")
    if len(parts) != 3:
        raise ValueError(f"a custom method is name:objective:stop_metric, got {text}")
    return ScreenMethod(parts[0], parts[1] != "mse", parts[2])


def _cells(sums: DataFrame, names: Sequence[str]) -> Iterator[tuple[int, int, dict[tuple, Moments]]]:
    """(s, replication, moments by target and kind), one cell after the other: the driver holds the matrices of one."""
    place, held = None, {}
    for r in sums.orderBy("s", "replication").toLocalIterator():
        if place not in (None, (r["s"], r["replication"])):
            yield (*place, held)
            held = {}
        place = (r["s"], r["replication"])
        held[r["target"], r["kind"]] = Moments(tuple(names), int(r["n"]), unpack(r["zz"], len(names)))
    if place:
        yield (*place, held)


def embedding_screen(
    rows: DataFrame,
    id_: str,
    vector: str,
    dim: int,
    y: str,
    targets: Mapping[str, Sequence[str]],
    s_grid: Sequence[int],
    replications: Sequence[int],
    alphas: Sequence[float],
    seed: int,
    min_validation: int,
    ridge: float = 1e-6,
    methods: Sequence[ScreenMethod] = SCREEN_METHODS,
) -> tuple[DataFrame, DataFrame]:
    """Result rows and target diagnostics of the embedding surrogates.

    ``rows`` has screen_split (train_pool, evaluation), the standardised vector,
    y and the regressors; ``targets`` maps each target to its controls. Weights
    come from the evaluation rows and are applied to all rows.
    """
    from dataclasses import replace

    from ..operators.splits import train_val_select

    spark = rows.sparkSession
    evaluation = rows.where(F.col("screen_split") == "evaluation")
    cols = sorted({c for t, cs in targets.items() for c in [t, *cs]})
    m = moments_of(evaluation, cols, y)[()]
    rule = replace(I.RIDGE_RULES["headline_embedding"], ridge=ridge)
    fits = {t: I.fit_ols(m, t, [t, *cs], y, rule) for t, cs in targets.items()}
    stats = I.influence_table(evaluation, fits, y, ddof=0)
    diagnostics = I.fit_table(evaluation, fits).join(F.broadcast(stats), "fit")
    names = ["1", *[f"e{i}" for i in range(dim)], "y"]
    z = F.concat(F.array(F.lit(1.0)), F.transform(vector, lambda v: v.cast("double")), F.array(F.col(y).cast("double")))
    weights = F.array(*[F.struct(F.lit(t).alias("target"), I.if_weight(f).alias("a")) for t, f in fits.items()])

    def with_kinds(df: DataFrame) -> DataFrame:
        """One row per weighting: none, and per target a and a squared."""
        plain = F.array(F.struct(F.lit("").alias("target"), F.lit("plain").alias("kind"), F.lit(1.0).alias("w")))
        per = F.flatten(
            F.transform(
                "weights",
                lambda q: F.array(
                    F.struct(q["target"].alias("target"), F.lit("first").alias("kind"), q["a"].alias("w")),
                    F.struct(q["target"].alias("target"), F.lit("squared").alias("kind"), (q["a"] * q["a"]).alias("w")),
                ),
            )
        )
        return df.withColumn("k", F.explode(F.concat(plain, per))).select("*", "k.target", "k.kind", "k.w")

    base = rows.select(id_, "screen_split", z.alias("z"), weights.alias("weights"))
    pool = base.where(F.col("screen_split") == "train_pool")
    roles = train_val_select(pool.select(id_), id_, s_grid, replications, seed, min_validation)
    # a validation set is the pool less its train rows, so only these (at most the
    # sizes added up, whatever the pool) are copied per cell; both splits in one pass
    by = ["s", "replication", "target", "kind"]
    chosen = with_kinds(pool.join(roles.where("role = 'train'"), id_))
    train_sums = gram_vectors(chosen.select(*by, "z", "w"), dim + 2, by)
    over = ["screen_split", "target", "kind"]
    totals = collect_moments(gram_vectors(with_kinds(base).select(*over, "z", "w"), dim + 2, over), names, over)
    held, whole = ({k[1:]: v for k, v in totals.items() if k[0] == split} for split in ("evaluation", "train_pool"))
    xs = names[1:-1]
    out = []
    zero = {}
    for t in targets:
        nothing = np.zeros(dim + 1)
        zero[t] = ifvar_of(nothing, held[(t, "squared")], held[(t, "first")], xs, "y", 0)
        out.append((t, "zero_surrogate", -1, 0, None, mse_of(nothing, held[("", "plain")], xs, "y"), zero[t], 1.0))
    for s, rep, part in _cells(train_sums, names):
        train = part["", "plain"]
        valid = whole["", "plain"] - train
        for t in targets:
            weighted = part[t, "squared"]
            share = max(weighted.weight / weighted.n, 1e-12)
            scaled = Moments(weighted.names, weighted.n, weighted.m / share)
            sq, fi = (whole[t, kind] - part[t, kind] for kind in ("squared", "first"))
            for method in methods:
                fit_on = scaled if method.weighted else train
                extra = (sq, fi) if method.stop == "ifvar" else (None, None)
                beta, alpha, *_ = ridge_path(fit_on, valid, xs, "y", alphas, *extra, ddof=0)
                ifvar = ifvar_of(beta, held[(t, "squared")], held[(t, "first")], xs, "y", 0)
                ratio = ifvar / zero[t] if zero[t] > 0 else None
                out.append((t, method.name, int(rep), int(s), alpha, mse_of(beta, held[("", "plain")], xs, "y"), ifvar, ratio))
    results = spark.createDataFrame(
        out, "target string, method string, replication long, s long, alpha double, mse double, ifvar double, ifvar_ratio_vs_zero double"
    )
    direct = diagnostics.select("target", F.col("if_var").alias("direct_ols_ifvar"))
    results = results.join(F.broadcast(direct), "target").withColumn(
        "ifvar_ratio_vs_direct_ols", F.when(F.col("direct_ols_ifvar") > 0, F.col("ifvar") / F.col("direct_ols_ifvar"))
    )
    return results, diagnostics
