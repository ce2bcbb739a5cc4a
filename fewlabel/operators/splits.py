"""Leak-free nested samples drawn in hash order.

Memberships are long tables (replication, budget, id, role, rank); the
unlabelled rest is never copied per replication.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint, hash_key
from ..sources.tables import python_round
from .ranking import hash_bands, hash_draws, hash_rank


# --- budget arithmetic (driver side, a handful of numbers) -------------------


def validation_size(budget: int, fraction: float = 0.2, by_budget: Mapping[int, int] | None = None) -> int:
    if by_budget is not None:
        if budget not in by_budget:
            raise ValueError(f"no validation size for budget {budget}")
        return int(by_budget[budget])
    return python_round(fraction * budget)


def effective_budget(budget: int, fraction: float = 0.2, by_budget: Mapping[int, int] | None = None) -> int:
    return budget - validation_size(budget, fraction, by_budget)


def s_for_rho(rho: float, n_eff: int) -> int:
    return min(max(1, python_round(rho * n_eff)), n_eff - 1)


def s_for_rho_column(rho: Column, n_eff: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n_eff - 1, F.bround(rho * n_eff, 0).cast("long")))


def validation_size_column(budget: Column, fraction: float = 0.2) -> Column:
    return F.bround(F.lit(fraction) * budget, 0).cast("long")


# --- populations -------------------------------------------------------------


def population_split(
    df: DataFrame, id_: str, p0: Column | int, h_scale: Column | int, seed: int, out: str = "split"
) -> DataFrame:
    """h_scale = first rows of the hash order, target = the rest of P0, then unused."""
    order = hash_key(seed, "population", F.col(id_))
    return hash_bands(df, order, id_, [h_scale, p0], ["h_scale", "target", "unused"], out=out)


def split_source(df: DataFrame, source: str) -> DataFrame:
    """Rows of the chosen source: clean (all), h_scale or p_target."""
    wanted = {"clean": None, "h_scale": "h_scale", "p_target": "target"}
    if source not in wanted:
        raise ValueError(f"unknown split source: {source}")
    return df if wanted[source] is None else df.where(F.col("split") == wanted[source])


def sized_fraction(df: DataFrame, fraction: float) -> Column:
    """Row count times a fraction, halves to even, as a scalar of the query."""
    n = df.agg(F.bround(F.count(F.lit(1)) * F.lit(fraction), 0).cast("long").alias("n"))
    return n.scalar()


# --- replicated draws ----------------------------------------------------------


def _draws(df: DataFrame, id_: str, dims: Mapping[str, Sequence[int]], seed: int, salt: str) -> tuple[DataFrame, Column]:
    rows = df
    for name, values in dims.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(int(v)).cast("long") for v in values])))
    return rows, hash_key(seed, *[F.col(n) for n in dims], salt, F.col(id_))


def replication_split(
    df: DataFrame,
    id_: str,
    replications: Sequence[int],
    budget: int,
    stop: int,
    scale: int,
    seed: int,
    max_train: int | None = None,
) -> DataFrame:
    """L of the given size per replication: V_stop, V_scale, then L_prime in train order."""
    if budget <= stop + scale or (max_train or 0) > budget - stop - scale:
        raise ValueError("largest train size exceeds what validation leaves of the budget")
    ranked = hash_draws(df, id_, {"replication": replications}, lambda d: budget, seed, "replication")
    rank = F.col("rank")
    role = F.when(rank <= stop, "V_stop").when(rank <= stop + scale, "V_scale").otherwise("L_prime")
    return ranked.withColumn("role", role).withColumn(
        "train_rank", F.when(rank > stop + scale, rank - (stop + scale))
    )


def allocation_split(
    df: DataFrame,
    id_: str,
    replications: Sequence[int],
    budgets: Sequence[int],
    seed: int,
    fraction: float = 0.2,
    by_budget: Mapping[int, int] | None = None,
) -> DataFrame:
    """Labelled rows per (budget, replication): validation first, then the train order.

    Everything of the source that is not in the result is unlabelled.
    """
    sizes = {b: validation_size(b, fraction, by_budget) for b in budgets}
    for b, v in sizes.items():
        if v <= 0 or b - v <= 1:
            raise ValueError(f"budget {b} leaves no usable labels")
    ranked = hash_draws(df, id_, {"budget": budgets, "replication": replications}, lambda d: d["budget"], seed, "allocation")
    v = F.lit(None).cast("long")
    for b, size in sizes.items():
        v = F.when(F.col("budget") == b, F.lit(size).cast("long")).otherwise(v)
    return (
        ranked.withColumn("validation_size", v)
        .withColumn("n_eff", F.col("budget") - F.col("validation_size"))
        .withColumn("role", F.when(F.col("rank") <= F.col("validation_size"), "validation").otherwise("effective"))
        .withColumn(
            "train_rank",
            F.when(F.col("rank") > F.col("validation_size"), F.col("rank") - F.col("validation_size")),
        )
    )


def nested_train(members: DataFrame, s: int) -> DataFrame:
    return members.where(F.col("train_rank") <= s)


def correction_set(members: DataFrame, s: int | Column) -> DataFrame:
    return members.where(F.col("train_rank") > s)


def frac_split(df: DataFrame, id_: str, seed: int, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """train_pool, validation and evaluation by shares of the row count."""
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("shares must be positive and leave an evaluation part")
    first = sized_fraction(df, train)
    second = first + sized_fraction(df, validation)
    order = hash_key(seed, "fractions", F.col(id_))
    return hash_bands(df, order, id_, [first, second], ["train_pool", "validation", "evaluation"])


def limit_sample(df: DataFrame, id_: str, k: int | None, seed: int) -> DataFrame:
    """First k rows of the hash order; no k, or one beyond the table, keeps all."""
    if k is None or k <= 0:
        return df
    return hash_rank(df, hash_key(seed, "limit", F.col(id_)), id_, k=k).drop("rank")


def train_val_select(
    pool: DataFrame, id_: str, sizes: Sequence[int], replications: Sequence[int], seed: int, min_validation: int
) -> DataFrame:
    """Per (s, replication): first s rows train, all other pool rows validate.

    A size that leaves fewer than ``min_validation`` rows stops the job.
    """
    n = pool.count()
    if unfit := [s for s in sizes if s <= 0 or s + min_validation > n]:
        raise ValueError(f"train sizes {unfit} leave fewer than {min_validation} of {n} rows to validate")
    rows, order = _draws(pool, id_, {"s": sizes, "replication": replications}, seed, "select")
    cut = F.col("s")
    return hash_bands(rows, order, id_, [cut], ["train", "validation"], groups=["s", "replication"], out="role")


def pool_stop_scale_split(
    df: DataFrame, id_: str, replications: Sequence[int], pool: int, stop: int, scale: int, seed: int
) -> DataFrame:
    """Three consecutive bands of one order: train pool, stop and scale validation."""
    ranked = hash_draws(df, id_, {"replication": replications}, lambda d: pool + stop + scale, seed, "bands")
    rank = F.col("rank")
    role = F.when(rank <= pool, "train_pool").when(rank <= pool + stop, "stop").otherwise("scale")
    return ranked.withColumn("role", role).withColumn("train_rank", F.when(rank <= pool, rank))


def screening_sample(df: DataFrame, id_: str, n_pairs: int, n_eval: int, seed: int) -> DataFrame:
    """n_pairs - n_eval rows of h_scale as train_pool and n_eval of target as evaluation."""
    if not 0 < n_eval < n_pairs:
        raise ValueError("n_eval must be positive and smaller than n_pairs")
    n_train = n_pairs - n_eval

    def part(split: str, k: int, label: str, first: int) -> DataFrame:
        rows = df.where(F.col("split") == split)
        ranked = hash_rank(rows, hash_key(seed, label, F.col(id_)), id_, k=k)
        return (
            ranked.withColumn("screen_split", F.lit(label))
            .withColumn("screen_row_id", F.col("rank") - 1 + first)
            .drop("rank")
        )

    return part("h_scale", n_train, "train_pool", 0).unionByName(part("target", n_eval, "evaluation", n_train))


def group_split(df: DataFrame, group: str, cuts: Sequence[float], labels: Sequence[str], seed: int) -> DataFrame:
    """All rows of a group on one side: groups in hash order, cut by cumulative rows.

    Only the groups (one pre-aggregated row each) are ordered, bucket by bucket;
    a group is placed by the share of rows that comes before it.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    keyed = sizes.withColumn("__hash", hash_key(seed, "group", F.col(group)))
    keyed = keyed.withColumn("__bucket", F.substring("__hash", 1, 3))
    totals = keyed.groupBy("__bucket").agg(F.sum("__size").alias("__rows"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn(
        "__all", F.sum("__rows").over(whole)
    )
    inside = W.partitionBy("__bucket").orderBy("__hash", group).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.join(F.broadcast(offsets.drop("__rows")), "__bucket").withColumn(
        "__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__off")
    )
    label = F.lit(labels[-1])
    for cut, name in reversed(list(zip(cuts, labels))):
        label = F.when(F.col("__before") < F.lit(cut) * F.col("__all"), F.lit(name)).otherwise(label)
    return df.join(placed.select(group, label.alias("split")), group)


def balanced_sample(
    df: DataFrame, id_: str, k: int, seed: int, strategy: str, value: str | None = None, strata: int = 4
) -> DataFrame:
    """k rows, taken evenly from the strata of a value; uniform ignores the value.

    target_nonzero_balanced: strata by the sign of the target feature.
    target_if_weight_balanced: strata by quantiles of the absolute weight.
    A stratum that runs out hands its share to the others.
    """
    order = hash_key(seed, "balanced", F.col(id_))
    if strategy == "uniform":
        return hash_rank(df, order, id_, k=k).withColumn("stratum", F.lit(0)).drop("rank")
    if strategy == "target_nonzero_balanced":
        stratum = F.signum(F.col(value)).cast("int")
    elif strategy == "target_if_weight_balanced":
        from .quantiles import exact_quantiles

        cuts = exact_quantiles(df, F.abs(F.col(value)), [i / strata for i in range(1, strata)])
        stratum = F.lit(0)
        for cut in cuts:
            stratum = stratum + F.when(F.abs(F.col(value)) > F.lit(cut), 1).otherwise(0)
    else:
        raise ValueError(f"unknown sampling strategy: {strategy}")
    rows = df.withColumn("stratum", stratum)
    # No stratum can need more than k rows, so at most strata * k rows are ranked together.
    ranked = hash_rank(rows, order, id_, ["stratum"], out="__turn", k=k)
    turn = W.orderBy("__turn", "stratum")
    return ranked.withColumn("__r", F.row_number().over(turn)).where(F.col("__r") <= k).drop("__r", "__turn")


def kfold(id_: Column, folds: int, seed: int) -> Column:
    """Fold 0..K-1 of a row from its hash alone."""
    number = F.conv(F.substring(hash_key(seed, "fold", id_), 1, 15), 16, 10).cast("long")
    return F.pmod(number, F.lit(folds)).cast("long")


# --- audits -----------------------------------------------------------------------


def leakage_audit(
    members: DataFrame, id_: str, keys: Sequence[str], sizes: Mapping[str, int], source: DataFrame | None = None, whole: str | None = None
) -> DataFrame:
    """One report row per key, counted over ids; ``passed`` says that every check holds.

    ``sizes`` names the roles and the number of ids each must have. ``whole``
    names a role that must hold exactly the ids of all the others (a population
    that is cut in two, a labelled set that is dealt out); without it an id has
    one role. The train order must run from one without gaps or ties, so that
    every smaller train set is its beginning and lies inside the larger ones.
    ``source`` lists the ids there are.
    """
    parts = [r for r in sizes if r != whole]
    held = {r: F.col(f"__{r}") for r in sizes}
    per_id = members.groupBy(*keys, id_).agg(
        *[F.count(F.when(F.col("role") == r, 1)).alias(f"__{r}") for r in sizes],
        F.count(F.when(~F.col("role").isin(*sizes), 1)).alias("__other"),
        F.max("train_rank").alias("__rank"),
        F.count_distinct("train_rank").alias("__ranks"),
    )
    if source is not None:
        per_id = per_id.join(source.select(id_, F.lit(True).alias("__known")).distinct(), id_, "left")
    else:
        per_id = per_id.withColumn("__known", F.lit(True))
    in_parts = sum([(held[r] > 0).cast("int") for r in parts], F.lit(0))
    outside = (in_parts > 0) != (held[whole] > 0) if whole else F.lit(False)
    report = per_id.groupBy(*keys).agg(
        F.count("*").alias("n_ids"),
        F.sum(sum([F.greatest(c - 1, F.lit(0)) for c in held.values()], F.lit(0))).alias("repeated"),
        F.count(F.when(in_parts > 1, 1)).alias("overlapping"),
        F.count(F.when(outside, 1)).alias("not_dealt"),
        F.count(F.when(F.col("__known").isNull(), 1)).alias("unknown_ids"),
        F.count(F.when(F.col("__other") > 0, 1)).alias("stray_roles"),
        *[F.count(F.when(c > 0, 1)).alias(f"n_{r}") for r, c in held.items()],
        (F.coalesce(F.max("__rank"), F.lit(0)) - F.count_distinct("__rank")).alias("order_gaps"),
        (F.count("__rank") - F.count_distinct("__rank") + F.sum(F.greatest(F.col("__ranks") - 1, F.lit(0)))).alias("order_ties"),
    )
    faults = ["repeated", "overlapping", "not_dealt", "unknown_ids", "stray_roles", "order_gaps", "order_ties"]
    fine = sum([(F.col(f) != 0).cast("int") for f in faults] + [(F.col(f"n_{r}") != n).cast("int") for r, n in sizes.items()], F.lit(0)) == 0
    return report.withColumn("passed", fine)


def require_passed(report: DataFrame) -> DataFrame:
    """Fail the job when any audit row fails."""
    return report.withColumn(
        "passed",
        F.when(F.col("passed"), True).otherwise(F.raise_error(F.lit("leakage audit failed")).cast("boolean")),
    )


def split_manifest(members: DataFrame, id_: str, keys: Sequence[str]) -> DataFrame:
    """Count and order-free digest of the ids, per key and role.

    xor and sum of 60-bit hashes replace hashing a sorted list, so no group is
    ever gathered in one place.
    """
    h = fingerprint(F.col(id_))
    return members.groupBy(*keys, "role").agg(
        F.count(F.lit(1)).alias("n"), *_digests(h), F.min(id_).alias("min_id"), F.max(id_).alias("max_id")
    )


def _digests(h: Column) -> tuple[Column, Column]:
    """xor, and sum modulo 2**60 (in which ids that occur twice don't vanish)."""
    return F.bit_xor(h).alias("ids_xor"), (F.sum(h.cast("decimal(38,0)")) % F.lit(1 << 60)).cast("long").alias("ids_sum")


def ids_hash(df: DataFrame, id_: str, keys: Sequence[str] = ()) -> DataFrame:
    h = fingerprint(F.col(id_))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_digests(h))


def distinct_texts(df: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty normalised texts, with the first place they occur at.

    The place is (column number, row id); ids are unique. Narrow rows (hash of
    the text, place) are reduced to the least place per hash, before and after
    their shuffle; then the texts of those places are fetched by a join on the
    place, so that no text is a shuffle key and only one copy of each is kept.
    """
    from ..functions.text import normalize_text

    pieces = F.array(
        *[F.struct(F.lit(i).alias("pos"), normalize_text(F.col(c)).alias("text")) for i, c in enumerate(columns)]
    )
    # a plain explode would have the texts normalised once more, by the filter the planner derives from it
    rows = df.select(id_, F.explode_outer(pieces).alias("p")).select(id_, "p.pos", "p.text").where(F.col("text") != "")
    place = F.struct("pos", id_)
    first = rows.groupBy(F.md5("text").alias("h")).agg(F.min(place).alias("f")).select(F.col("f.pos").alias("first_column"), F.col(f"f.{id_}").alias("first_id"))
    found = rows.join(first, (rows["pos"] == first["first_column"]) & (rows[id_] == first["first_id"]))
    return found.select("text", "first_column", "first_id")


# --- grids ------------------------------------------------------------------------


def cell_grid(df: DataFrame, dims: Mapping[str, Sequence], index: str | None = "task_index") -> DataFrame:
    """All combinations of the listed values, numbered with the last one fastest.

    ``df`` supplies the rows to combine with (one row for a plain grid).
    """
    out = df
    place = F.lit(0).cast("long")
    for name, values in dims.items():
        items = F.array(*[F.lit(v) for v in values])
        out = out.select("*", F.posexplode(items).alias(f"__{name}", name))
        place = place * len(values) + F.col(f"__{name}")
    if index:
        out = out.withColumn(index, place)
    return out.drop(*[f"__{n}" for n in dims])


def pending_cells(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def require_complete(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = pending_cells(plan, done, keys).limit(20).collect()
    if missing:
        raise FileNotFoundError(f"missing cells, first: {[r.asDict() for r in missing]}")
    return done


def candidate_union(grid: DataFrame, theory: DataFrame, keys: Sequence[str], rho: str = "rho", tol: float = 1e-10) -> DataFrame:
    """Grid cells plus theory cells whose rho is not on the grid within ``tol``."""
    near = grid.select(*keys, F.col(rho).alias("__grid_rho"))
    joined = theory.alias("t").join(
        near.alias("g"),
        on=[F.col(f"t.{k}") == F.col(f"g.{k}") for k in keys]
        + [F.abs(F.col(f"t.{rho}") - F.col("g.__grid_rho")) <= tol],
        how="left_anti",
    )
    return grid.unionByName(joined, allowMissingColumns=True)
