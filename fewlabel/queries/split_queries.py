"""Joins, samples, splits, audits and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import splits as X
from ..plans import populations as POP
from . import sqlparts as S
from .data import load
from .project_queries import orders_split, vector_pairs
from .registry import query, rounded, shaped, sql_shaped

BUDGETS = (300, 500, 700, 1000)
REPS = tuple(range(5))
FP = "('0x' || substr(md5({x}::VARCHAR), 1, 15))::BIGINT"


def orders(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))


def replicated(spark, sf):
    return X.replication_split(orders(spark, sf), "id", REPS, 1000, 150, 250, seed=23)


def allocated(spark, sf):
    return X.allocation_split(orders(spark, sf), "id", REPS, BUDGETS, seed=29)


_REPS = "(SELECT unnest(range(5)) AS replication)"
REPL = f"""repl AS (SELECT replication, id, rank, CASE WHEN rank <= 150 THEN 'V_stop' WHEN rank <= 400 THEN 'V_scale' ELSE 'L_prime' END AS role,
  CASE WHEN rank > 400 THEN rank - 400 END AS train_rank FROM (
  SELECT replication, o_orderkey AS id, row_number() OVER (PARTITION BY replication ORDER BY md5(concat_ws(':', 23, replication, 'replication', o_orderkey)), o_orderkey) AS rank
  FROM orders, {_REPS}) WHERE rank <= 1000)"""
ALLOC = f"""alloc AS (SELECT budget, replication, id, rank, v AS validation_size, budget - v AS n_eff,
  CASE WHEN rank <= v THEN 'validation' ELSE 'effective' END AS role, CASE WHEN rank > v THEN rank - v END AS train_rank FROM (
  SELECT *, round_even(0.2 * budget, 0)::BIGINT AS v FROM (
  SELECT budget, replication, o_orderkey AS id, row_number() OVER (PARTITION BY budget, replication ORDER BY md5(concat_ws(':', 29, budget, replication, 'allocation', o_orderkey)), o_orderkey) AS rank
  FROM orders, {_REPS}, (VALUES (300), (500), (700), (1000)) AS b(budget))) WHERE rank <= budget)"""


# --- joins ------------------------------------------------------------------------


@query(
    "subset_by_ids",
    sql_shaped(f"WITH {REPL} SELECT id, rank, role AS split_role, o_totalprice AS y_raw, (o_totalprice - 90) / 5 AS y_scaled FROM repl JOIN orders ON id = o_orderkey WHERE replication = 0 AND role = 'V_scale'", ["id", "rank", "split_role"], ["y_raw", "y_scaled"]),
)
def subset_by_ids(spark, sf):
    members = replicated(spark, sf).where((F.col("replication") == 0) & (F.col("role") == "V_scale"))
    out = J.subset_by_ids(members.select("id", "rank"), orders(spark, sf), "id", "V_scale", "y")
    return shaped(out, ["id", "rank", "split_role"], ["y_raw", "y_scaled"])


@query("semi_population", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_population(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return J.semi_population(docs, load(spark, sf, "labels"), "doc_id")


@query("anti_remainder", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_remainder(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return J.anti_remainder(docs, load(spark, sf, "labels"), "doc_id")


# One cell per customer nation x order status x priority; finished = has an order.
_PLAN = """plan AS (SELECT nation, status, rho, ((nation_pos * 3 + s_pos) * 4 + r_pos)::BIGINT AS task_index FROM
  (SELECT n_nationkey AS nation, n_nationkey AS nation_pos FROM nation),
  (VALUES ('F', 0), ('O', 1), ('P', 2)) AS s(status, s_pos), (VALUES (0.05, 0), (0.1, 1), (0.3, 2), (0.5, 3)) AS r(rho, r_pos))"""


def cell_plan(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))
    plan = X.cell_grid(n, {"status": ["F", "O", "P"], "rho": [0.05, 0.1, 0.3, 0.5]}, index="__in")
    return plan.withColumn("task_index", F.col("nation") * 12 + F.col("__in")).drop("__in")


def finished_cells(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.col("o_orderstatus").alias("status"))
    # a cell counts as finished if it has an even number of orders: all of them are read
    return cells.agg(F.count("*").alias("n"), F.avg(F.col("o_totalprice") / 1000).alias("runtime_seconds")).where(F.col("n") % 2 == 0)


@query("cell_grid", f"WITH {_PLAN} SELECT nation::BIGINT AS nation, status, rho::DOUBLE AS rho, task_index FROM plan")
def cell_grid(spark, sf):
    return cell_plan(spark, sf)


@query(
    "pending_cells",
    f"""WITH {_PLAN} SELECT nation::BIGINT AS nation, status, rho::DOUBLE AS rho, task_index FROM plan WHERE (nation, status) NOT IN
    (SELECT (c_nationkey, o_orderstatus) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderstatus HAVING count(*) % 2 = 0)""",
)
def pending_cells(spark, sf):
    return X.pending_cells(cell_plan(spark, sf), finished_cells(spark, sf), ["nation", "status"])


@query(
    "progress_eta",
    f"""WITH {_PLAN}, done AS (SELECT c_nationkey AS nation, o_orderstatus AS status, avg(o_totalprice / 1000) AS runtime FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) % 2 = 0)
    SELECT status AS method, count(runtime)::BIGINT AS completed, count(*)::BIGINT AS total, round(avg(runtime), 6) AS mean_runtime,
      round((count(*) - count(runtime)) * avg(runtime) / 3600, 6) AS remaining_hours FROM plan LEFT JOIN done USING (nation, status) GROUP BY status""",
)
def progress_eta(spark, sf):
    from ..operators.screening import progress_eta as eta

    out = eta(cell_plan(spark, sf).withColumn("method", F.col("status")), finished_cells(spark, sf).drop("n"), ["nation", "status"], "method")
    return shaped(out, ["method", "completed", "total"], ["mean_runtime", "remaining_hours"])


CURVE_SQL = "(SELECT p_brand AS feature, p_size::BIGINT * 20 AS s, avg(p_retailprice) / (p_size + 0.37) AS ifvar FROM part GROUP BY p_brand, p_size)"


def part_curve(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") * 20).cast("long").alias("s"), "p_size").agg(
        F.avg("p_retailprice").alias("m")
    ).select("feature", "s", (F.col("m") / (F.col("p_size") + 0.37)).alias("ifvar"))


@query(
    "budget_feasible_join",
    sql_shaped(f"SELECT feature, s, budget::BIGINT AS budget, ifvar / (budget - s) AS proxy FROM {CURVE_SQL} JOIN (VALUES (300), (500), (1000)) AS b(budget) ON s < budget", ["feature", "s", "budget"], ["proxy"]),
)
def budget_feasible_join(spark, sf):
    rows = J.budget_feasible(part_curve(spark, sf), (300, 500, 1000))
    return shaped(rows.withColumn("proxy", F.col("ifvar") / (F.col("budget") - F.col("s"))), ["feature", "s", "budget"], ["proxy"])


@query(
    "direct_lookup",
    sql_shaped(f"SELECT feature, s, ifvar, direct AS direct_ifvar FROM {CURVE_SQL} LEFT JOIN (SELECT p_brand AS feature, var_samp(p_retailprice) AS direct FROM part GROUP BY 1) USING (feature)", ["feature", "s"], ["ifvar", "direct_ifvar"]),
)
def direct_lookup(spark, sf):
    direct = load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.var_samp("p_retailprice").alias("direct_ifvar"))
    return shaped(J.lookup(part_curve(spark, sf), direct, "feature"), ["feature", "s"], ["ifvar", "direct_ifvar"])


@query(
    "metadata_lookup",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def metadata_lookup(spark, sf):
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = load(spark, sf, "region").select("r_regionkey", "r_name")
    out = J.lookup(J.lookup(load(spark, sf, "customer"), nation, "c_nationkey"), region, "r_regionkey")
    return out.select("c_custkey", "n_name", "r_name")


@query(
    "summary_enrich",
    sql_shaped(
        f"""WITH c AS {CURVE_SQL}, base AS (SELECT feature, count(*)::BIGINT AS n_s FROM c GROUP BY 1),
        best AS (SELECT feature, min(ifvar) AS best FROM c GROUP BY 1), zero AS (SELECT feature, avg(ifvar) AS zero FROM c WHERE s <= 100 GROUP BY 1),
        win AS (SELECT feature, min(s)::BIGINT AS first_win FROM c WHERE ifvar < 25 GROUP BY 1)
        SELECT feature, n_s, first_win, best, zero, best / zero AS ratio FROM base LEFT JOIN best USING (feature) LEFT JOIN zero USING (feature) LEFT JOIN win USING (feature)""",
        ["feature", "n_s", "first_win"],
        ["best", "zero", "ratio"],
    ),
)
def summary_enrich(spark, sf):
    c = part_curve(spark, sf)
    base = c.groupBy("feature").agg(F.count(F.lit(1)).alias("n_s"))
    best = c.groupBy("feature").agg(F.min("ifvar").alias("best"))
    zero = c.where(F.col("s") <= 100).groupBy("feature").agg(F.avg("ifvar").alias("zero"))
    win = c.where(F.col("ifvar") < 25).groupBy("feature").agg(F.min("s").alias("first_win"))
    out = base.join(best, "feature", "left").join(zero, "feature", "left").join(win, "feature", "left")
    return shaped(out.withColumn("ratio", F.col("best") / F.col("zero")), ["feature", "n_s", "first_win"], ["best", "zero", "ratio"])


@query(
    "embedding_lookup",
    sql_shaped(
        """WITH v AS (SELECT d.text, list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)) AS total FROM
          (SELECT trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS text, min(doc_id) AS vec_id FROM documents GROUP BY 1) d JOIN embeddings e USING (vec_id))
        SELECT doc_id, total IS NULL AS embedding_missing, coalesce(total, 0) AS total FROM documents d LEFT JOIN v ON trim(regexp_replace(d.text, '[\\s]+', ' ', 'g')) = v.text""",
        ["doc_id", "embedding_missing"],
        ["total"],
    ),
)
def embedding_lookup(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    first = X.distinct_texts(docs, "doc_id", ["text"]).select("text", F.col("first_id").alias("vec_id"))
    vectors = first.join(load(spark, sf, "embeddings"), "vec_id").select("text", "embedding")
    out = J.embedding_lookup(docs, "text", vectors, 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select("doc_id", "embedding_missing", rounded(total).alias("total"))


@query(
    "outcome_pair_compare",
    sql_shaped(
        """WITH m AS (SELECT l_returnflag AS loss, l_linenumber::BIGINT AS s_train, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)
        SELECT 'A_minus_R' AS loss, s_train, a.value - r.value AS value, (a.value - r.value) / r.value AS value_relative_delta
        FROM m a JOIN m r USING (s_train) WHERE a.loss = 'A' AND r.loss = 'R'""",
        ["loss", "s_train"],
        ["value", "value_relative_delta"],
    ),
)
def outcome_pair_compare(spark, sf):
    m = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("loss"), F.col("l_linenumber").cast("long").alias("s_train")).agg(F.avg("l_extendedprice").alias("value"))
    return shaped(J.outcome_pair_compare(m, "A", "R"), ["loss", "s_train"], ["value", "value_relative_delta"])


@query(
    "append_delta_rows",
    sql_shaped(
        """WITH m AS (SELECT l_returnflag AS loss, l_linenumber::BIGINT AS s_train, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)
        SELECT loss, s_train, value, NULL::DOUBLE AS value_relative_delta FROM m UNION ALL
        SELECT 'A_minus_N', s_train, a.value - r.value, (a.value - r.value) / r.value FROM m a JOIN m r USING (s_train) WHERE a.loss = 'A' AND r.loss = 'N'""",
        ["loss", "s_train"],
        ["value", "value_relative_delta"],
    ),
)
def append_delta_rows(spark, sf):
    m = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("loss"), F.col("l_linenumber").cast("long").alias("s_train")).agg(F.avg("l_extendedprice").alias("value"))
    return shaped(J.append_rows(m, J.outcome_pair_compare(m, "A", "N")), ["loss", "s_train"], ["value", "value_relative_delta"])


# --- sampling --------------------------------------------------------------------


@query("population_split", f"WITH {S.ORD} SELECT id, split FROM ord_split")
def population_split(spark, sf):
    return orders_split(spark, sf).select("id", "split")


@query("split_source_ids", f"WITH {S.ORD} SELECT id, round(y, 6) AS y FROM ord_split WHERE split = 'target'")
def split_source_ids(spark, sf):
    return shaped(X.split_source(orders_split(spark, sf), "p_target"), ["id"], ["y"])


@query("replication_split", f"WITH {REPL} SELECT replication, id, rank, role, train_rank FROM repl")
def replication_split(spark, sf):
    return replicated(spark, sf).select("replication", "id", "rank", "role", "train_rank")


_ALLOC_COLS = ["budget", "replication", "id", "rank", "validation_size", "n_eff", "role", "train_rank"]


@query("allocation_split", f"WITH {ALLOC} SELECT budget::BIGINT AS budget, {', '.join(_ALLOC_COLS[1:])} FROM alloc")
def allocation_split(spark, sf):
    return allocated(spark, sf).select(*_ALLOC_COLS)


_SIZES = """sizes AS (SELECT o_orderstatus, o_orderpriority, count(*) AS budget FROM orders GROUP BY ALL)"""


@query(
    "validation_size",
    f"WITH {_SIZES} SELECT o_orderstatus, o_orderpriority, budget, round_even(0.2 * budget, 0)::BIGINT AS validation_size, budget - round_even(0.2 * budget, 0)::BIGINT AS n_eff FROM sizes",
)
def validation_size(spark, sf):
    sizes = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("budget"))
    v = X.validation_size_column(F.col("budget"))
    return sizes.withColumn("validation_size", v).withColumn("n_eff", F.col("budget") - F.col("validation_size"))


@query(
    "s_for_rho",
    f"WITH {_SIZES} SELECT o_orderstatus, o_orderpriority, budget, rho::DOUBLE AS rho, greatest(1, least(budget - 1, round_even(rho * budget, 0)::BIGINT))::BIGINT AS s FROM sizes, (VALUES (0.00001), (0.125), (0.3), (0.9), (1.0)) AS r(rho)",
)
def s_for_rho(spark, sf):
    sizes = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("budget"))
    rows = sizes.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in (0.00001, 0.125, 0.3, 0.9, 1.0)])))
    return rows.withColumn("s", X.s_for_rho_column(F.col("rho"), F.col("budget")))


@query("nested_train", f"WITH {REPL} SELECT replication, id, train_rank FROM repl WHERE train_rank <= 200")
def nested_train(spark, sf):
    return X.nested_train(replicated(spark, sf), 200).select("replication", "id", "train_rank")


@query(
    "correction_set",
    f"WITH {ALLOC} SELECT budget::BIGINT AS budget, replication, id, train_rank FROM alloc WHERE train_rank > greatest(1, least(n_eff - 1, round_even(0.2 * n_eff, 0)::BIGINT))",
)
def correction_set(spark, sf):
    s = X.s_for_rho_column(F.lit(0.2), F.col("n_eff"))
    return X.correction_set(allocated(spark, sf), s).select("budget", "replication", "id", "train_rank")


@query(
    "frac_split",
    """SELECT id, CASE WHEN r <= round_even(0.6 * n, 0) THEN 'train_pool' WHEN r <= round_even(0.6 * n, 0) + round_even(0.2 * n, 0) THEN 'validation' ELSE 'evaluation' END AS split
    FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('31:fractions:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""",
)
def frac_split(spark, sf):
    return X.frac_split(orders(spark, sf), "id", seed=31).select("id", "split")


@query("limit_sample", "SELECT doc_id FROM documents ORDER BY md5('37:limit:' || doc_id), doc_id LIMIT 120")
def limit_sample(spark, sf):
    return X.limit_sample(load(spark, sf, "documents").select("doc_id"), "doc_id", 120, seed=37)


@query(
    "train_val_select",
    """SELECT s, replication, vec_id, CASE WHEN r <= s THEN 'train' ELSE 'validation' END AS role FROM (
    SELECT s, replication, vec_id, row_number() OVER (PARTITION BY s, replication ORDER BY md5(concat_ws(':', 41, s, replication, 'select', vec_id)), vec_id) AS r
    FROM embeddings, (SELECT unnest([50, 200])::BIGINT AS s), (SELECT unnest(range(3)) AS replication))""",
)
def train_val_select(spark, sf):
    pool = load(spark, sf, "embeddings").select("vec_id")
    out = X.train_val_select(pool, "vec_id", [50, 200], range(3), 41, min_validation=100)
    return out.select("s", "replication", "vec_id", "role")


@query(
    "pool_stop_scale_split",
    f"""SELECT replication, id, CASE WHEN r <= 500 THEN 'train_pool' WHEN r <= 700 THEN 'stop' ELSE 'scale' END AS role, CASE WHEN r <= 500 THEN r END AS train_rank FROM (
    SELECT replication, o_orderkey AS id, row_number() OVER (PARTITION BY replication ORDER BY md5(concat_ws(':', 43, replication, 'bands', o_orderkey)), o_orderkey) AS r FROM orders, {_REPS}) WHERE r <= 1000""",
)
def pool_stop_scale_split(spark, sf):
    out = X.pool_stop_scale_split(orders(spark, sf), "id", REPS, 500, 200, 300, seed=43)
    return out.select("replication", "id", "role", "train_rank")


@query(
    "screening_sample",
    f"""WITH {S.ORD}, t AS (SELECT id, row_number() OVER (ORDER BY md5('47:train_pool:' || id), id) AS r FROM ord_split WHERE split = 'h_scale'),
    e AS (SELECT id, row_number() OVER (ORDER BY md5('47:evaluation:' || id), id) AS r FROM ord_split WHERE split = 'target')
    SELECT id, 'train_pool' AS screen_split, r - 1 AS screen_row_id FROM t WHERE r <= 280 UNION ALL SELECT id, 'evaluation', r - 1 + 280 FROM e WHERE r <= 120""",
)
def screening_sample(spark, sf):
    return X.screening_sample(orders_split(spark, sf).select("id", "split"), "id", 400, 120, seed=47).drop("split")


@query(
    "group_split",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
    p AS (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY md5('53:group:' || o_custkey), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
    SELECT o_orderkey, CASE WHEN before < 0.6 * total THEN 'train' WHEN before < 0.8 * total THEN 'stop' ELSE 'scale' END AS split FROM orders JOIN p USING (o_custkey)""",
)
def group_split(spark, sf):
    out = X.group_split(load(spark, sf, "orders"), "o_custkey", [0.6, 0.8], ["train", "stop", "scale"], seed=53)
    return out.select("o_orderkey", "split")


def _balanced(spark, sf, strategy):
    rows = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderpriority") == "5-LOW", -1.0).otherwise(0.0) * F.col("o_totalprice")).alias("v")
    )
    return X.balanced_sample(rows, "id", 300, 59, strategy, "v").select(F.lit(strategy).alias("strategy"), "id", F.col("stratum").cast("long").alias("stratum"))


@query(
    "balanced_sample",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderpriority = '5-LOW' THEN -1.0 ELSE 0.0 END * o_totalprice AS v, md5('59:balanced:' || o_orderkey) AS h FROM orders),
    q AS (SELECT quantile_cont(abs(v), 0.25) AS q1, quantile_cont(abs(v), 0.5) AS q2, quantile_cont(abs(v), 0.75) AS q3 FROM x),
    s AS (SELECT 'uniform' AS strategy, id, h, 0 AS stratum FROM x UNION ALL SELECT 'target_nonzero_balanced', id, h, sign(v) FROM x
      UNION ALL SELECT 'target_if_weight_balanced', id, h, (abs(v) > q1)::INT + (abs(v) > q2)::INT + (abs(v) > q3)::INT FROM x, q),
    t AS (SELECT *, row_number() OVER (PARTITION BY strategy, stratum ORDER BY h, id) AS turn FROM s)
    SELECT strategy, id, stratum::BIGINT AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY turn, stratum) AS r FROM t) WHERE r <= 300""",
)
def balanced_sample(spark, sf):
    out = _balanced(spark, sf, "uniform")
    for strategy in ("target_nonzero_balanced", "target_if_weight_balanced"):
        out = out.unionByName(_balanced(spark, sf, strategy))
    return out


@query("kfold_assign", f"SELECT doc_id, ({FP.format(x=chr(39) + '61:fold:' + chr(39) + ' || doc_id')}) % 5 AS fold FROM documents")
def kfold_assign(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.kfold(F.col("doc_id"), 5, 61).alias("fold"))


@query(
    "leakage_audit",
    f"""WITH {REPL}, m AS (SELECT *, CASE WHEN replication = 3 AND rank = 2 THEN -id ELSE id END AS own FROM repl),
    f AS (SELECT replication, own AS id, role, train_rank FROM m WHERE replication <> 4 OR coalesce(train_rank, 0) <> 5 UNION ALL SELECT replication, own, 'L', NULL FROM m
      UNION ALL SELECT replication, id, role, train_rank FROM m WHERE replication = 1 AND rank = 1 UNION ALL SELECT replication, id, 'L_prime', NULL FROM m WHERE replication = 2 AND rank = 1),
    p AS (SELECT replication, id, count(*) FILTER (role = 'L') AS w, count(*) FILTER (role = 'V_stop') AS a, count(*) FILTER (role = 'V_scale') AS b, count(*) FILTER (role = 'L_prime') AS l, max(train_rank) AS tr FROM f GROUP BY ALL),
    r AS (SELECT replication, count(*)::BIGINT AS n_ids, sum(greatest(w - 1, 0) + greatest(a - 1, 0) + greatest(b - 1, 0) + greatest(l - 1, 0))::BIGINT AS repeated,
      count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (l > 0)::INT > 1)::BIGINT AS overlapping, count(*) FILTER ((a + b + l > 0) <> (w > 0))::BIGINT AS not_dealt,
      count(*) FILTER (id NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS unknown_ids, 0::BIGINT AS stray_roles, count(*) FILTER (w > 0)::BIGINT AS n_L, count(*) FILTER (a > 0)::BIGINT AS n_V_stop,
      count(*) FILTER (b > 0)::BIGINT AS n_V_scale, count(*) FILTER (l > 0)::BIGINT AS n_L_prime, (max(tr) - count(DISTINCT tr))::BIGINT AS order_gaps, (count(tr) - count(DISTINCT tr))::BIGINT AS order_ties FROM p GROUP BY 1)
    SELECT *, replication = 0 AS passed FROM r""",
)
def leakage_audit(spark, sf):
    """Replication 0 is clean; the others hold a repeated row, two roles of one id, an unknown id, a hole in the order."""
    own = F.when((F.col("replication") == 3) & (F.col("rank") == 2), -F.col("id")).otherwise(F.col("id"))
    rows = replicated(spark, sf).withColumn("own", own)
    none = F.lit(None).cast("long").alias("train_rank")
    members = rows.where("replication <> 4 or coalesce(train_rank, 0) <> 5").select("replication", F.col("own").alias("id"), "role", "train_rank")
    members = members.unionByName(rows.select("replication", F.col("own").alias("id"), F.lit("L").alias("role"), none))
    members = members.unionByName(rows.where("replication = 1 and rank = 1").select("replication", "id", "role", "train_rank"))
    members = members.unionByName(rows.where("replication = 2 and rank = 1").select("replication", "id", F.lit("L_prime").alias("role"), none))
    sizes = {"L": 1000, "V_stop": 150, "V_scale": 250, "L_prime": 600}
    return X.leakage_audit(members, "id", ["replication"], sizes, orders(spark, sf), whole="L")


@query(
    "split_manifest",
    f"WITH {ALLOC} SELECT budget::BIGINT AS budget, replication, role, count(*)::BIGINT AS n, bit_xor({FP.format(x='id')}) AS ids_xor, (sum({FP.format(x='id')}) % 1152921504606846976)::BIGINT AS ids_sum, min(id) AS min_id, max(id) AS max_id FROM alloc GROUP BY ALL",
)
def split_manifest(spark, sf):
    return X.split_manifest(allocated(spark, sf), "id", ["budget", "replication"])


@query("ids_hash", f"SELECT lang, count(*)::BIGINT AS n, bit_xor({FP.format(x='doc_id')}) AS ids_xor, (sum({FP.format(x='doc_id')}) % 1152921504606846976)::BIGINT AS ids_sum FROM documents GROUP BY lang")
def ids_hash(spark, sf):
    return X.ids_hash(load(spark, sf, "documents"), "doc_id", ["lang"])


@query(
    "distinct_texts",
    f"""WITH {S.PREF}, t AS (SELECT 0 AS pos, conv_id, trim(regexp_replace(prompt, '[\\s]+', ' ', 'g')) AS text FROM pref UNION ALL SELECT 1, conv_id, trim(regexp_replace(response_1, '[\\s]+', ' ', 'g')) FROM pref
      UNION ALL SELECT 2, conv_id, trim(regexp_replace(response_2, '[\\s]+', ' ', 'g')) FROM pref)
    SELECT md5(text) AS text_md5, min(pos)::INT AS first_column, arg_min(conv_id, pos * 1000000000 + conv_id) AS first_id FROM t WHERE text <> '' GROUP BY text""",
)
def distinct_texts(spark, sf):
    pairs = POP.preference_pairs(load(spark, sf, "conversations"))
    out = X.distinct_texts(pairs, "conv_id", ["prompt", "response_1", "response_2"])
    return out.select(F.md5("text").alias("text_md5"), "first_column", "first_id")


@query(
    "candidate_union",
    """WITH g AS (SELECT o_orderstatus AS budget, round(o_totalprice / 500000, 2) AS rho FROM orders GROUP BY ALL), t AS (SELECT o_orderstatus AS budget, avg(o_totalprice) / 500000 AS rho, max(round(o_totalprice / 500000, 2)) AS top FROM orders GROUP BY 1)
    SELECT budget, rho, 'grid' AS source FROM g UNION ALL SELECT budget, round(rho, 6), 'theory_exact' FROM t UNION ALL
    SELECT budget, top, 'theory_exact' FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.budget = t.budget AND abs(g.rho - t.top) <= 1e-10)""",
)
def candidate_union(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("budget"), (F.col("o_totalprice") / 500000).alias("r"))
    grid = o.select("budget", F.round("r", 2).alias("rho")).distinct().withColumn("source", F.lit("grid"))
    exact = o.groupBy("budget").agg(F.avg("r").alias("rho"))
    near = o.groupBy("budget").agg((F.max(F.round("r", 2)) + 1e-12).alias("rho"))
    theory = exact.unionByName(near).withColumn("source", F.lit("theory_exact"))
    out = X.candidate_union(grid, theory, ["budget"])
    return shaped(out, ["budget", "source"], ["rho"])
