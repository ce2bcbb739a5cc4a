"""Sources, projections and scaling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import population as P
from ..operators import scaling as C
from ..operators.splits import sized_fraction
from ..plans import populations as POP
from ..plans import preference as PREF
from ..session import shared_dir
from ..sources import sinks
from ..sources import tables as R
from . import sqlparts as S
from .data import load
from .registry import query, rounded, shaped, sql_shaped


def scratch(spark, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# --- sources -------------------------------------------------------------------


@query(
    "read_table",
    """SELECT f.format, c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer,
    (VALUES ('csv'), ('json'), ('jsonl'), ('jsonl.gz'), ('parquet')) AS f(format)""",
)
def read_table(spark, sf):
    base = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    folder = scratch(spark, "formats")
    parts = []
    for suffix in ("csv", "json", "jsonl", "jsonl.gz", "parquet"):
        path = f"{folder}/customer.{suffix}"
        sinks.write_table(base, path)
        got = R.read_table(spark, path, schema=base.schema)
        parts.append(got.select(F.lit(suffix).alias("format"), "c_custkey", "c_name", rounded(F.col("c_acctbal")).alias("c_acctbal")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("require_columns", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus")
def require_columns(spark, sf):
    orders = R.require_columns(load(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_split_limit",
    "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 250",
)
def filter_split_limit(spark, sf):
    docs = load(spark, sf, "documents").withColumn("split", F.col("lang"))
    return R.filter_split_limit(docs, "en", 250, ["doc_id"]).select("doc_id", "lang", "n_chars")


@query(
    "read_embeddings",
    sql_shaped(
        "SELECT vec_id, len(embedding)::BIGINT AS dim, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS total FROM embeddings",
        ["vec_id", "dim"],
        ["total"],
    ),
)
def read_embeddings(spark, sf):
    df = R.read_embeddings(spark, f"{sf}/embeddings.parquet", dim=64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return df.select("vec_id", F.size("embedding").cast("long").alias("dim"), rounded(total).alias("total"))


@query(
    "resolve_value_column",
    "SELECT l_returnflag AS method, l_linenumber::BIGINT AS s_train, round(var_samp(l_discount) * 25, 6) AS residual_var_raw FROM lineitem GROUP BY ALL",
)
def resolve_value_column(spark, sf):
    raw = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.var_samp("l_discount").alias("validation_scale_residual_var")
    )
    value, _ = R.resolve_value_column(raw, "auto")
    return raw.select(
        F.col("l_returnflag").alias("method"),
        F.col("l_linenumber").cast("long").alias("s_train"),
        rounded(value).alias("residual_var_raw"),
    )


@query(
    "read_first_available",
    "SELECT l_returnflag AS method, l_linenumber::BIGINT AS s_train, round(var_samp(l_discount) * 25, 6) AS residual_var_raw FROM lineitem GROUP BY ALL",
)
def read_first_available(spark, sf):
    raw = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("s_train")).agg(
        F.var_samp("l_discount").alias("validation_residual_var")
    )
    folder = scratch(spark, "results")
    sinks.write_table(raw, f"{folder}/{R.RESULT_LAYOUTS[1]}")
    got = R.read_first_available(spark, folder)
    return got.select("method", "s_train", rounded(F.col("residual_var_raw")).alias("residual_var_raw"))


@query(
    "write_table",
    "SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
)
def write_table(spark, sf):
    summary = load(spark, sf, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    path = scratch(spark, "summary") + "/by_source.csv"
    sinks.write_table(summary, path)
    return R.read_table(spark, path, schema=summary.schema)


@query(
    "write_predictions",
    "SELECT l_returnflag AS cell, l_orderkey * 8 + l_linenumber AS sample_id, round(l_quantity * 2, 6) AS pred_scaled, round(l_quantity * 10 + 90, 6) AS pred_raw FROM lineitem",
)
def write_predictions(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("cell"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"),
        (F.col("l_quantity") * 2).alias("pred_scaled"),
        P.affine_unscale(F.col("l_quantity") * 2).alias("pred_raw"),
        "l_tax",
    )
    path = scratch(spark, "predictions")
    sinks.write_predictions(rows, path, unlabelled=True)
    got = spark.read.parquet(path)
    return got.select(
        F.col("cell").cast("string").alias("cell"), "sample_id", rounded(F.col("pred_scaled")).alias("pred_scaled"), rounded(F.col("pred_raw")).alias("pred_raw")
    )


# --- projections ----------------------------------------------------------------


@query("clean_population", f"WITH {S.CLEAN} SELECT doc_id, md5(text) AS text_md5, n_chars::DOUBLE AS n_chars FROM clean")
def clean_population(spark, sf):
    clean = P.clean_population(load(spark, sf, "documents"), "text", "n_chars", "doc_id")
    return clean.select("doc_id", F.md5("text").alias("text_md5"), "n_chars")


@query(
    "dense_id",
    f"WITH {S.CLEAN} SELECT doc_id, (row_number() OVER (ORDER BY md5('0:dense:' || doc_id), doc_id) - 1)::BIGINT AS sample_id FROM clean",
)
def dense_id(spark, sf):
    clean = P.clean_population(load(spark, sf, "documents"), "text", None, "doc_id").select("doc_id")
    return P.dense_id(clean, "doc_id")


@query("filter_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def filter_positive(spark, sf):
    return P.filter_positive(load(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "affine_scale",
    "SELECT p_partkey, round((p_size - 90.0) / 5.0, 6)::DOUBLE AS scaled, p_size::DOUBLE AS back FROM part",
)
def affine_scale(spark, sf):
    part = load(spark, sf, "part").withColumn("scaled", P.affine_scale(F.col("p_size").cast("double")))
    return part.select("p_partkey", rounded(F.col("scaled")).alias("scaled"), rounded(P.affine_unscale(F.col("scaled"))).alias("back"))


_Z = ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS z_{c}, "
    f"avg({c}) OVER () AS z_{c}_mean, stddev_pop({c}) OVER () AS z_{c}_sd"
    for c in ("p_size", "p_retailprice")
)
_ZC = [f"z_{c}{s}" for c in ("p_size", "p_retailprice") for s in ("", "_mean", "_sd")]


@query("zscore", sql_shaped(f"SELECT p_partkey, {_Z} FROM part", ["p_partkey"], _ZC))
def zscore(spark, sf):
    z = C.zscore(load(spark, sf, "part"), {f"z_{c}": c for c in ("p_size", "p_retailprice")}, keep_stats=True)
    return shaped(z, ["p_partkey"], _ZC)


@query(
    "scale_no_center",
    sql_shaped("SELECT l_returnflag, l_linenumber, l_discount / stddev_pop(l_discount) OVER () AS x FROM lineitem", ["l_returnflag", "l_linenumber"], ["x"]),
)
def scale_no_center(spark, sf):
    out = C.scale_no_center(load(spark, sf, "lineitem"), {"x": "l_discount"})
    return shaped(out, ["l_returnflag", "l_linenumber"], ["x"])


@query(
    "standardize_y",
    sql_shaped(
        f"WITH {S.ORD} SELECT id, (y - avg(y) FILTER (split = 'h_scale') OVER ()) / stddev_pop(y) FILTER (split = 'h_scale') OVER () AS y_scaled FROM ord_split",
        ["id"],
        ["y_scaled"],
    ),
)
def standardize_y(spark, sf):
    out = C.standardize_y(orders_split(spark, sf), "y", F.col("split") == "h_scale")
    return shaped(out, ["id"], ["y_scaled"])


def orders_split(spark, sf):
    from ..operators.splits import population_split

    pop = POP.order_population(load(spark, sf, "lineitem"))
    return population_split(pop, "id", sized_fraction(pop, 0.8), sized_fraction(pop, 0.32), seed=11)


_TYPES = ("ECONOMY", "SMALL", "STANDARD", "LARGE")


@query(
    "one_hot_list",
    "SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::INT::DOUBLE AS raw_type_{t.lower()}" for t in _TYPES) + " FROM part",
)
def one_hot_list(spark, sf):
    out = P.one_hot_list(load(spark, sf, "part"), "p_type", _TYPES, "raw_type_")
    return out.select("p_partkey", *[f"raw_type_{t.lower()}" for t in _TYPES])


@query(
    "slug",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
)
def slug(spark, sf):
    part = load(spark, sf, "part")
    return part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"))


@query(
    "log_features",
    sql_shaped("SELECT p_partkey, ln(p_retailprice) AS raw_log_price, ln(1 + p_size) AS raw_log_size FROM part", ["p_partkey"], ["raw_log_price", "raw_log_size"]),
)
def log_features(spark, sf):
    out = P.log_features(load(spark, sf, "part"), {"raw_log_price": "p_retailprice"}, {"raw_log_size": "p_size"})
    return shaped(out, ["p_partkey"], ["raw_log_price", "raw_log_size"])


_ARMS = ("word_count", "log_char_count", "question")
_ARM_SQL = {
    "word_count": lambda t: f"len({S.headline_words(t)})::DOUBLE",
    "log_char_count": lambda t: f"ln(1 + length({t}))",
    "question": lambda t: f"(CASE WHEN contains({t}, '?') THEN 1.0 ELSE 0.0 END)",
}
_DELTA_SQL = f"""WITH {S.PAIRS}, d AS (SELECT pair_id, {', '.join(f"{f('headline_a')} - {f('headline_b')} AS delta_{n}_raw" for n, f in _ARM_SQL.items())} FROM pairs)
SELECT pair_id, {', '.join(f'delta_{n}_raw' for n in _ARMS)},
  delta_word_count_raw / stddev_pop(delta_word_count_raw) OVER () AS delta_word_count,
  delta_log_char_count_raw / stddev_pop(delta_log_char_count_raw) OVER () AS delta_log_char_count,
  delta_question_raw AS delta_question FROM d"""
_DELTAS = [f"delta_{n}{s}" for n in _ARMS for s in ("_raw", "")]


@query("arm_delta", sql_shaped(_DELTA_SQL, ["pair_id"], _DELTAS))
def arm_delta(spark, sf):
    pairs = POP.document_pairs(load(spark, sf, "documents"))
    arms = pairs
    for arm in ("a", "b"):
        t = F.col(f"headline_{arm}")
        arms = arms.withColumns(
            {
                f"{arm}_word_count": F.size(T.headline_words(t)).cast("double"),
                f"{arm}_log_char_count": F.log1p(F.length(t)),
                f"{arm}_question": t.contains("?").cast("double"),
            }
        )
    kinds = {"word_count": "continuous", "log_char_count": "continuous", "question": "ternary"}
    return shaped(C.arm_delta(arms, _ARMS, kinds), ["pair_id"], _DELTAS)


_PREF_COLS = [d + s for d in PREF.DELTAS for s in ("", "_scale")]


def preference_frame(spark, sf):
    pairs = POP.preference_pairs(load(spark, sf, "conversations"))
    return PREF.response_delta(PREF.response_features(pairs))


@query(
    "response_delta",
    sql_shaped(f"SELECT conv_id, split, y AS y_preference_strength, {', '.join(_PREF_COLS)} FROM pref_frame", ["conv_id", "split"], ["y_preference_strength", *_PREF_COLS], with_=f"WITH {S.PREF_DELTA}"),
)
def response_delta(spark, sf):
    return shaped(preference_frame(spark, sf), ["conv_id", "split"], ["y_preference_strength", *_PREF_COLS])


@query(
    "feature_kind",
    """SELECT 'sign' AS feature, 'ternary' AS kind UNION ALL
    SELECT c, CASE WHEN n <= 2 THEN 'binary' ELSE 'continuous' END FROM (
      SELECT 'two' AS c, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN 2.0 ELSE 5.0 END) AS n FROM lineitem
      UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
      UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem)""",
)
def feature_kind(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.signum(F.col("l_quantity") - 25).alias("sign"),
        F.when(F.col("l_returnflag") == "A", 2.0).otherwise(5.0).alias("two"),
        "l_discount",
        "l_quantity",
    )
    return C.feature_kinds(rows, ["sign", "two", "l_discount", "l_quantity"])


@query(
    "usable_features",
    """SELECT * FROM (SELECT 0 AS position, 'feat_size' AS feature, round(stddev_pop(p_size), 6) AS sd FROM part
    UNION ALL SELECT 2, 'feat_price', round(stddev_pop(p_retailprice), 6) FROM part)""",
)
def usable_features(spark, sf):
    part = load(spark, sf, "part").select(
        F.col("p_size").cast("double").alias("feat_size"),
        F.lit(1.5).alias("feat_flat"),
        F.col("p_retailprice").alias("feat_price"),
    )
    found = C.usable_features(part, ["feat_size", "feat_flat", "feat_price"], 2)
    return found.select("position", "feature", rounded(F.col("sd")).alias("sd"))


def traffic(spark, sf):
    """Clicks and impressions per day and arm; the arm is the parity of the user."""
    e = load(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    per = {}
    for i, arm in enumerate(("a", "b")):
        mine = F.col("user_id") % 2 == i
        per[f"clicks_{arm}"] = F.count(F.when(mine & (F.col("event_type") == "click"), 1))
        per[f"impressions_{arm}"] = F.count(F.when(mine, 1))
    return e.groupBy(F.to_date("ts").alias("day")).agg(*[c.alias(n) for n, c in per.items()])


_TRAFFIC = """traffic AS (SELECT ts::DATE AS day,
  count(*) FILTER (user_id % 2 = 0 AND event_type = 'click') AS clicks_a, count(*) FILTER (user_id % 2 = 0) AS impressions_a,
  count(*) FILTER (user_id % 2 = 1 AND event_type = 'click') AS clicks_b, count(*) FILTER (user_id % 2 = 1) AS impressions_b
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)"""


@query(
    "arm_traffic_filter",
    f"WITH {_TRAFFIC} SELECT day::VARCHAR AS day, clicks_a, impressions_a, clicks_b, impressions_b FROM traffic WHERE least(impressions_a, impressions_b) >= 55 AND impressions_a + impressions_b >= 120 AND least(clicks_a, clicks_b) >= 20",
)
def arm_traffic_filter(spark, sf):
    out = C.arm_traffic_filter(traffic(spark, sf), 55, 120, 20)
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "eb_logit_ctr_diff",
    sql_shaped(
        f"""WITH {_TRAFFIC}, p AS (SELECT *, (sum(clicks_a + clicks_b) OVER ())::DOUBLE / sum(impressions_a + impressions_b) OVER () AS m FROM traffic),
        r AS (SELECT day, (clicks_a + 1000 * m) / (impressions_a + 1000) AS pa, (clicks_b + 1000 * m) / (impressions_b + 1000) AS pb FROM p)
        SELECT day::VARCHAR AS day, ln(pa / (1 - pa)) - ln(pb / (1 - pb)) AS y_logit_ctr_diff FROM r""",
        ["day"],
        ["y_logit_ctr_diff"],
    ),
)
def eb_logit_ctr_diff(spark, sf):
    out = C.eb_logit_ctr_diff(traffic(spark, sf), tau=1000.0).withColumn("day", F.col("day").cast("string"))
    return shaped(out, ["day"], ["y_logit_ctr_diff"])


@query(
    "winsorize",
    sql_shaped(
        """SELECT event_id, least(greatest(value, lo), hi) AS value FROM events,
        (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)""",
        ["event_id"],
        ["value"],
    ),
)
def winsorize(spark, sf):
    return shaped(C.winsorize(load(spark, sf, "events"), "value"), ["event_id"], ["value"])


@query(
    "normalize_text",
    f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), {S.lit('[' + T.SPACE + ']+')}, ' ', 'g'))) AS text_md5 FROM documents",
)
def normalize_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("text_md5"))


@query(
    "context_concat",
    f"WITH {S.PAIRS} SELECT pair_id, md5(excerpt_a || ' ' || lede_a) AS context_a, md5(excerpt_b || ' ' || lede_b) AS context_b FROM pairs",
)
def context_concat(spark, sf):
    pairs = POP.document_pairs(load(spark, sf, "documents"))
    return pairs.select("pair_id", *[F.md5(P.context_concat(pairs, a)).alias(f"context_{a}") for a in ("a", "b")])


_TEMPLATE = PREF.PAIR_TEMPLATE.split("%s")


def _sql_format(template: str, *cols: str) -> str:
    parts = template.split("%s")
    out = [S.lit(parts[0])]
    for c, p in zip(cols, parts[1:]):
        out += [c, S.lit(p)]
    return " || ".join(out)


@query(
    "pair_text",
    f"""WITH {S.PREF} SELECT conv_id, md5({_sql_format(PREF.PAIR_TEMPLATE, 'prompt', 'response_1', 'response_2')}) AS forward,
    md5({_sql_format(PREF.PAIR_TEMPLATE, 'prompt', 'response_2', 'response_1')}) AS swapped,
    md5({_sql_format(PREF.RESPONSE_TEMPLATE, 'prompt', 'response_1')}) AS text_1,
    md5({_sql_format(PREF.RESPONSE_TEMPLATE, 'prompt', 'response_2')}) AS text_2 FROM pref""",
)
def pair_text(spark, sf):
    out = PREF.pair_text(POP.preference_pairs(load(spark, sf, "conversations")))
    return out.select("conv_id", *[F.md5(c).alias(c) for c in ("forward", "swapped", "text_1", "text_2")])


@query(
    "headline_pair_text",
    f"""WITH {S.PAIRS} SELECT pair_id, md5({_sql_format(PREF.HEADLINE_TEMPLATE, 'headline_a', 'headline_b', "excerpt_a || ' ' || lede_a")}) AS text_md5 FROM pairs""",
)
def headline_pair_text(spark, sf):
    pairs = POP.document_pairs(load(spark, sf, "documents"))
    t = PREF.headline_text(F.col("headline_a"), F.col("headline_b"), P.context_concat(pairs, "a"))
    return pairs.select("pair_id", F.md5(t).alias("text_md5"))


@query(
    "antisymmetric_score",
    sql_shaped("SELECT l_orderkey, l_linenumber, 0.5 * (l_discount - l_tax) AS score FROM lineitem", ["l_orderkey", "l_linenumber"], ["score"]),
)
def antisymmetric_score(spark, sf):
    out = load(spark, sf, "lineitem").withColumn("score", C.antisymmetric_score(F.col("l_discount"), F.col("l_tax")))
    return shaped(out, ["l_orderkey", "l_linenumber"], ["score"])


def vector_pairs(spark, sf):
    e = load(spark, sf, "embeddings")
    half = F.floor(F.col("vec_id") / 2)
    a = e.where(F.col("vec_id") % 2 == 0).select(half.alias("pair_id"), F.col("embedding").alias("embedding_a"), F.col("label").alias("label_a"))
    b = e.where(F.col("vec_id") % 2 == 1).select(half.alias("pair_id"), F.col("embedding").alias("embedding_b"), F.col("label").alias("label_b"))
    return a.join(b, "pair_id")


VEC_PAIRS = """vec_pairs AS (SELECT a.vec_id // 2 AS pair_id, a.embedding AS ea, b.embedding AS eb, a.label AS label_a, b.label AS label_b
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"""


@query(
    "pair_embedding",
    f"""WITH {VEC_PAIRS}, d AS (SELECT pair_id, list_transform(list_zip(ea, eb), lambda p: (p[1] - p[2])::FLOAT) AS d FROM vec_pairs)
    SELECT pair_id, generate_subscripts(v, 1)::BIGINT - 1 AS dim, round(unnest(v)::DOUBLE, 6) AS value
    FROM (SELECT pair_id, list_concat(d, list_transform(d, lambda x: abs(x))) AS v FROM d)""",
)
def pair_embedding(spark, sf):
    v = vector_pairs(spark, sf).select(
        "pair_id", C.pair_embedding(F.col("embedding_a"), F.col("embedding_b"), "a_minus_b", absolute=True).alias("v")
    )
    return v.select("pair_id", F.posexplode("v").alias("dim", "value")).select(
        "pair_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("value").cast("double")).alias("value")
    )


@query(
    "standardize_embedding",
    sql_shaped(
        """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT vec_id, dim::BIGINT AS dim, (v - avg(v) FILTER (label < 5) OVER (PARTITION BY dim)) /
          CASE WHEN stddev_pop(v) FILTER (label < 5) OVER (PARTITION BY dim) < 1e-6 THEN 1 ELSE stddev_pop(v) FILTER (label < 5) OVER (PARTITION BY dim) END AS value FROM x""",
        ["vec_id", "dim"],
        ["value"],
    ),
)
def standardize_embedding(spark, sf):
    e = C.standardize_embedding(load(spark, sf, "embeddings"), "embedding", F.col("label") < 5, 64)
    return e.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("value")).alias("value")
    )


@query(
    "round_report",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL",
)
def round_report(spark, sf):
    means = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price")
    )
    return sinks.round_report(means, 4)
