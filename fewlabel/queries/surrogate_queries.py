"""Corpus statistics, surrogates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as V
from ..operators import influence as I
from ..operators import sparse_ridge as SR
from ..operators import splits as X
from ..operators import surrogate as U
from ..operators import terms as TM
from ..operators.moments import moments_of
from ..operators.screening import budget_rows, screen_score
from ..plans import headlines as H
from ..plans import populations as POP
from ..plans import screening as PL
from ..plans import surrogates as SU
from ..session import materialise
from ..sources import sinks
from ..streaming import jobs
from . import sqlparts as S
from .data import load
from .experiment_queries import _NESTED, allocation_cells, CELLS, PILOT
from .project_queries import orders_split, scratch
from .registry import query, rounded, shaped, sql_shaped
from .regression_queries import fit1

# --- corpus statistics -----------------------------------------------------------


def word_rows(spark, sf):
    return materialise(load(spark, sf, "documents").select("doc_id", T.headline_words(F.col("text")).alias("w")), "words")


_TOK = f"tok AS (SELECT doc_id, unnest({S.headline_words('text')}) AS word FROM documents), freq AS (SELECT word, count(*) AS n, log10(1e9 * count(*) / (SELECT count(*) FROM tok)) AS z FROM tok GROUP BY word)"
_ZC = ["common_zipf", "content_common_zipf", "rare_word_share", "common_word_share"]
_STOP = S.in_list(V.STOP_WORDS)


@query(
    "corpus_zipf",
    sql_shaped(
        f"""SELECT doc_id, coalesce(avg(z), 0) AS common_zipf, coalesce(avg(z) FILTER (word NOT IN {_STOP}), 0) AS content_common_zipf,
        coalesce(avg((z < 3.5)::INT) FILTER (word NOT IN {_STOP}), 0) AS rare_word_share, coalesce(avg((z >= 4.5)::INT), 0) AS common_word_share FROM documents LEFT JOIN (SELECT doc_id, word, z FROM tok JOIN freq USING (word)) USING (doc_id) GROUP BY doc_id""",
        ["doc_id"],
        _ZC,
        with_=f"WITH {_TOK}",
    ),
)
def corpus_zipf(spark, sf):
    return shaped(TM.corpus_zipf(word_rows(spark, sf), "doc_id", "w"), ["doc_id"], _ZC)


_LEX = "lex AS (SELECT word, round(4 * (avg(quality) - (SELECT avg(quality) FROM labels)), 3) AS valence FROM (SELECT DISTINCT doc_id, word FROM tok) JOIN labels USING (doc_id) GROUP BY word HAVING count(*) >= 20)"
_MOOD = ["compound", "pos", "neg", "neu", "intensity", "emotion"]


def label_lexicon(rows, labels):
    """Word valence from labels: mean quality of the texts with the word, centred."""
    mean = labels.agg(F.avg("quality").alias("m")).scalar()
    seen = rows.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(labels.select("doc_id", "quality"), "doc_id")
    per = seen.groupBy("word").agg(F.avg("quality").alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)
    return per.select("word", F.round(4 * (F.col("q") - mean), 3).alias("valence"))


@query(
    "lexicon_sentiment",
    sql_shaped(
        """SELECT *, abs(compound) AS intensity, pos + neg AS emotion FROM (SELECT doc_id, x / sqrt(x * x + 15) AS compound, CASE WHEN p + m + u = 0 THEN 0 ELSE p / (p + m + u) END AS pos, CASE WHEN p + m + u = 0 THEN 0 ELSE m / (p + m + u) END AS neg, CASE WHEN p + m + u = 0 THEN 0 ELSE u / (p + m + u) END AS neu FROM (
        SELECT doc_id, coalesce(sum(valence), 0) AS x, coalesce(sum(valence + 1) FILTER (valence > 0), 0) AS p, coalesce(sum(1 - valence) FILTER (valence < 0), 0) AS m, count(word) FILTER (coalesce(valence, 0) = 0) AS u
        FROM documents LEFT JOIN (SELECT doc_id, word, valence FROM tok LEFT JOIN lex USING (word)) USING (doc_id) GROUP BY doc_id))""",
        ["doc_id"],
        _MOOD,
        with_=f"WITH {_TOK},\n{_LEX}",
    ),
)
def lexicon_sentiment(spark, sf):
    rows = word_rows(spark, sf)
    return shaped(TM.lexicon_sentiment(rows, "doc_id", "w", label_lexicon(rows, load(spark, sf, "labels"))), ["doc_id"], _MOOD)


_TERMS = f"""one AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), {S.lit(TM.TERM)}) AS t FROM documents),
term AS (SELECT doc_id, unnest(t) AS term FROM one UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM one WHERE len(t) > 1),
tc AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
voc AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 500),
w AS (SELECT doc_id, term, tf * idf AS w FROM tc JOIN voc USING (term))"""


@query("tfidf", sql_shaped("SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w", ["doc_id", "term"], ["weight"], with_=f"WITH {_TERMS}"))
def tfidf(spark, sf):
    rows = materialise(load(spark, sf, "documents").select("doc_id", TM.terms(F.col("text")).alias("w")), "words")
    counts = TM.term_counts(rows, "doc_id", "w")
    vocab = materialise(TM.vocabulary(counts, load(spark, sf, "documents").count(), 500, 3), "vocabulary")
    cells = TM.tfidf(counts, "doc_id", vocab).select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("c")).select("doc_id", "c.idx", "c.val")
    out = cells.join(F.broadcast(vocab.select("idx", "term")), "idx").withColumn("weight", F.col("val"))
    return shaped(out, ["doc_id", "term"], ["weight"])


# --- surrogates --------------------------------------------------------------------


@query("constant_surrogate", sql_shaped(f"WITH {S.ORD} SELECT split, avg(y - m) AS bias, var_samp(y - m) AS residual_var, avg(y * y) AS zero_mse FROM ord_split, (SELECT avg(y) AS m FROM ord_split WHERE split = 'h_scale') GROUP BY split", ["split"], ["bias", "residual_var", "zero_mse"], 4))
def constant_surrogate(spark, sf):
    df = U.constant_surrogate(orders_split(spark, sf), "y", F.col("split") == "h_scale")
    r = F.col("y") - F.col("pred")
    out = df.groupBy("split").agg(F.avg(r).alias("bias"), F.var_samp(r).alias("residual_var"), F.avg(F.col("y") * F.col("y")).alias("zero_mse"))
    return shaped(out, ["split"], ["bias", "residual_var", "zero_mse"], 4)


ALPHAS = (0.1, 10.0, 1000.0, 100000.0)


def weighted_orders(spark, sf):
    """Orders with the influence weight of x2 taken from the target rows."""
    df = materialise(orders_split(spark, sf), "orders")
    fit = I.fit_ols(moments_of(df.where(F.col("split") == "target"), ["x2"], "y")[()], "x2", ["x2"], "y")
    return df.withColumn("a", I.if_weight(fit))


WORD = S.ORD + f""",
wo AS (SELECT id, y, x1, x2, split, (x2 - mx) / vx AS a FROM ord_split, {fit1("(SELECT * FROM ord_split WHERE split = 'target')", 'y', 'x2')}),
al AS (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha)"""
_JUDGE = """judged AS (SELECT alpha, b0, b1, avg(pow(y - b0 - b1 * x1, 2)) AS stop_mse, var_samp(a * (y - b0 - b1 * x1)) AS stop_ifvar FROM wo, models WHERE split = 'unused' GROUP BY ALL),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {score}, alpha) AS r FROM judged) WHERE r = 1)
SELECT alpha, b0, b1, stop_mse, stop_ifvar, (SELECT var_samp(a * (y - b0 - b1 * x1)) FROM wo WHERE split = 'target') AS ifvar FROM pick"""
_RIDGE = ["alpha", "b0", "b1", "stop_mse", "stop_ifvar", "ifvar"]


def _sql_ridge(models: str, score: str) -> str:
    core = _JUDGE.format(score=score)
    head, tail = core.rsplit("\nSELECT", 1)
    return sql_shaped("SELECT" + tail, [], _RIDGE, 4, with_=f"WITH {WORD},\n{models},\n{head}")


def _judge(df, train, score, fit):
    """Moments of the stop and scale rows, then the path over the alphas."""
    sq = {k[0]: m for k, m in moments_of(df, ["x1"], "y", ["split"], F.col("a") * F.col("a")).items()}
    fi = {k[0]: m for k, m in moments_of(df, ["x1"], "y", ["split"], F.col("a")).items()}
    plain = {k[0]: m for k, m in moments_of(df, ["x1"], "y", ["split"]).items()}
    best = None
    for alpha in ALPHAS:
        beta = fit(train, alpha)
        mse = U.mse_of(beta, plain["unused"], ["x1"], "y")
        ifvar = U.ifvar_of(beta, sq["unused"], fi["unused"], ["x1"], "y", 1)
        value = mse if score == "mse" else ifvar
        if best is None or value < best[0]:
            best = (value, alpha, float(beta[0]), float(beta[1]), mse, ifvar, U.ifvar_of(beta, sq["target"], fi["target"], ["x1"], "y", 1))
    schema = ", ".join(f"{c} double" for c in _RIDGE)
    return shaped(df.sparkSession.createDataFrame([tuple(float(v) for v in best[1:])], schema), [], _RIDGE, 4)


@query("ridge_path", _sql_ridge("models AS (SELECT alpha, sxy / (sxx + alpha) AS b1, my - sxy / (sxx + alpha) * mx AS b0 FROM al, (SELECT regr_sxx(y, x1) AS sxx, regr_sxy(y, x1) AS sxy, avg(y) AS my, avg(x1) AS mx FROM wo WHERE split = 'h_scale'))", "stop_mse"))
def ridge_path(spark, sf):
    df = weighted_orders(spark, sf)
    train = moments_of(df.where(F.col("split") == "h_scale"), ["x1"], "y")[()]
    return _judge(df, train, "mse", lambda m, alpha: U.ridge_from_moments(m, ["x1"], "y", alpha))


@query(
    "ridge_ifweighted",
    _sql_ridge(
        """cw AS (SELECT y, x1, least(a * a, (SELECT quantile_cont(a * a, 0.99) FROM wo WHERE split = 'h_scale')) AS c FROM wo WHERE split = 'h_scale'),
        nw AS (SELECT y, x1, c / avg(c) OVER () AS w FROM cw), mw AS (SELECT sum(w * x1) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM nw),
        models AS (SELECT alpha, sxy / (sxx + alpha) AS b1, my - sxy / (sxx + alpha) * mx AS b0 FROM al, mw, (SELECT sum(w * pow(x1 - mx, 2)) AS sxx, sum(w * (x1 - mx) * (y - my)) AS sxy FROM nw, mw))""",
        "stop_ifvar",
    ),
)
def ridge_ifweighted(spark, sf):
    df = weighted_orders(spark, sf)
    w = I.if_square_weights(df.where(F.col("split") == "h_scale"), "a")
    train = moments_of(w, ["x1"], "y", weight=F.col("w"))[()]
    return _judge(df, train, "ifvar", lambda m, alpha: U.ridge_from_moments(m, ["x1"], "y", alpha))


@query(
    "ridge_ifvar_exact",
    _sql_ridge(
        """ea AS (SELECT regr_sxx(a, a) AS pp, regr_sxy(a, a * x1) AS pq, regr_sxx(a, a * x1) AS qq, regr_sxy(a * y, a) AS pt, regr_sxy(a * y, a * x1) AS qt FROM wo WHERE split = 'h_scale'),
        models AS (SELECT alpha, ((qq + alpha) * pt - pq * qt) / ((pp + alpha) * (qq + alpha) - pq * pq) AS b0, ((pp + alpha) * qt - pq * pt) / ((pp + alpha) * (qq + alpha) - pq * pq) AS b1 FROM al, ea)""",
        "stop_ifvar",
    ),
)
def ridge_ifvar_exact(spark, sf):
    df = weighted_orders(spark, sf)
    aug = U.augmented(df.where(F.col("split") == "h_scale"), "a", ["x1"], "y")
    train = moments_of(aug, ["a", "a_x1"], "a_y")[()]
    return _judge(df, train, "ifvar", lambda m, alpha: U.ridge_ifvar_exact(m, ["x1"], alpha))


_PATH = (0.1, 1.0, 10.0, 100.0)

# With a vocabulary of one term, x is 1 for texts that hold it and 0 for others, and every fit has a closed form.
_ONE_TERM = f"""{S.POP},
one AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), {S.lit(TM.TERM)}) AS t FROM pop),
term AS (SELECT id, unnest(t) AS term FROM one UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM one WHERE len(t) > 1),
top AS (SELECT term FROM term GROUP BY term HAVING count(DISTINCT id) >= 3 ORDER BY count(*) DESC, term LIMIT 1),
hit AS (SELECT DISTINCT id, 1.0 AS x FROM term JOIN top USING (term)),
wb AS (SELECT avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, count(*) AS n, avg(y) AS base FROM pop),
lab AS (SELECT pop.id, y, base, coalesce(x, 0.0) AS x, unnest([
    {{'feature': 'log_word_count', 'a': (x1 - m1) / v1}}, {{'feature': 'reading_ease', 'a': (x2 - m2) / v2}}{{more}}], recursive := true) FROM pop LEFT JOIN hit USING (id), wb),
dealt AS (SELECT *, row_number() OVER (PARTITION BY replication, feature ORDER BY md5(concat_ws(':', 101, replication, 'bands', id)), id) AS r FROM lab, (SELECT unnest(range(3)) AS replication), (SELECT n // 2 AS pool, n // 5 AS stop FROM wb)),
roles AS (SELECT *, CASE WHEN r <= pool THEN 'train' WHEN r <= pool + stop THEN 'stop' ELSE 'scale' END AS role FROM dealt),
sizes AS (SELECT unnest([pool // 8, pool // 2, pool]) AS s FROM (SELECT DISTINCT pool FROM roles)),
al AS (SELECT unnest({list(_PATH)})::DOUBLE AS alpha, unnest(range({len(_PATH)})) AS place),
tr AS (SELECT * FROM roles, sizes WHERE role = 'train' AND r <= s),
plain AS (SELECT replication, feature, s, alpha, place, 'plain' AS fit, sxy / (sxx + alpha) AS b1, my - sxy / (sxx + alpha) * mx AS b0
  FROM (SELECT replication, feature, s, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, avg(y) AS my, avg(x) AS mx FROM tr GROUP BY ALL), al)"""
_ONE_TERM_REST = """,
cap AS (SELECT replication, feature, s, quantile_cont(a * a, 0.99) AS c FROM tr GROUP BY ALL),
cw AS (SELECT tr.*, CASE WHEN c > 0 THEN least(a * a, c) ELSE a * a END AS u FROM tr JOIN cap USING (replication, feature, s)),
nw AS (SELECT *, u / avg(u) OVER (PARTITION BY replication, feature, s) AS w FROM cw),
mw AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS wx, sum(w * y) OVER g / sum(w) OVER g AS wy FROM nw WINDOW g AS (PARTITION BY replication, feature, s)),
weighted AS (SELECT replication, feature, s, alpha, place, 'ifvar_weighted' AS fit, sxy / (sxx + alpha) AS b1, wy - sxy / (sxx + alpha) * wx AS b0
  FROM (SELECT replication, feature, s, any_value(wx) AS wx, any_value(wy) AS wy, sum(w * pow(x - wx, 2)) AS sxx, sum(w * (x - wx) * (y - wy)) AS sxy FROM mw GROUP BY replication, feature, s), al),
exact AS (SELECT replication, feature, s, alpha, place, 'ifvar_exact' AS fit, ((pp + alpha) * qt - pq * pt) / ((pp + alpha) * (qq + alpha) - pq * pq) AS b1, ((qq + alpha) * pt - pq * qt) / ((pp + alpha) * (qq + alpha) - pq * pq) AS b0
  FROM (SELECT replication, feature, s, regr_sxx(a, a) AS pp, regr_sxy(a, a * x) AS pq, regr_sxx(a, a * x) AS qq, regr_sxy(a * y, a) AS pt, regr_sxy(a * y, a * x) AS qt FROM tr GROUP BY ALL), al)"""


def _half_split(spark, sf, max_features):
    """Labelled texts as sparse rows with the IF weight of log_word_count: half train, a fifth stop, the rest scale."""
    rows, p, _ = labelled_text_cells(spark, sf, {"log_word_count": ["log_word_count"]}, 1, max_features, 2)
    return rows.withColumn("a0", F.col("a")[0]), p


def _sparse_exact(spark, sf, max_features, alphas=_PATH):
    rows, p = _half_split(spark, sf, max_features)
    path = SR.sparse_ridge_path(rows.where("role = 'train_pool'"), "y", p, alphas, gain=F.col("a0"))
    fits = spark.createDataFrame(
        [(0, 1, "ifvar_exact", "log_word_count", float(al), k, float(path[0, k]), path[1:, k].tolist()) for k, al in enumerate(alphas)], SU.FIT_SCHEMA
    )
    sums = SU.judged_fits(rows, fits, ["log_word_count"], p)
    n, ar = F.col("n"), F.col("ar")
    out = sums.select("role", "alpha", (F.col("rr") / n).alias("mse"), ((F.col("aarr") - ar * ar / n) / (n - 1)).alias("ifvar"))
    return shaped(out, ["role", "alpha"], ["mse", "ifvar"], 4)


@query("ridge_ifvar_exact_sparse")
def ridge_ifvar_exact_sparse(spark, sf):
    """The exact IF-variance surrogate on all terms of the labelled texts, by conjugate gradients over the table (rows only)."""
    return _sparse_exact(spark, sf, 50_000, (1.0, 10.0, 100.0, 1000.0))


@query(
    "ridge_ifvar_exact_one_term",
    sql_shaped(
        "SELECT role, alpha, avg(pow(y - b0 - b1 * x, 2)) AS mse, var_samp(a * (y - b0 - b1 * x)) AS ifvar FROM exact JOIN roles USING (replication, feature) WHERE role <> 'train' AND feature = 'log_word_count' AND replication = 0 AND s = pool GROUP BY ALL",
        ["role", "alpha"],
        ["mse", "ifvar"],
        4,
        with_=f"WITH {_ONE_TERM.replace('{more}', '')}{_ONE_TERM_REST}".replace("count(DISTINCT id) >= 3", "count(DISTINCT id) >= 2"),
    ),
)
def ridge_ifvar_exact_one_term(spark, sf):
    return _sparse_exact(spark, sf, 1)


@query(
    "score_linear",
    sql_shaped(
        "WITH m AS (SELECT list(v ORDER BY d) AS c FROM (SELECT d, avg(v) AS v FROM (SELECT generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY d)) SELECT vec_id, 0.5 + list_inner_product(embedding::DOUBLE[], c) AS score FROM embeddings, m",
        ["vec_id"],
        ["score"],
    ),
)
def score_linear(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    e = load(spark, sf, "embeddings")
    mean = e.select(array_to_vector("embedding").alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
    return shaped(e.withColumn("score", U.score_linear("embedding", [0.5, *mean.tolist()])), ["vec_id"], ["score"])


@query("batch_score", sql_shaped("SELECT doc_id, length(text) / 100.0 + len(regexp_extract_all(text, 'e')) AS score FROM documents", ["doc_id"], ["score"]))
def batch_score(spark, sf):
    def model(texts):
        return texts.str.len() / 100.0 + texts.str.count("e")

    out = U.batch_score(load(spark, sf, "documents").select("doc_id", "text"), "text", model, batch=64)
    return shaped(out, ["doc_id"], ["score"])


def labelled_term_rows(spark, sf):
    """Labelled distinct texts with the two regressors and their terms, stored once."""
    texts = POP.labelled_texts(load(spark, sf, "documents"), load(spark, sf, "labels"))
    w = texts.withColumn("w", T.words(F.col("text")))
    return materialise(
        w.select(
            "id",
            "y",
            F.log1p(F.size("w")).alias("log_word_count"),
            (T.reading_ease(F.size("w"), T.sentence_runs(F.col("text")), T.syllable_total(F.col("w"))) / 100).alias("reading_ease"),
            TM.terms(F.col("text")).alias("terms"),
        ),
        "texts",
    )


def labelled_text_cells(spark, sf, targets, replications=3, max_features=300, min_df=3):
    """All labelled texts dealt to pool, stop and scale sets (half, a fifth, the rest) of each replication.

    ``targets`` maps a name to the regressors of its target, target first. The
    train sizes are none, an eighth, a half and all of the pool.
    """
    base = labelled_term_rows(spark, sf)
    m = moments_of(base, ["log_word_count", "reading_ease"], "y")[()]
    fits = [I.fit_ols(m, cols[0], cols, "y") for cols in targets.values()]
    pool, stop = m.n // 2, m.n // 5
    weights = F.array(*[I.if_weight(f) for f in fits])
    rows, p = SU.text_cells(base, "id", "terms", "y", weights, range(replications), 101, pool, stop, m.n - pool - stop, max_features, min_df)
    return rows, p, [0, pool // 8, pool // 2, pool]


_TARGETS = {"log_word_count": ["log_word_count"], "reading_ease": ["reading_ease"]}
_SPECS = {**_TARGETS, "log_word_count__reading_ease": ["log_word_count", "reading_ease"]}


@query("surrogate_scaling")
def surrogate_scaling(spark, sf):
    """TF-IDF ridge surrogates on all labelled documents, all objectives (rows only; one term: surrogate_scaling_one_term)."""
    rows, p, grid = labelled_text_cells(spark, sf, _TARGETS)
    return SU.surrogate_scaling(rows, list(_TARGETS), p, grid, _PATH)


@query("spec_scaling")
def spec_scaling(spark, sf):
    """One surrogate judged for several regressions at once by their weights: one fit per (replication, s)."""
    rows, p, grid = labelled_text_cells(spark, sf, _SPECS)
    out = SU.surrogate_scaling(rows, list(_SPECS), p, grid, _PATH, objectives=("mse",))
    return out.withColumnRenamed("feature", "spec_id")


def _one_term_sql(more: str, fits: str, rest: str, uses: str, name: str) -> str:
    judged = f""",
models AS ({fits}),
tried AS (SELECT m.replication, m.feature, m.s, m.fit, m.alpha, m.place,
    avg(pow(y - b0 - b1 * x, 2)) FILTER (role = 'stop') AS stop_mse, var_samp(a * (y - b0 - b1 * x)) FILTER (role = 'stop') AS stop_var, var_samp(a * (y - b0 - b1 * x)) FILTER (role = 'scale') AS ifvar
  FROM models m JOIN roles o ON m.replication = o.replication AND m.feature = o.feature AND o.role <> 'train' GROUP BY ALL),
uses AS (SELECT unnest({uses}, recursive := true)),
scored AS (SELECT *, CASE WHEN by_mse THEN stop_mse ELSE stop_var END AS stop_ifvar FROM tried JOIN uses USING (fit)),
constant AS (SELECT replication, feature, var_samp(a * (y - base)) AS zero FROM roles WHERE role = 'scale' GROUP BY ALL)"""
    core = """SELECT replication, s, feature, training_objective, ifvar, alpha AS selected_alpha, stop_mse, stop_ifvar, ifvar / zero AS ifvar_ratio_to_s0 FROM scored JOIN constant USING (replication, feature)
QUALIFY row_number() OVER (PARTITION BY replication, s, feature, training_objective ORDER BY stop_ifvar, place) = 1
UNION ALL SELECT replication, 0, feature, 'constant', zero, NULL, NULL, NULL, 1.0 FROM constant"""
    with_ = f"WITH {_ONE_TERM.replace('{more}', more)}{rest}{judged}"
    return sql_shaped(f"SELECT * RENAME (feature AS {name}) FROM ({core})", ["replication", "s", name, "training_objective"], _SCALING, 4, with_=with_)


_SCALING = ["ifvar", "selected_alpha", "stop_mse", "stop_ifvar", "ifvar_ratio_to_s0"]
_ALL_USES = "[{'fit': 'plain', 'training_objective': 'mse', 'by_mse': true}, {'fit': 'plain', 'training_objective': 'mse_stop_ifvar', 'by_mse': false}, {'fit': 'ifvar_weighted', 'training_objective': 'ifvar_weighted', 'by_mse': false}, {'fit': 'ifvar_exact', 'training_objective': 'ifvar_exact', 'by_mse': false}]"


@query("surrogate_scaling_one_term", _one_term_sql("", "FROM plain UNION ALL BY NAME FROM weighted UNION ALL BY NAME FROM exact", _ONE_TERM_REST, _ALL_USES, "feature"))
def surrogate_scaling_one_term(spark, sf):
    """The same job over the same rows with the most frequent term alone, for which SQL has a closed form."""
    rows, p, grid = labelled_text_cells(spark, sf, _TARGETS, max_features=1)
    return shaped(SU.surrogate_scaling(rows, list(_TARGETS), p, grid, _PATH), ["replication", "s", "feature", "training_objective"], _SCALING, 4)


_BOTH = ", {'feature': 'log_word_count__reading_ease', 'a': (v2 * (x1 - m1) - c12 * (x2 - m2)) / (v1 * v2 - c12 * c12)}"


@query("spec_scaling_one_term", _one_term_sql(_BOTH, "FROM plain", "", _ALL_USES.split(", {'fit': 'plain', 'training_objective': 'mse_stop")[0] + "]", "spec_id"))
def spec_scaling_one_term(spark, sf):
    """One fit for three regressions with the most frequent term alone."""
    rows, p, grid = labelled_text_cells(spark, sf, _SPECS, max_features=1)
    out = SU.surrogate_scaling(rows, list(_SPECS), p, grid, _PATH, objectives=("mse",)).withColumnRenamed("feature", "spec_id")
    return shaped(out, ["replication", "s", "spec_id", "training_objective"], _SCALING, 4)


def screened_embeddings(spark, sf):
    """Embedding-difference ridge surrogates against two coefficient targets: results and target diagnostics."""
    from ..operators.scaling import pair_embedding, standardize_embedding
    from .project_queries import vector_pairs

    pairs = vector_pairs(spark, sf)
    rows = pairs.select(
        "pair_id",
        pair_embedding(F.col("embedding_a"), F.col("embedding_b"), "a_minus_b").alias("d"),
        (F.col("label_a") - F.col("label_b")).cast("double").alias("y"),
        (F.col("embedding_a")[0] - F.col("embedding_b")[0]).cast("double").alias("x1"),
        (F.col("embedding_a")[1] - F.col("embedding_b")[1]).cast("double").alias("x2"),
    )
    split = X.frac_split(rows, "pair_id", seed=103)
    split = split.withColumn("screen_split", F.when(F.col("split") == "evaluation", "evaluation").otherwise("train_pool"))
    ready = materialise(standardize_embedding(split, "d", F.col("screen_split") == "train_pool", 64), "vectors")
    return SU.embedding_screen(
        ready, "pair_id", "d", 64, "y", {"x1": ["x2"], "x2": []}, [50, 100], [0, 1], [1.0, 10.0, 100.0, 1000.0], 107, 40
    )


@query("embedding_screen")
def embedding_screen(spark, sf):
    """Result rows of the embedding surrogates (rows only)."""
    return screened_embeddings(spark, sf)[0]


@query("embedding_screen_diagnostics")
def embedding_screen_diagnostics(spark, sf):
    """Coefficient, IF variance and weight quantiles of each target (rows only)."""
    return screened_embeddings(spark, sf)[1]


@query("embedding_screen_budgets")
def embedding_screen_budgets(spark, sf):
    """Ratios of the result rows to direct labelling under each budget (rows only)."""
    results = screened_embeddings(spark, sf)[0]
    zero = results.where("method = 'zero_surrogate'").select("target", F.col("ifvar").alias("zero_ifvar"))
    return budget_rows(results.where("s > 0").join(zero, "target"), (300, 500, 1000))


@query("candidate_diagnostics")
def candidate_diagnostics(spark, sf):
    """Every headline feature of the labelled document pairs, with its controls, flags, score and rank (rows only)."""
    pairs = POP.document_pairs(load(spark, sf, "documents"))
    q = load(spark, sf, "labels").select("doc_id", "quality")
    both = q.where(F.col("doc_id") % 2 == 0).select(F.floor(F.col("doc_id") / 2).alias("pair_id"), F.col("quality").alias("qa")).join(
        q.where(F.col("doc_id") % 2 == 1).select(F.floor(F.col("doc_id") / 2).alias("pair_id"), F.col("quality").alias("qb")), "pair_id"
    )
    y = both.select("pair_id", (F.col("qa") - F.col("qb")).cast("double").alias("y"))
    wide = materialise(pairs.join(y, "pair_id"), "pairs")
    split = X.population_split(wide.select("pair_id", "y"), "pair_id", X.sized_fraction(wide, 1.0), X.sized_fraction(wide, 0.4), seed=109)
    features, meta = H.pair_deltas(H.arm_features(H.arms(wide)))
    texts = H.pair_surrogate_text(wide).select("pair_id", "__text").join(split, "pair_id")
    pred, _ = H.tfidf_surrogate(texts, "pair_id", "__text", "y", max_features=200)
    ready = materialise(features.join(split, "pair_id").join(pred, "pair_id"), "screen")
    return screen_score(PL.candidate_diagnostics(ready, meta, H.CORE_CONTROLS, "y", "pred", [500, 1000]))


# --- streams -------------------------------------------------------------------------


@query(
    "stream_ppi_mean",
    sql_shaped(
        """SELECT event_type, count(*) FILTER (k)::BIGINT AS correction_size, count(*) FILTER (NOT k)::BIGINT AS unlabeled_size, avg(value - f) FILTER (k) + avg(f) FILTER (NOT k) AS mu_hat_ppi,
        var_samp(value - f) FILTER (k) / count(*) FILTER (k) + var_samp(f) FILTER (NOT k) / count(*) FILTER (NOT k) AS ppi_var_est, avg(value) FILTER (k) AS sample_mean
        FROM (SELECT event_type, value, user_id % 3 = 0 AS k, (props->>'k')::DOUBLE / 5 AS f FROM events) GROUP BY event_type""",
        ["event_type", "correction_size", "unlabeled_size"],
        ["mu_hat_ppi", "ppi_var_est", "sample_mean"],
    ),
)
def stream_ppi_mean(spark, sf):
    """Events stream in; users of one class are labelled, a property gives the prediction."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = events.select("event_type", "value", (F.get_json_object("props", "$.k").cast("double") / 5).alias("f"), (F.col("user_id") % 3 == 0).alias("k"))
    out = jobs.stream_ppi_mean(rows, ["event_type"], "value", "f", F.col("k"), ~F.col("k"), F.col("k"))
    return shaped(out, ["event_type", "correction_size", "unlabeled_size"], ["mu_hat_ppi", "ppi_var_est", "sample_mean"])


@query(
    "stream_cell_metrics",
    sql_shaped("SELECT method, budget, s_train, count(*)::BIGINT AS completed, avg(ppi_var_est) AS mean_var, avg(ppi_var_est / sample_mean_var_est) AS mean_ratio, avg(validation_rmse) AS mean_rmse FROM cells GROUP BY ALL", ["method", "budget", "s_train", "completed"], ["mean_var", "mean_ratio", "mean_rmse"], with_=f"WITH {PILOT},\n{CELLS}"),
)
def stream_cell_metrics(spark, sf):
    path = scratch(spark, "arriving")
    cells = allocation_cells(spark, sf)
    # every file arrives twice: a cell still counts once
    sinks.write_metrics_json(cells.unionByName(cells).repartition(8, "replication"), path, _NESTED)
    out = jobs.stream_cell_metrics(spark, path)
    return shaped(out, ["method", "budget", "s_train", "completed"], ["mean_var", "mean_ratio", "mean_rmse"])
