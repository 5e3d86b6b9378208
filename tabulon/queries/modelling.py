"""Model types and the operations on them."""

from pyspark.sql import functions as F

from ..models.catalogue import CLASSIFIERS, REGRESSORS
from ..models.training import feature_importance, fit_model, load_model, top_importance
from ..operators.validate import explainability_check
from ..plans.chain import Package, end_to_end, package
from ..plans.preprocess import apply_preprocessing, fit_features
from ..plans.training import cross_val_score, grid_search, metric_rows, predict, train_model
from ..session import scratch_path
from .base import Tables, query, rounded

MEASURES = ["chars", "words", "lines"]


def _measures(t: Tables):
    """Simple measures of the whole text of every document."""
    words = F.size(F.split("text", r"\s+"))
    return t.documents.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("chars"), words.cast("double").alias("words"),
        F.regexp_count("text", F.lit("\n")).cast("double").alias("lines"),
    )


def _documents(t: Tables):
    """Quality of labelled documents with their measures."""
    return t.labels.join(_measures(t), "doc_id").select("doc_id", *MEASURES, "quality")


def _lines(t: Tables):
    return t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_extendedprice")


def _orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _register(model_type: str) -> None:
    if model_type in CLASSIFIERS:
        @query(model_type)
        def classify(t: Tables):
            model = fit_model(_documents(t), "quality", model_type, None, MEASURES, "doc_id")
            return model.transform(_measures(t), "doc_id").select("doc_id", "prediction")
    else:
        @query(model_type)
        def regress(t: Tables):
            df = _lines(t)
            model = fit_model(df, "l_extendedprice", model_type)
            return rounded(model.transform(df))


BY_SQL = {"knn_classifier", "naive_bayes", "knn_regressor", "linear_regression"}
for _name in (*CLASSIFIERS, *REGRESSORS):
    if _name not in BY_SQL:
        _register(_name)


NEAR = """(SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rank FROM (
    SELECT a.c_custkey AS q, b.c_custkey AS r, {label} AS y,
           sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal)
                + CAST((a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey) AS DOUBLE)) AS d
    FROM customer a CROSS JOIN customer b))"""


@query(
    "knn_classifier",
    f"""SELECT q AS c_custkey, y AS prediction FROM (
        SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, y) AS v
        FROM {NEAR.format(label='b.c_mktsegment')} WHERE rank <= 5 GROUP BY q, y) WHERE v = 1""",
)
def knn_classifier(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    model = fit_model(df, "c_mktsegment", "knn_classifier", None, ["c_acctbal", "c_nationkey"], "c_custkey")
    return model.transform(df, "c_custkey").select("c_custkey", "prediction")


@query(
    "knn_regressor",
    f"""SELECT q AS c_custkey, round(avg(y), 4) AS prediction FROM {NEAR.format(label='CAST(length(b.c_mktsegment) AS DOUBLE)')}
        WHERE rank <= 5 GROUP BY q""",
)
def knn_regressor(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", F.length("c_mktsegment").alias("width"))
    model = fit_model(df, "width", "knn_regressor", None, ["c_acctbal", "c_nationkey"], "c_custkey")
    return rounded(model.transform(df, "c_custkey").select("c_custkey", "prediction"))


BAYES_FEATURES = ("o_totalprice", "o_custkey")


def _bayes_sql() -> str:
    eps = "1e-9 * (SELECT greatest(" + ", ".join(f"var_pop({c})" for c in BAYES_FEATURES) + ") FROM orders)"
    moments = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + {eps} AS v_{c}" for c in BAYES_FEATURES)
    terms = "".join(
        f" - 0.5 * ln(2 * pi() * v_{c}) - (o.{c} - m_{c}) * (o.{c} - m_{c}) / (2 * v_{c})" for c in BAYES_FEATURES
    )
    return f"""WITH f AS (SELECT o_orderpriority AS k, ln(1.0 * count(*) / (SELECT count(*) FROM orders)) AS p, {moments}
                          FROM orders GROUP BY 1)
        SELECT o_orderkey, k AS prediction FROM (
          SELECT o_orderkey, k, row_number() OVER (PARTITION BY o_orderkey ORDER BY p{terms} DESC, k) AS r
          FROM orders o CROSS JOIN f) WHERE r = 1"""


@query("naive_bayes", _bayes_sql())
def naive_bayes(t: Tables):
    df = _orders(t)
    model = fit_model(df, "o_orderpriority", "naive_bayes", None, list(BAYES_FEATURES))
    return model.transform(df).select("o_orderkey", "prediction")


LINEAR_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + b * l_quantity, 3) AS prediction FROM lineitem,
    (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)"""


def _linear(t: Tables):
    return fit_model(t.lineitem, "l_extendedprice", "linear_regression", None, ["l_quantity"])


@query("linear_regression", LINEAR_SQL)
def linear_regression(t: Tables):
    scored = _linear(t).transform(t.lineitem)
    return rounded(scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "prediction"), 3)


#: the best split of rows (n node, f feature, x value, g gradient, h hessian): missing values to either side, ties to the first
#: feature, the lowest threshold, missing values left
SPLIT_SQL = """{p}v AS (SELECT n, f, x, sum(g) AS g, sum(h) AS h FROM {rows} GROUP BY ALL),
{p}t AS (SELECT n, f, sum(g) AS tg, sum(h) AS th, coalesce(sum(g) FILTER (x IS NULL), 0) AS mg, coalesce(sum(h) FILTER (x IS NULL), 0) AS mh FROM {p}v GROUP BY ALL),
{p}c AS (SELECT n, f, lead(x) OVER w AS threshold, sum(g) OVER w AS bg, sum(h) OVER w AS bh FROM {p}v WHERE x IS NOT NULL WINDOW w AS (PARTITION BY n, f ORDER BY x)),
{p}s AS (SELECT c.n, c.f, coalesce(threshold, 1e300) AS threshold, side, bg + side * mg AS gl, bh + side * mh AS hl, tg, th FROM {p}c c JOIN {p}t t ON c.n = t.n AND c.f = t.f, (VALUES (1), (0)) AS sides(side)),
{p} AS (SELECT *, (gl * gl / (hl + {reg}) + (tg - gl) * (tg - gl) / (th - hl + {reg}) - tg * tg / (th + {reg})) / 2 AS gain
  FROM {p}s WHERE hl >= {least} AND th - hl >= {least} AND (side = 1 OR th - hl > 0) QUALIFY row_number() OVER (ORDER BY round(gain, 6) DESC, n, f, threshold, side DESC) = 1)"""
STUMP = ["l_quantity", "l_discount", "l_tax"]
STUMP_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _stump_sql(label: str, gradient: str, hessian: str, base: str, output: str) -> str:
    """One round of depth 1: the split of largest gain over three features, one with missing values."""
    split = SPLIT_SQL.format(p="best", rows="rows", reg=1.0, least=1.0)
    held = "CASE f WHEN 0 THEN CAST(l_quantity AS DOUBLE) WHEN 1 THEN CAST(l_discount AS DOUBLE) ELSE tax END"
    return f"""WITH d AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN CAST(l_tax AS DOUBLE) END AS tax, {label} AS y FROM lineitem),
        b AS (SELECT {base} AS base FROM d), g AS (SELECT *, {gradient} AS g, {hessian} AS h FROM d, b),
        rows AS (SELECT 0 AS n, 0 AS f, CAST(l_quantity AS DOUBLE) AS x, g, h FROM g UNION ALL SELECT 0, 1, CAST(l_discount AS DOUBLE), g, h FROM g
                 UNION ALL SELECT 0, 2, tax, g, h FROM g), {split},
        m AS (SELECT {', '.join(STUMP_KEYS)}, base + 0.1 * CASE WHEN {held} < threshold OR ({held} IS NULL AND side = 1) THEN -gl / (hl + 1)
              ELSE -(tg - gl) / (th - hl + 1) END AS z FROM g, best)
        SELECT {', '.join(STUMP_KEYS)}, {output} FROM m"""


def _stump(t: Tables, model_type: str, target: str, params: dict):
    df = t.lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax"))).withColumn("late", (F.col("l_shipdate") > F.lit("1995-06-17")).cast("int"))
    return fit_model(df, target, model_type, params, STUMP).transform(df)


@query("xgboost_regressor_round", _stump_sql("CAST(l_extendedprice AS DOUBLE)", "base - y", "1.0", "avg(y)", "round(z, 3) AS prediction"))
def xgboost_regressor_round(t: Tables):
    """One round of one split, with missing values in a feature."""
    scored = _stump(t, "xgboost_regressor", "l_extendedprice", {"n_estimators": 1, "max_depth": 1})
    return scored.select(*STUMP_KEYS, F.round("prediction", 3).alias("prediction"))


@query("xgboost_classifier_round", _stump_sql(
    "CASE WHEN l_shipdate > '1995-06-17' THEN 1.0 ELSE 0.0 END", "1 / (1 + exp(-base)) - y", "(1 / (1 + exp(-base))) * (1 - 1 / (1 + exp(-base)))",
    "ln(avg(y) / (1 - avg(y)))", "CASE WHEN z > 0 THEN 1 ELSE 0 END AS prediction, round(1 / (1 + exp(-z)), 6) AS p1",
))
def xgboost_classifier_round(t: Tables):
    scored = _stump(t, "xgboost_classifier", "late", {"n_estimators": 1, "max_depth": 1})
    return scored.select(*STUMP_KEYS, "prediction", F.round(F.get("probability", F.lit(1)), 6).alias("p1"))


def _two_splits_sql() -> str:
    """One round of three leaves: the best split of all rows, then the best one of either half."""
    first = SPLIT_SQL.format(p="one", rows="roots", reg=0.0, least=20.0)
    second = SPLIT_SQL.format(p="two", rows="halves", reg=0.0, least=20.0)
    value = "CASE {f} WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END"
    each = lambda source, node: " UNION ALL ".join(f"SELECT {node} AS n, {i} AS f, CAST({c} AS DOUBLE) AS x, g, 1.0 AS h FROM {source}" for i, c in enumerate(STUMP))
    return f"""WITH b AS (SELECT avg(l_extendedprice) AS base FROM lineitem), g AS (SELECT *, base - l_extendedprice AS g FROM lineitem, b),
        roots AS ({each('g', '0')}), {first}, h AS (SELECT g.*, CASE WHEN {value.format(f='one.f')} < one.threshold THEN 0 ELSE 1 END AS half FROM g, one),
        halves AS ({each('h', 'half')}), {second},
        l AS (SELECT h.*, CASE WHEN half <> two.n THEN 2 WHEN {value.format(f='two.f')} < two.threshold THEN 0 ELSE 1 END AS leaf FROM h, two),
        w AS (SELECT leaf, -sum(g) / count(*) AS w FROM l GROUP BY leaf)
        SELECT {', '.join(STUMP_KEYS)}, round(base + 0.1 * w, 3) AS prediction FROM l JOIN w USING (leaf)"""


@query("lightgbm_regressor_round", _two_splits_sql())
def lightgbm_regressor_round(t: Tables):
    """One round of three leaves, best first."""
    model = fit_model(t.lineitem, "l_extendedprice", "lightgbm_regressor", {"n_estimators": 1, "num_leaves": 3}, STUMP)
    return model.transform(t.lineitem).select(*STUMP_KEYS, F.round("prediction", 3).alias("prediction"))


@query("model_save")
def model_save(t: Tables):
    path = scratch_path(t.spark, "model")
    model = train_model(_documents(t), "quality", "logistic_regression", ["doc_id"])
    model.save(path)
    about = t.spark.read.text(f"{path}/about")
    return about.select(
        *[F.get_json_object("value", f"$.{k}").alias(k) for k in ("model_type", "is_classifier", "target", "features")]
    )


@query("model_load", LINEAR_SQL)
def model_load(t: Tables):
    path = scratch_path(t.spark, "model")
    _linear(t).save(path)
    scored = load_model(t.spark, path).transform(t.lineitem)
    return rounded(scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "prediction"), 3)


@query("train_model")
def train_query(t: Tables):
    model = train_model(
        _documents(t), "quality", "random_forest_classifier", ["doc_id"], cv_folds=5
    )
    return rounded(metric_rows(t.spark, model.info), 6)


@query("cross_val_score")
def cross_val_query(t: Tables):
    scores = cross_val_score(_documents(t), "quality", "logistic_regression", ["doc_id"], 5)
    rows = [(i, float(s)) for i, s in enumerate(scores)]
    return rounded(t.spark.createDataFrame(rows, "fold int, score double"), 6)


@query("grid_search")
def grid_query(t: Tables):
    _, results = grid_search(
        _documents(t), "quality", "random_forest_classifier", ["doc_id"], {"n_estimators": [10, 20], "max_depth": [3, 5]}, 3
    )
    rows = [(str(sorted(r["params"].items())), r["mean_score"], r["std_score"]) for r in results]
    return rounded(t.spark.createDataFrame(rows, "params string, mean_score double, std_score double"), 6)


@query("train_with_preprocessing")
def train_preprocessed(t: Tables):
    outcome = apply_preprocessing(t.documents.select("doc_id", "lang", "n_chars"), {"encoding": "lang", "normalization": "n_chars"})
    if outcome.errors:
        raise ValueError("; ".join(outcome.errors))
    known = outcome.data.join(t.labels.select("doc_id", "quality"), "doc_id")
    model, _ = grid_search(known, "quality", "logistic_regression", ["doc_id"], {"C": [0.1, 1.0]}, 3)
    return model.transform(outcome.data).select("doc_id", "prediction")


@query("predict")
def predict_query(t: Tables):
    model = train_model(_documents(t), "quality", "logistic_regression", ["doc_id"])
    scored = predict(model, _measures(t))
    return rounded(
        scored.select("doc_id", "prediction", *[F.get("probability", F.lit(i)).alias(f"p{i}") for i in (0, 1)]), 6
    )


@query("batch_score")
def batch_score(t: Tables):
    vectors = t.embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(64)])
    model = fit_model(
        vectors, "label", "logistic_regression", None, [f"x{i}" for i in range(64)]
    )
    return predict(model, vectors).select("vec_id", "label", "prediction")


@query("packaged_inference")
def packaged_inference(t: Tables):
    df = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")
    fitted = fit_features(df, "l_extendedprice", selection="f_score", max_features=5)
    model = fit_model(fitted.fitting, "l_extendedprice", "ridge", None, fitted.selected)
    path = scratch_path(t.spark, "package")
    package(fitted, model, df.columns, t.spark).save(path)
    loaded = Package.load(t.spark, path)
    unseen = df.withColumn("l_returnflag", F.when(F.col("l_quantity") > 45, "?").otherwise(F.col("l_returnflag")))
    return rounded(loaded.score(unseen).select("prediction"), 3)


def _importance(t: Tables):
    df = _documents(t)
    model = fit_model(
        df, "quality", "random_forest_classifier", None, MEASURES
    )
    return feature_importance(model, t.spark)


@query("feature_importance")
def importance_query(t: Tables):
    return rounded(_importance(t), 6)


@query("top_importance")
def top_importance_query(t: Tables):
    return rounded(top_importance(_importance(t), 20), 6)


@query("explainability_check")
def explainability_query(t: Tables):
    return rounded(explainability_check(_importance(t)), 6)


@query("end_to_end")
def end_to_end_query(t: Tables):
    df = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", "quality"
    )
    out = end_to_end(
        df, "quality", ["doc_id"], scratch_path(t.spark, "chain"), "random_forest"
    )
    return rounded(out["report"], 6)


