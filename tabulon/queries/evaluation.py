"""Metrics, curves and validation."""

from pyspark.sql import functions as F

from ..operators.knn import knn_join
from ..operators.knn_blocks import approximate_knn_join
from ..operators.metrics import (
    averaged_metrics, classification_metrics, classification_report, clustering_metrics, confusion_matrix, log_loss,
    mape, pr_curve, prediction_statistics, regression_metrics, roc_auc, roc_curve, silhouette_by_label, threshold_optimize,
)
from ..operators.validate import (
    alert_thresholds, drift_ks, fairness, performance_gate, threshold_check, validation_report,
)
from .base import Tables, query, rounded

# a deterministic stand-in prediction: the next status for every third order
SCORED = """(SELECT o_orderstatus AS label, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus WHEN o_orderstatus = 'F' THEN 'O'
            WHEN o_orderstatus = 'O' THEN 'P' ELSE 'F' END AS prediction FROM orders)"""


def _scored(t: Tables):
    s = F.col("o_orderstatus")
    moved = F.when(F.col("o_orderkey") % 3 != 0, s).when(s == "F", "O").when(s == "O", "P").otherwise("F")
    return t.orders.select(s.alias("label"), moved.alias("prediction"))


BINARY = """(SELECT quality AS label, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS prediction FROM labels)"""


def _binary(t: Tables):
    q = F.col("quality")
    return t.labels.select(q.alias("label"), F.when(F.col("doc_id") % 4 == 0, 1 - q).otherwise(q).alias("prediction"))


def classes_sql(source: str) -> str:
    """Per-class precision, recall, F1 and support by plain counting."""
    return f"""(SELECT class, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE 1.0 * hits / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE 1.0 * hits / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0 * hits / (predicted + support) END AS f1
        FROM (SELECT class, (SELECT count(*) FROM {source} WHERE label = class) AS support,
                     (SELECT count(*) FROM {source} WHERE prediction = class) AS predicted,
                     (SELECT count(*) FROM {source} WHERE label = class AND prediction = class) AS hits
              FROM (SELECT label AS class FROM {source} UNION SELECT prediction FROM {source})))"""


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS count FROM {SCORED} GROUP BY 1, 2")
def confusion_query(t: Tables):
    return confusion_matrix(_scored(t), "label", "prediction")


WEIGHTED = ", ".join(f"round(sum({c} * support) / sum(support), 6) AS {n}" for c, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score")))


@query(
    "classification_metrics",
    f"""SELECT round(sum(hits) / sum(support), 6) AS accuracy, {WEIGHTED}, CAST(sum(support) AS BIGINT) AS n
        FROM {classes_sql(SCORED)}""",
)
def classification_query(t: Tables):
    return rounded(classification_metrics(_scored(t), "label", "prediction"), 6)


@query(
    "classification_report",
    f"""WITH c AS (SELECT * FROM {classes_sql(SCORED)})
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM c
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                         round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
                         round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c""",
)
def report_query(t: Tables):
    return rounded(classification_report(_scored(t), "label", "prediction"), 6)


@query(
    "metrics_binary_average",
    f"""SELECT round((SELECT sum(hits) / sum(support) FROM {classes_sql(BINARY)}), 6) AS accuracy,
        round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score
        FROM {classes_sql(BINARY)} WHERE class = 1""",
)
def binary_average(t: Tables):
    return rounded(averaged_metrics(_binary(t), "label", "prediction"), 6)


# scores: share of the largest quantity, label: line status
CURVE = "(SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, l_extendedprice AS s FROM lineitem)"


def _curve(t: Tables):
    return t.lineitem.select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), F.col("l_extendedprice").alias("s")
    )


TOTALS = f"""(SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, p, n
             FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {CURVE} GROUP BY s))"""
ALL_POS, ALL_NEG = f"(SELECT sum(y) FROM {CURVE})", f"(SELECT sum(1 - y) FROM {CURVE})"
ROC_SQL = f"""SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
    UNION ALL SELECT s, fp / {ALL_NEG}, tp / {ALL_POS} FROM {TOTALS}"""
PR_SQL = f"""SELECT CAST(NULL AS DOUBLE) AS threshold, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall
    UNION ALL SELECT s, tp / (tp + fp), tp / {ALL_POS} FROM {TOTALS}"""


@query("roc_curve", ROC_SQL)
def roc_curve_query(t: Tables):
    return roc_curve(_curve(t), "y", "s")


@query("roc_points", ROC_SQL.replace("l_extendedprice", "l_quantity"))
def roc_points(t: Tables):
    df = t.lineitem.select(F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("s"))
    return roc_curve(df, "y", "s")


@query(
    "roc_auc",
    f"""SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - {ALL_POS} * ({ALL_POS} + 1) / 2.0) / ({ALL_POS} * {ALL_NEG}), 6) AS roc_auc
        FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {CURVE})""",
)
def roc_auc_query(t: Tables):
    return rounded(roc_auc(_curve(t), "y", "s"), 6)


@query("pr_curve", PR_SQL)
def pr_curve_query(t: Tables):
    return pr_curve(_curve(t), "y", "s")


@query("pr_points", PR_SQL.replace("l_extendedprice", "l_quantity"))
def pr_points(t: Tables):
    df = t.lineitem.select(F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("s"))
    return pr_curve(df, "y", "s")


@query(
    "threshold_optimize",
    f"""SELECT s AS threshold, round(2 * tp / (tp + fp + {ALL_POS}), 6) AS f1, round(tp / (tp + fp), 6) AS precision,
        round(tp / {ALL_POS}, 6) AS recall FROM {TOTALS} ORDER BY 2 * tp / (tp + fp + {ALL_POS}) DESC, s DESC LIMIT 1""",
)
def threshold_optimize_query(t: Tables):
    best = threshold_optimize(_curve(t), "y", "s")
    return best.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


FORECAST = "(SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p FROM lineitem)"


def _forecast(t: Tables):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@query(
    "regression_metrics",
    f"""SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
        round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2_score, count(*) AS n
        FROM {FORECAST}""",
)
def regression_query(t: Tables):
    out = regression_metrics(_forecast(t), "y", "p")
    digits = {"mse": 2, "rmse": 4, "mae": 4, "r2_score": 6}
    return out.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "n")


@query(
    "log_loss",
    """SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM (
       SELECT quality AS y, least(greatest((doc_id % 101) / 100.0, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM labels)""",
)
def log_loss_query(t: Tables):
    df = t.labels.select("quality", (F.col("doc_id") % 101 / 100.0).alias("p"))
    return rounded(log_loss(df, "quality", "p"), 6)


@query("mape", f"SELECT round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape FROM {FORECAST}")
def mape_query(t: Tables):
    return rounded(mape(_forecast(t), "y", "p"), 6)


@query(
    "prediction_statistics",
    f"SELECT round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, CAST(min(p) AS DOUBLE) AS min, CAST(max(p) AS DOUBLE) AS max FROM {FORECAST}",
)
def prediction_statistics_query(t: Tables):
    return rounded(prediction_statistics(_forecast(t), "p"))


CLUSTER_SQL = """
WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i), g AS (SELECT i, avg(x) AS g FROM e GROUP BY i),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
d AS (SELECT vec_id, e.label, sum((x - c) * (x - c)) AS d2 FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY vec_id, e.label),
w AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s FROM d GROUP BY label),
b AS (SELECT sum(n * q) AS b FROM sizes JOIN (SELECT label, sum((c - g) * (c - g)) AS q FROM c JOIN g ON g.i = c.i GROUP BY label) z
      ON z.label = sizes.label),
pairs AS (SELECT x.label AS l, y.label AS m, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS gap FROM c x JOIN c y ON x.i = y.i AND x.label <> y.label
          GROUP BY x.label, y.label),
db AS (SELECT avg(r) AS db FROM (SELECT l, max((a.s + z.s) / gap) AS r FROM pairs JOIN w a ON a.label = l JOIN w z ON z.label = m GROUP BY l)),
k AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM sizes),
{silhouettes}
SELECT k AS clusters, n, round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k)), 4) AS calinski_harabasz,
       round(db, 4) AS davies_bouldin, (SELECT round(avg(v), 4) FROM one) AS silhouette FROM k, b, db"""
#: silhouettes of single rows by all pairs; a row alone in its cluster has 0
SILHOUETTES = """gaps AS (SELECT a.vec_id AS q, a.label AS l, z.label AS m, sum((a.x - z.x) * (a.x - z.x)) AS d FROM e a JOIN e z ON a.i = z.i GROUP BY 1, 2, 3),
sides AS (SELECT q, l, max(CASE WHEN m = l THEN d / greatest(n - 1, 1) END) AS i, min(CASE WHEN m <> l THEN d / n END) AS o,
          max(CASE WHEN m = l THEN n END) AS n FROM gaps JOIN sizes ON sizes.label = m GROUP BY q, l),
one AS (SELECT l, CASE WHEN n > 1 AND greatest(i, o) > 0 THEN (o - i) / greatest(i, o) ELSE 0 END AS v FROM sides)"""
CLUSTER_SQL = CLUSTER_SQL.replace("{silhouettes}", SILHOUETTES)


@query("clustering_metrics", CLUSTER_SQL)
def clustering_query(t: Tables):
    return rounded(clustering_metrics(t.embeddings, "embedding", "label"))


@query(
    "silhouette",
    f"""WITH e AS (SELECT vec_id, 'c' || label AS label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    sizes AS (SELECT 'c' || label AS label, count(*) AS n FROM embeddings GROUP BY label), {SILHOUETTES}
    SELECT l AS label, count(*) AS n, round(avg(v), 6) AS silhouette FROM one GROUP BY l""",
)
def silhouette_query(t: Tables):
    """Silhouettes by text labels."""
    named = t.embeddings.select("embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))
    return rounded(silhouette_by_label(named, "embedding", "label"), 6)


@query(
    "threshold_check",
    f"""WITH m AS (SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
        sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1_score FROM {classes_sql(SCORED)})
        SELECT metric, round(value, 6) AS value, threshold, value >= threshold AS meets_threshold FROM (
        SELECT 'accuracy' AS metric, accuracy AS value, 0.85::DOUBLE AS threshold FROM m UNION ALL
        SELECT 'precision', precision, 0.8 FROM m UNION ALL SELECT 'recall', recall, 0.8 FROM m UNION ALL
        SELECT 'f1_score', f1_score, 0.8 FROM m)""",
)
def threshold_check_query(t: Tables):
    return rounded(threshold_check(classification_metrics(_scored(t), "label", "prediction")), 6)


def _drift_sql(old: str, new: str, columns: tuple[str, ...]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""(WITH v AS (SELECT {c} AS v, 1 AS a, 0 AS b FROM {old} UNION ALL SELECT {c}, 0, 1 FROM {new}),
            g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v), t AS (SELECT sum(a) AS n, sum(b) AS m FROM g),
            r AS (SELECT sum(a) OVER (ORDER BY v) / n AS f1, sum(b) OVER (ORDER BY v) / m AS f2 FROM g, t),
            d AS (SELECT max(abs(f1 - f2)) AS d FROM r)
            SELECT '{c}' AS "column", CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, d AS ks,
            (SELECT least(1, greatest(0, 2 * sum(pow(-1, k - 1) * exp(-2 * k * k * d * d * n * m / (n + m)))))
             FROM (SELECT unnest(range(1, 101)) AS k)) AS p FROM d, t)"""
        )
    return " UNION ALL ".join(f"SELECT * FROM {p} x" for p in parts)


OLD, NEW = (f"(SELECT * FROM orders WHERE o_orderdate {op} TIMESTAMP '1998-01-01')" for op in ("<", ">="))


@query(
    "drift_ks",
    f"""SELECT "column", n, m, round(ks, 6) AS ks_statistic, round(p, 6) AS p_value, p < 0.1 AS drift
        FROM ({_drift_sql(OLD, NEW, ("o_orderkey", "o_custkey", "o_totalprice"))})""",
)
def drift_query(t: Tables):
    old = t.orders.where("o_orderdate < timestamp_ntz'1998-01-01'")
    new = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'")
    return rounded(drift_ks(old, new), 6)


# one run per order: some lack the primary metric
RUNS = """(SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'regression' ELSE 'classification' END AS task,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderstatus <> 'F' THEN o_totalprice / 500000 END AS f1_score,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus <> 'F' THEN o_totalprice / 400000 END AS accuracy,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus = 'F' THEN o_totalprice / 450000 END AS r2_score,
    CASE WHEN o_orderkey % 4 <> 0 AND o_orderstatus = 'F' THEN o_totalprice / 600000 END AS mse FROM orders)"""


def _runs(t: Tables):
    regression = F.col("o_orderstatus") == "F"

    def metric(name: str, step: int, scale: float, wanted):
        kept = (F.col("o_orderkey") % step != 0) & wanted
        return F.struct(F.lit(name).alias("k"), F.when(kept, F.col("o_totalprice") / scale).alias("v"))

    entries = F.array(
        metric("f1_score", 5, 500000, ~regression), metric("accuracy", 7, 400000, ~regression),
        metric("r2_score", 3, 450000, regression), metric("mse", 4, 600000, regression),
    )
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(regression, "regression").otherwise("classification").alias("task"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("metrics"),
    )


@query(
    "performance_gate",
    f"""SELECT run_id, primary_metric, value,
        coalesce(CASE WHEN primary_metric = 'mse' THEN value <= 0.85 ELSE value >= 0.85 END, false) AS passed FROM (
        SELECT run_id, CASE WHEN task = 'classification' THEN CASE WHEN f1_score IS NOT NULL THEN 'f1_score'
                 WHEN accuracy IS NOT NULL THEN 'accuracy' END
               WHEN r2_score IS NOT NULL THEN 'r2_score' WHEN mse IS NOT NULL THEN 'mse' END AS primary_metric,
               CASE WHEN task = 'classification' THEN coalesce(f1_score, accuracy) ELSE coalesce(r2_score, mse) END AS value
        FROM {RUNS})""",
)
def performance_gate_query(t: Tables):
    return performance_gate(_runs(t)).select("run_id", "primary_metric", "value", "passed")


GROUPS = """(SELECT lang, CAST(toxic AS VARCHAR) AS toxic, quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p
            FROM labels JOIN documents ON documents.doc_id = labels.doc_id)"""


def _groups(t: Tables):
    df = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return df.select("lang", "toxic", F.col("quality").alias("y"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("p"))


@query(
    "fairness",
    f"""WITH s AS (SELECT 'lang' AS feature, lang AS "group", avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS score FROM {GROUPS} GROUP BY lang
        UNION ALL SELECT 'toxic', toxic, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM {GROUPS} GROUP BY toxic),
        d AS (SELECT feature, max(score) - min(score) AS difference FROM s GROUP BY feature HAVING count(*) BETWEEN 2 AND 10)
        SELECT s.feature, "group", round(score, 6) AS score, round(difference, 6) AS difference, difference > 0.1 AS potential_bias
        FROM s JOIN d ON d.feature = s.feature""",
)
def fairness_query(t: Tables):
    return rounded(fairness(_groups(t), ["lang", "toxic"], "y", "p"), 6)


@query(
    "validation_report",
    f"""WITH m AS (SELECT sum(hits) / sum(support) AS a, sum(f1 * support) / sum(support) AS f FROM {classes_sql(SCORED)}),
        d AS (SELECT bool_or(p < 0.05) AS drift FROM ({_drift_sql(OLD, NEW, ("o_custkey", "o_totalprice"))}))
        SELECT round(a, 6) AS accuracy, round(f, 6) AS f1_score, f >= 0.6 AS performance_valid, drift AS drift_detected,
               f >= 0.6 AND NOT drift AS model_valid FROM m, d""",
)
def validation_report_query(t: Tables):
    old = t.orders.where("o_orderdate < timestamp_ntz'1998-01-01'")
    new = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'")
    drift = drift_ks(old, new, ["o_custkey", "o_totalprice"], threshold=0.05)
    return rounded(validation_report(_scored(t), "label", "prediction", drift, 0.6), 6)


def _month_sql(month: int) -> str:
    source = f"(SELECT * FROM events WHERE month(ts) = 1 AND day(ts) {'<= 15' if month == 0 else '> 15'})"
    return f"""SELECT 'accuracy' AS metric, avg(CASE WHEN event_type <> 'click' THEN 1.0 ELSE 0.0 END) AS value FROM {source}
        UNION ALL SELECT 'prediction_mean', avg(value) FROM {source} UNION ALL SELECT 'feature_mean', avg(user_id) FROM {source}
        UNION ALL SELECT 'error_rate', avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM {source}"""


@query(
    "alert_thresholds",
    f"""WITH j AS (SELECT b.metric, b.value AS b, c.value AS c FROM ({_month_sql(0)}) b JOIN ({_month_sql(1)}) c ON b.metric = c.metric),
        x AS (SELECT *, CASE metric WHEN 'accuracy' THEN b - c WHEN 'error_rate' THEN c ELSE abs(c - b) / greatest(abs(b), 1e-12) END AS change,
              CASE WHEN metric IN ('accuracy', 'error_rate') THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS "limit" FROM j)
        SELECT metric, round(b, 6) AS baseline, round(c, 6) AS current, round(change, 6) AS change, "limit", change > "limit" AS alert FROM x""",
)
def alert_query(t: Tables):
    def metrics(df):
        row = df.agg(
            F.avg((F.col("event_type") != "click").cast("double")).alias("accuracy"), F.avg("value").alias("prediction_mean"),
            F.avg("user_id").alias("feature_mean"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"),
        )
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns]
        return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")

    before, after = t.events.where("day(ts) <= 15"), t.events.where("day(ts) > 15")
    return rounded(alert_thresholds(metrics(after), metrics(before)), 6)


KNN_SQL = """
SELECT query_id, neighbour_id, round(d, 5) AS distance, rank, label FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label AS label,
         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""


@query("knn_join", KNN_SQL)
def knn_query(t: Tables):
    found = knn_join(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5, "label", exclude_self=True)
    return rounded(found.withColumn("label", F.col("label").cast("int")), 5)


@query("knn_join_blocks", KNN_SQL)
def knn_blocks_query(t: Tables):
    """The join of a reference that is too large for a broadcast, in many dimensions."""
    found = knn_join(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5, "label", exclude_self=True, broadcast_bytes=0)
    return rounded(found.withColumn("label", F.col("label").cast("int")), 5)


@query("knn_join_approximate")
def knn_approximate_query(t: Tables):
    """How many of the exact neighbours the hashed join finds, over all rows."""
    found, report = approximate_knn_join(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5, exclude_self=True)
    exact = knn_join(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 5, exclude_self=True)
    both = exact.join(found.select("query_id", "neighbour_id", F.lit(1).alias("hit")), ["query_id", "neighbour_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall")).withColumns(
        {"sample_recall": F.lit(round(report["recall"], 4)), "reached": F.col("recall") >= 0.9, "projections": F.lit(report["projections"]), "tables": F.lit(report["tables"])}
    )
