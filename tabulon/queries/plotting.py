"""Tables behind plots."""

from pyspark.sql import functions as F

from ..operators.association import chi2_pvalues, correlation_matrix, crosstab
from ..operators.plots import (
    actual_vs_predicted, box, density, histogram, pair_columns, pair_points, pie, plot_batch, principal_components,
    residual_histogram, residuals, scatter, violin,
)
from ..operators.profile import target_mean, value_counts
from ..plans.learning_curve import learning_curve
from .base import Tables, query, rounded
from .statistics import chi2_p_sql, correlation_sql

HISTOGRAM_SQL = """
WITH x AS (SELECT {expr} AS v FROM {source}),
s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS w FROM x),
c AS (SELECT CAST(least(floor((v - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM x, s GROUP BY 1)
SELECT CAST(g AS INTEGER) AS bin, round(lo + g * w, 4) AS low, round(lo + (g + 1) * w, 4) AS high,
       coalesce(n, 0) AS count
FROM (SELECT unnest(range(30)) AS g) CROSS JOIN s LEFT JOIN c ON c.bin = g"""


@query("plot_histogram", HISTOGRAM_SQL.format(expr="o_totalprice", source="orders"))
def plot_histogram(t: Tables):
    return rounded(histogram(t.orders, "o_totalprice"))


@query("plot_scatter", "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def plot_scatter(t: Tables):
    return scatter(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


#: the rows of a sample: first by md5 of the key and a seed
SAMPLE_SQL = "ORDER BY md5({key} || '|42') LIMIT {rows}"


@query(
    "plot_scatter_sample",
    f"""SELECT o_totalprice AS x, CAST(o_custkey AS BIGINT) AS y, o_orderstatus AS color FROM orders
        {SAMPLE_SQL.format(key='CAST(o_orderkey AS VARCHAR)', rows=1000)}""",
)
def plot_scatter_sample(t: Tables):
    """A thousand points, the same ones on any number of partitions."""
    return scatter(t.orders.repartition(17), "o_totalprice", "o_custkey", "o_orderstatus", 1000, ["o_orderkey"])


PAIRED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIR_KEY = "l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber"


@query(
    "plot_pair_points",
    "WITH s AS (SELECT * FROM lineitem " + SAMPLE_SQL.format(key=PAIR_KEY, rows=500) + ") " + " UNION ALL ".join(
        f"SELECT '{a}' AS x_column, '{b}' AS y_column, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, l_returnflag AS color FROM s"
        for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :]
    ),
)
def plot_pair_points(t: Tables):
    """All panels of a scatter matrix in long form, from a sample by hash."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = t.lineitem.select(*keys, *PAIRED, "l_returnflag")
    return pair_points(df, None, "l_returnflag", 500, keys)


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("plot_correlation", correlation_sql("lineitem", MEASURES))
def plot_correlation(t: Tables):
    return rounded(correlation_matrix(t.lineitem, MEASURES), 6)


@query(
    "plot_box",
    """WITH q AS (SELECT event_type AS x, min(value) AS mi, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3, max(value) AS ma FROM events GROUP BY 1)
       SELECT x, mi AS min, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, ma AS max,
              round(q1 - 1.5 * (q3 - q1), 4) AS low_fence, round(q3 + 1.5 * (q3 - q1), 4) AS high_fence,
              count(*) AS count,
              count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
       FROM q JOIN events ON event_type = x GROUP BY ALL""",
)
def plot_box(t: Tables):
    return rounded(box(t.events, "event_type", "value"))


@query(
    "plot_pair",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus AS color
       FROM lineitem""",
)
def plot_pair(t: Tables):
    return pair_columns(t.lineitem, color="l_linestatus")


def density_sql(points: int) -> str:
    return f"""
    WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n,
                      stddev_samp(value) * pow(count(*), -0.2) AS h FROM events),
    g AS (SELECT CAST(p AS INTEGER) AS point, lo + p * (hi - lo) / {points - 1} AS grid, n, h
          FROM (SELECT unnest(range({points})) AS p), s)
    SELECT point, round(grid, 4) AS grid, round(sum(exp(-0.5 * pow((grid - value) / h, 2))) / (n * h * sqrt(2 * pi())), 8)
           AS density FROM g, events GROUP BY point, grid, n, h"""


@query("plot_kde", density_sql(500))
def plot_kde(t: Tables):
    out = density(t.events, "value", exact=True)
    return out.select("point", F.round("grid", 4).alias("grid"), F.round("density", 8).alias("density"))


@query(
    "plot_kde_binned",
    f"""WITH e AS ({density_sql(500)}), h AS (SELECT stddev_samp(value) * pow(count(*), -0.2) AS h FROM events)
        SELECT count(*) AS points, count(*) AS within_bound, true AS close FROM e, h""",
)
def plot_kde_binned(t: Tables):
    """The binned curve against the exact one: every point within the stated bound, most of them far inside."""
    h = t.events.agg(F.stddev_samp("value") * F.pow(F.count("value"), F.lit(-0.2))).first()[0]
    exact = density(t.events, "value", exact=True).select("point", F.col("density").alias("exact"))
    gap = F.abs(F.col("density") - F.col("exact"))
    return density(t.events, "value").join(exact, "point").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(gap <= 0.0002 / h).alias("within_bound"), (F.avg(gap) < 0.0001 / h).alias("close")
    )


@query(
    "plot_violin",
    """WITH s AS (SELECT event_type AS x, min(value) AS lo, max(value) AS hi, count(*) AS n,
                         stddev_samp(value) * pow(count(*), -0.2) AS h, quantile_cont(value, 0.5) AS md,
                         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
       g AS (SELECT x, CAST(p AS INTEGER) AS point, lo + p * (hi - lo) / 499 AS grid, n, h, md, q1, q3
             FROM (SELECT unnest(range(500)) AS p), s)
       SELECT x, point, round(grid, 4) AS grid, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3,
              round(sum(exp(-0.5 * pow((grid - value) / h, 2))) / (n * h * sqrt(2 * pi())), 8) AS density
       FROM g JOIN events ON event_type = x GROUP BY x, point, grid, n, h, md, q1, q3""",
)
def plot_violin(t: Tables):
    out = violin(t.events, "event_type", "value", exact=True)
    return out.select(
        "x", "point", *[F.round(c, 4).alias(c) for c in ("grid", "q1", "median", "q3")],
        F.round("density", 8).alias("density"),
    )


@query("plot_count", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def plot_count(t: Tables):
    return value_counts(t.orders, "o_orderpriority")


@query(
    "plot_pie",
    """SELECT c_mktsegment AS value, count(*) AS count, round(count(*) * 1.0 / (SELECT count(*) FROM customer), 6) AS share
       FROM customer GROUP BY 1""",
)
def plot_pie(t: Tables):
    return rounded(pie(t.customer, "c_mktsegment"), 6)


@query(
    "plot_target_mean",
    "SELECT l_returnflag AS x, round(avg(l_extendedprice), 4) AS mean_y FROM lineitem GROUP BY 1",
)
def plot_target_mean(t: Tables):
    return rounded(target_mean(t.lineitem, "l_returnflag", "l_extendedprice"))


@query(
    "plot_stacked_bar",
    """SELECT a.v AS x, b.v AS y, count(o_orderkey) AS count FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) a
       CROSS JOIN (SELECT DISTINCT o_orderstatus AS v FROM orders) b
       LEFT JOIN orders ON o_orderpriority = a.v AND o_orderstatus = b.v GROUP BY 1, 2""",
)
def plot_stacked_bar(t: Tables):
    return crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query("plot_chi2_heatmap", chi2_p_sql("lineitem", ("l_returnflag", "l_linestatus")))
def plot_chi2_heatmap(t: Tables):
    return rounded(chi2_pvalues(t.lineitem), 6)


@query("plot_class_imbalance", "SELECT quality AS value, count(*) AS count FROM labels GROUP BY 1")
def plot_class_imbalance(t: Tables):
    return value_counts(t.labels, "quality")


@query("plot_pca")
def plot_pca(t: Tables):
    df = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rounded(principal_components(df, "l_returnflag"))


@query("plot_learning_curve")
def plot_learning_curve(t: Tables):
    df = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "toxic", "quality")
    return rounded(
        learning_curve(df, "quality", keys=["doc_id"])
    )


@query("plot_batch")
def plot_batch_query(t: Tables):
    requests = [
        {"plot": "histogram", "x": "o_totalprice"},
        {"plot": "countplot", "x": "o_orderstatus"},
        {"plot": "spiral", "x": "o_totalprice"},
        {"plot": "target_mean", "x": "o_orderpriority", "y": "o_totalprice"},
    ]
    tables, errors = plot_batch(t.orders, requests)
    rows = [(i, requests[i]["plot"], "error", None) for i in errors]
    failed = t.spark.createDataFrame(rows, "position int, plot string, state string, result_rows long")
    for i, table in tables.items():
        failed = failed.unionByName(
            table.agg(F.count(F.lit(1)).alias("result_rows")).select(
                F.lit(i).alias("position"), F.lit(requests[i]["plot"]).alias("plot"), F.lit("ok").alias("state"), "result_rows"
            )
        )
    return failed


PREDICTED = "(SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p FROM lineitem)"


def _predicted(t: Tables):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


@query("plot_residuals", f"SELECT CAST(p AS DOUBLE) AS prediction, round(y - p, 4) AS residual FROM {PREDICTED}")
def plot_residuals(t: Tables):
    return rounded(residuals(_predicted(t), "y", "p"))


@query("plot_actual_vs_predicted", f"SELECT y AS actual, CAST(p AS DOUBLE) AS predicted FROM {PREDICTED}")
def plot_actual(t: Tables):
    return actual_vs_predicted(_predicted(t), "y", "p")


@query(
    "plot_residual_hist",
    HISTOGRAM_SQL.format(expr="l_extendedprice - 1500.0 * l_quantity", source="lineitem"),
)
def plot_residual_hist(t: Tables):
    return rounded(residual_histogram(_predicted(t), "y", "p"))
