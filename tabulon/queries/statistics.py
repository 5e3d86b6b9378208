"""Profiles and aggregates."""

from pyspark.sql import functions as F

from ..operators.association import chi2_pvalues, chi2_statistics, correlation_matrix, crosstab
from ..operators.metrics import ecdf
from ..operators.profile import (
    categorical_topk, data_summary, describe_numeric, distinct_sketches, duplicate_count, iqr_outlier_pct,
    merged_distinct, null_counts, numeric_ranges, nunique, shape, target_mean, top_values, value_counts,
    version_statistics,
)
from ..operators.quantiles import order_statistics
from ..operators.requests import request_assessment, request_endpoint_stats, request_error_counts, request_log_stats
from ..session import scratch_path
from .base import Tables, holes, query, rounded

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
HOLEY_LINES = """(SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax,
    CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"""


def _holey_lines(t: Tables):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"
    )
    return holes(holes(df, "l_quantity", "l_linenumber % 5 = 0"), "l_returnflag", "l_linenumber % 4 = 0")


@query("shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def shape_query(t: Tables):
    return shape(t.lineitem)


@query(
    "null_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM {HOLEY_LINES}"""
        for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    ),
)
def null_counts_query(t: Tables):
    return null_counts(_holey_lines(t))


@query(
    "duplicate_count",
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM lineitem))
       AS BIGINT) AS duplicates FROM lineitem""",
)
def duplicate_count_query(t: Tables):
    return duplicate_count(t.lineitem.select("l_partkey", "l_linenumber", "l_returnflag"))


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
            round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75,
            CAST(max({c}) AS DOUBLE) AS max FROM {HOLEY_LINES}"""
        for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity")
    ),
)
def describe_numeric_query(t: Tables):
    return rounded(describe_numeric(_holey_lines(t)))


def _topk_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", {column} AS value, count(*) AS count,
        row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank,
        (SELECT count(DISTINCT {column}) FROM part) AS distinct_values FROM part GROUP BY {column}"""


@query(
    "categorical_topk",
    "SELECT * FROM (" + " UNION ALL ".join(_topk_sql(c) for c in ("p_name", "p_brand", "p_type")) + ") WHERE rank <= 5",
)
def categorical_topk_query(t: Tables):
    return categorical_topk(t.part)


def _summary_sql(source: str, columns: list[tuple[str, str, str]], with_rows: bool = True) -> str:
    parts = [
        f"SELECT CAST(NULL AS VARCHAR) AS \"column\", 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM {source}",
        f"SELECT NULL, 'columns', '{len(columns)}'",
        f"SELECT NULL, 'duplicate_rows', CAST((SELECT count(*) FROM {source}) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS VARCHAR)",
    ]
    for name, dtype, kind in columns:
        parts += [
            f"SELECT '{name}', 'dtype', '{dtype}'",
            f"SELECT '{name}', 'class', '{kind}'",
            f"SELECT '{name}', 'nulls', CAST(count(*) - count({name}) AS VARCHAR) FROM {source}",
        ]
    return " UNION ALL ".join(parts)


ORDER_COLUMNS = [
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "other"),
    ("o_orderpriority", "string", "categorical"),
]


@query("data_summary", _summary_sql("orders", ORDER_COLUMNS))
def data_summary_query(t: Tables):
    return data_summary(t.orders)


PREPARED_COLUMNS = [
    ("l_partkey", "bigint", "numeric"), ("l_quantity", "double", "numeric"), ("l_returnflag", "string", "categorical")
]
PREPARED = """(SELECT l_partkey, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_returnflag
              FROM lineitem)"""


@query("prepared_info", _summary_sql(PREPARED, PREPARED_COLUMNS))
def prepared_info(t: Tables):
    df = holes(t.lineitem, "l_quantity", "l_linenumber % 5 = 0")
    return data_summary(df.select("l_partkey", "l_quantity", "l_returnflag"))


@query(
    "version_statistics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            count(*) - count({c}) AS nulls FROM {HOLEY_LINES}"""
        for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity")
    )
    + "".join(
        f" UNION ALL SELECT '{c}', NULL, NULL, count(*) - count({c}) FROM {HOLEY_LINES}"
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def version_statistics_query(t: Tables):
    return rounded(version_statistics(_holey_lines(t)))


COUNTS_SQL = """SELECT {c} AS value, count(*) AS count FROM {s} WHERE {c} IS NOT NULL GROUP BY 1"""


@query("value_counts", COUNTS_SQL.format(c="l_returnflag", s=HOLEY_LINES))
def value_counts_query(t: Tables):
    return value_counts(_holey_lines(t), "l_returnflag")


@query("sort_desc", COUNTS_SQL.format(c="p_name", s="part") + " ORDER BY count DESC, value")
def sort_desc(t: Tables):
    return value_counts(t.part, "p_name")


@query("top_values", COUNTS_SQL.format(c="user_id", s="events") + " ORDER BY count DESC, value LIMIT 5")
def top_values_query(t: Tables):
    return top_values(t.events, "user_id")


@query("head_n", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 10")
def head_n(t: Tables):
    return t.events.select("event_id", "ts", "value").orderBy("ts", "event_id").limit(10)


@query(
    "target_mean",
    "SELECT o_orderpriority AS x, round(avg(o_totalprice), 4) AS mean_y FROM orders GROUP BY 1 ORDER BY 2 DESC",
)
def target_mean_query(t: Tables):
    return rounded(target_mean(t.orders, "o_orderpriority", "o_totalprice"))


CROSSTAB_SQL = """SELECT x.v AS x, y.v AS y, count(p.p_partkey) AS count
    FROM (SELECT DISTINCT p_brand AS v FROM part) x CROSS JOIN (SELECT DISTINCT p_size AS v FROM part) y
    LEFT JOIN part p ON p.p_brand = x.v AND p.p_size = y.v GROUP BY 1, 2"""


@query("crosstab", CROSSTAB_SQL)
def crosstab_query(t: Tables):
    return crosstab(t.part, "p_brand", "p_size")


def correlation_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM {source}"
        for a in columns for b in columns
    )


@query(
    "correlation_matrix",
    correlation_sql(HOLEY_LINES, ("l_linenumber", "l_extendedprice", "l_tax", "l_quantity")),
)
def correlation_query(t: Tables):
    df = _holey_lines(t)
    return rounded(correlation_matrix(df, ["l_linenumber", "l_extendedprice", "l_tax", "l_quantity"]), 6)


def chi2_sql(source: str, a: str, b: str) -> str:
    """Chi-square of one pair by the textbook sum over all cells."""
    return f"""(WITH s AS (SELECT {a} AS u, {b} AS v FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
      r AS (SELECT u, count(*) AS r FROM s GROUP BY u), c AS (SELECT v, count(*) AS c FROM s GROUP BY v),
      o AS (SELECT u, v, count(*) AS o FROM s GROUP BY u, v), n AS (SELECT count(*) AS n FROM s),
      e AS (SELECT coalesce(o, 0) AS o, 1.0 * r * c / n AS e FROM r CROSS JOIN c CROSS JOIN n
            LEFT JOIN o ON o.u = r.u AND o.v = c.v)
      SELECT '{a}' AS x, '{b}' AS y, sum((o - e) * (o - e) / e) AS chi2,
             CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS BIGINT) AS dof FROM e)"""


PART_PAIRS = [("p_name", "p_brand"), ("p_name", "p_type"), ("p_brand", "p_type")]
CHI2_PARTS = " UNION ALL ".join(
    f"SELECT x, y, round(chi2, 4) AS chi2, dof FROM {chi2_sql('part', *p)} q" for a, b in PART_PAIRS for p in ((a, b), (b, a))
)


@query("chi2_statistics", CHI2_PARTS)
def chi2_statistics_query(t: Tables):
    return rounded(chi2_statistics(t.part.select("p_name", "p_brand", "p_type")))


def chi2_p_sql(source: str, columns: tuple[str, str]) -> str:
    """Closed form of the tail for an even number of degrees of freedom."""
    a, b = columns
    p = """(SELECT exp(-chi2 / 2) * sum(term) FROM (
              SELECT chi2, pow(chi2 / 2, i) / gamma(i + 1) AS term FROM (SELECT chi2, unnest(range(CAST(dof / 2 AS BIGINT))) AS i FROM s)
            ) GROUP BY chi2)"""
    return f"""WITH s AS (SELECT * FROM {chi2_sql(source, a, b)} q)
      SELECT '{a}' AS x, '{b}' AS y, round({p}, 6) AS p_value UNION ALL SELECT '{b}', '{a}', round({p}, 6)
      UNION ALL SELECT '{a}', '{a}', 1.0 UNION ALL SELECT '{b}', '{b}', 1.0"""


@query("chi2_pvalues", chi2_p_sql("orders", ("o_orderstatus", "o_orderpriority")))
def chi2_pvalues_query(t: Tables):
    return rounded(chi2_pvalues(t.orders), 6)


@query(
    "numeric_ranges",
    f"""WITH r AS (SELECT {', '.join(f'max({c}) - min({c}) AS {c}' for c in MEASURES)} FROM lineitem)
        """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round({c}, 4) AS range,
            round(greatest({', '.join(MEASURES)}) / least({', '.join(MEASURES)}), 4) AS ratio FROM r"""
        for c in MEASURES
    ),
)
def numeric_ranges_query(t: Tables):
    return rounded(numeric_ranges(t.lineitem, MEASURES))


def outlier_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 END) AS outliers,
            round(100.0 * count(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 END) / count(*), 4)
            AS outlier_pct FROM {source},
            (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source})"""
        for c in columns
    )


@query("iqr_outlier_pct", outlier_sql("events", ("event_id", "user_id", "value")))
def iqr_outlier_query(t: Tables):
    return rounded(iqr_outlier_pct(t.events))


@query(
    "nunique",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM {HOLEY_LINES}"""
        for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    ),
)
def nunique_query(t: Tables):
    return nunique(_holey_lines(t))


@query(
    "ecdf",
    """SELECT value, n AS count, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS cumulative,
              round(sum(n) OVER (ORDER BY value) * 1.0 / (SELECT count(*) FROM lineitem), 6) AS share
       FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def ecdf_query(t: Tables):
    return rounded(ecdf(t.lineitem, "l_quantity"), 6)


# --- request log: events as requests, value as latency in hundredths of a second -------------------

LOG = "(SELECT event_type AS endpoint, ts, value / 100 AS latency, event_type <> 'error' AS success, user_id AS status FROM events)"


def _log(t: Tables):
    return t.events.select(
        F.col("event_type").alias("endpoint"), "ts", (F.col("value") / 100).alias("latency"),
        (F.col("event_type") != "error").alias("success"), F.col("user_id").alias("status"),
    )


@query(
    "request_log_stats",
    f"""SELECT count(*) AS total_requests, count(CASE WHEN success THEN 1 END) AS successful_requests,
        round(100.0 * count(CASE WHEN success THEN 1 END) / count(*), 4) AS success_rate,
        round(avg(latency), 4) AS mean_latency, round(quantile_cont(latency, 0.5), 4) AS median_latency,
        round(quantile_cont(latency, 0.95), 4) AS p95_latency, round(quantile_cont(latency, 0.99), 4) AS p99_latency,
        round(min(latency), 4) AS min_latency, round(max(latency), 4) AS max_latency,
        round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 4) AS requests_per_second FROM {LOG}""",
)
def request_log_query(t: Tables):
    return rounded(request_log_stats(_log(t), "latency", "success", "ts"))


@query(
    "request_endpoint_stats",
    f"""SELECT endpoint, round(avg(latency), 3) AS mean_latency, round(max(latency), 3) AS max_latency,
        round(min(latency), 3) AS min_latency, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 3) AS success_rate,
        count(*) AS requests FROM {LOG} GROUP BY endpoint""",
)
def request_endpoint_query(t: Tables):
    return request_endpoint_stats(_log(t), "endpoint", "latency", "success")


@query("request_error_counts", f"SELECT status, count(*) AS errors FROM {LOG} WHERE NOT success GROUP BY status")
def request_error_query(t: Tables):
    return request_error_counts(_log(t), "status", "success")


@query(
    "request_assessment",
    f"""SELECT round(r, 4) AS success_rate, round(m, 4) AS mean_latency,
        CASE WHEN r >= 95 AND m < 2 THEN 'EXCELLENT' WHEN r >= 90 AND m < 5 THEN 'GOOD' WHEN r >= 80 THEN 'ACCEPTABLE'
             ELSE 'POOR' END AS assessment, CASE WHEN r >= 90 AND m < 5 THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT 100.0 * count(CASE WHEN success THEN 1 END) / count(*) AS r, avg(latency) AS m FROM {LOG})""",
)
def request_assessment_query(t: Tables):
    return rounded(request_assessment(_log(t), "latency", "success"))


#: whole numbers beyond 2**53 and decimals of 30 digits
WIDE = "l_orderkey * 4611686018427 + l_linenumber"


@query(
    "order_statistics",
    f"""WITH w AS (SELECT l_returnflag, {WIDE} AS whole, CAST(l_extendedprice AS DECIMAL(18, 4)) + CAST('1234567890123.0001' AS DECIMAL(18, 4)) AS exact FROM lineitem)
        SELECT l_returnflag, p AS place, whole, CAST(CAST(exact AS DECIMAL(18, 4)) AS VARCHAR) AS exact FROM (
          SELECT l_returnflag, unnest([0, 25, 50, 75, 100]) AS p, unnest(quantile_disc(whole, [0, 0.25, 0.5, 0.75, 1])) AS whole,
                 unnest(quantile_disc(exact, [0, 0.25, 0.5, 0.75, 1])) AS exact FROM w GROUP BY l_returnflag)""",
)
def order_statistics_query(t: Tables):
    """Ranks of whole numbers and decimals by group, through ranges, without a double on the way.

    Keys whose product is beyond 64 bits give ``whole`` as a decimal of no places.
    """
    most = t.lineitem.agg(F.max(F.abs(F.col("l_orderkey").cast("decimal(20,0)")))).first()[0]
    fits = most is None or (int(most) + 1) * 4611686018427 < 1 << 63
    kind, whole = ("long", WIDE.replace("4611686018427", "4611686018427L")) if fits else ("decimal(38,0)", f"CAST({WIDE.replace('l_orderkey', 'CAST(l_orderkey AS DECIMAL(20,0))')} AS DECIMAL(38,0))")
    exact = F.col("l_extendedprice").cast("decimal(18,4)") + F.lit("1234567890123.0001").cast("decimal(18,4)")
    df = t.lineitem.select("l_returnflag", F.expr(whole).alias("whole"), exact.cast("decimal(18,4)").alias("exact"))
    # the place that holds the share: the first one at or above it
    places = [(p / 100, lambda n, p=p: max(0, -(-n * p // 100) - 1)) for p in (0, 25, 50, 75, 100)]
    found = order_statistics(df, {"whole": places, "exact": places}, ["l_returnflag"], small=0, ranges=8)
    rows = [
        (flag, p, per["whole"][1][j], str(per["exact"][1][j])) for (flag,), per in found.items() for j, p in enumerate((0, 25, 50, 75, 100))
    ]
    return t.spark.createDataFrame(rows, f"l_returnflag string, place int, whole {kind}, exact string")


@query(
    "nunique_sketch",
    """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS distinct_values, true AS within FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), true FROM lineitem""",
)
def nunique_sketch(t: Tables):
    """Sketches of two halves of a table, stored and merged, against the exact counts."""
    columns, path = ["l_partkey", "l_extendedprice"], scratch_path(t.spark, "sketches")
    for half in (0, 1):
        distinct_sketches(t.lineitem.where(F.col("l_orderkey") % 2 == half), columns).write.mode("append").parquet(path)
    guessed = merged_distinct(t.spark.read.parquet(path)).select("column", F.col("distinct_values").alias("guess"))
    near = F.abs(F.col("guess") - F.col("distinct_values")) <= 0.02 * F.col("distinct_values")
    return nunique(t.lineitem, columns).join(guessed, "column").select("column", "distinct_values", near.alias("within"))
