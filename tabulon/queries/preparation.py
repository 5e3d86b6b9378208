"""Projections, filters, imputation, encoding and scaling."""

from pyspark.sql import functions as F

from ..operators.clean import (
    clean_numeric, clean_text, dedupe, delete_columns, drop_missing, iqr_filter, select_categorical, select_numeric,
    split_xy,
)
from ..operators.encode import (
    fit_codes, label_encode, label_encode_table, onehot, ordinal_encode, target_encode, target_encode_crossfit,
)
from ..operators.impute_knn import impute_neighbours
from ..operators.impute import impute, impute_table
from ..operators.lookup import lookup_join
from ..operators.scale import fit_scaler, scale
from ..operators.versions import registry_filter
from ..plans.preprocess import Features, apply_preprocessing, engineer_features, recommend
from ..session import scratch_path
from .base import Tables, holes, query, rounded
from .files import fences_sql

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

# --- projections and filters ----------------------------------------------------------------------


@query("delete_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def delete_columns_query(t: Tables):
    return delete_columns(t.orders, ["o_orderdate", "o_orderstatus", "o_orderpriority", "no_such_column"])


@query(
    "split_xy",
    """SELECT 'features' AS side, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem
       UNION ALL
       SELECT 'target', count(*), round(sum(l_extendedprice), 2) FROM lineitem""",
)
def split_xy_query(t: Tables):
    x, y = split_xy(t.lineitem.select("l_quantity", "l_discount", "l_extendedprice"))
    left = x.agg(F.lit("features").alias("side"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    right = y.agg(
        F.lit("target").alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )
    return left.unionByName(right)


@query("select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_numeric_query(t: Tables):
    return select_numeric(t.orders)


@query("select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def select_categorical_query(t: Tables):
    return select_categorical(t.orders)


@query("first_k_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def first_k_numeric(t: Tables):
    return select_numeric(t.lineitem, 5)


@query("drop_null_rows", f"SELECT {LINE}, l_quantity FROM lineitem WHERE l_linenumber % 5 <> 0")
def drop_null_rows(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return drop_missing(holes(df, "l_quantity", "l_linenumber % 5 = 0"), ["l_quantity"])


@query(
    "drop_any_null_numeric",
    f"SELECT {LINE}, l_quantity, l_tax FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_orderkey % 7 <> 0",
)
def drop_any_null_numeric(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    df = holes(holes(df, "l_quantity", "l_linenumber % 5 = 0"), "l_tax", "l_orderkey % 7 = 0")
    return drop_missing(df, df.columns)


@query("dedupe", "SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_query(t: Tables):
    return dedupe(t.lineitem.select("l_partkey", "l_linenumber", "l_returnflag"))


@query(
    "clean_string",
    """WITH padded AS (
         SELECT DISTINCT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '   '
                ELSE '  ' || c_mktsegment || ' ' END AS c_mktsegment FROM customer)
       SELECT c_custkey, trim(c_mktsegment) AS c_mktsegment FROM padded
       WHERE c_mktsegment IS NULL OR trim(c_mktsegment) <> ''""",
)
def clean_string(t: Tables):
    padded = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 13 == 0, None).when(F.col("c_custkey") % 11 == 0, "   ")
        .otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("c_mktsegment"),
    )
    return clean_text(padded.unionByName(padded), "c_mktsegment")


@query(
    "clean_numeric_3sigma",
    """WITH d AS (SELECT DISTINCT event_id, event_type, value FROM events),
       s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM d)
       SELECT event_id, event_type, value FROM d, s WHERE value BETWEEN m - 3 * sd AND m + 3 * sd""",
)
def clean_numeric_3sigma(t: Tables):
    df = t.events.select("event_id", "event_type", "value")
    return clean_numeric(df.unionByName(df.where("event_type = 'error'")), "value")


@query(
    "iqr_filter",
    f"""WITH base AS (SELECT event_id, user_id, value FROM events), {fences_sql("base", ["event_id", "user_id", "value"])}
        SELECT event_id, user_id, value FROM s2""",
)
def iqr_filter_query(t: Tables):
    return iqr_filter(t.events.select("event_id", "user_id", "value"))


@query(
    "group_mask",
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'""",
)
def group_mask(t: Tables):
    return registry_filter(t.customer, c_mktsegment="MACHINERY").select("c_custkey", "c_acctbal")


@query(
    "registry_filter",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def registry_filter_query(t: Tables):
    return registry_filter(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_orderdate")


# --- imputation -----------------------------------------------------------------------------------

HOLEY = """(SELECT event_id, user_id, ts, event_type AS kind,
            CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value,
            CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"""


def _holey(t: Tables):
    df = t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value", "event_type")
    return holes(holes(df, "value", "event_id % 4 = 0"), "event_type", "event_id % 3 = 0")


def _filled_sql(expression: str, column: str = "value") -> str:
    shown = "round(coalesce(value, f), 4) AS value" if column == "value" else "coalesce(event_type, f) AS event_type"
    return f"SELECT event_id, {shown} FROM {HOLEY} h, (SELECT {expression} AS f FROM {HOLEY})"


MODE = f"""(SELECT event_type FROM {HOLEY} WHERE event_type IS NOT NULL GROUP BY event_type
           ORDER BY count(*) DESC, event_type LIMIT 1)"""
MODE_SQL = f"SELECT event_id, coalesce(event_type, f) AS event_type FROM {HOLEY} h, (SELECT {MODE} AS f)"


@query("impute_mean", _filled_sql("avg(value)"))
def impute_mean(t: Tables):
    return rounded(impute(_holey(t), "value", "mean").select("event_id", "value"))


@query("impute_median", _filled_sql("quantile_cont(value, 0.5)"))
def impute_median(t: Tables):
    return rounded(impute(_holey(t), "value", "median").select("event_id", "value"))


@query("impute_mode", MODE_SQL)
def impute_mode(t: Tables):
    return impute(_holey(t), "event_type", "mode").select("event_id", "event_type")


@query("impute_drop", f"SELECT event_id, value FROM {HOLEY} WHERE value IS NOT NULL")
def impute_drop(t: Tables):
    return impute(_holey(t), "value", "drop").select("event_id", "value")


@query("impute_knn", _filled_sql("avg(value)"))
def impute_knn(t: Tables):
    return rounded(impute(_holey(t), "value", "knn").select("event_id", "value"))


@query(
    "impute_ffill",
    f"""SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS value FROM {HOLEY}""",
)
def impute_ffill(t: Tables):
    return impute(_holey(t), "value", "forward_fill", order_by=["ts", "event_id"]).select("event_id", "value")


@query(
    "impute_bfill",
    f"""SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {HOLEY}""",
)
def impute_bfill(t: Tables):
    return impute(_holey(t), "value", "backward_fill", order_by=["ts", "event_id"], keys=["user_id"]).select(
        "event_id", "value"
    )


@query("impute_auto", MODE_SQL)
def impute_auto(t: Tables):
    return impute(_holey(t), "event_type", "auto").select("event_id", "event_type")


@query(
    "impute_table",
    f"""WITH h AS (SELECT event_id, value, event_type FROM {HOLEY})
        SELECT CAST(event_id AS DOUBLE) AS event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h)), 4) AS value,
               coalesce(event_type, {MODE}) AS event_type FROM h""",
)
def impute_table_query(t: Tables):
    return rounded(impute_table(_holey(t).select("event_id", "value", "event_type")))


# --- encoding -------------------------------------------------------------------------------------


@query(
    "encode_onehot",
    """SELECT o_orderkey,
              CASE WHEN p = '2-HIGH' THEN 1 ELSE 0 END AS "o_orderpriority_2-HIGH",
              CASE WHEN p = '3-MEDIUM' THEN 1 ELSE 0 END AS "o_orderpriority_3-MEDIUM",
              CASE WHEN p = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "o_orderpriority_4-NOT SPECIFIED",
              CASE WHEN p = '5-LOW' THEN 1 ELSE 0 END AS "o_orderpriority_5-LOW"
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)""",
)
def encode_onehot(t: Tables):
    df = holes(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey % 10 = 0")
    return onehot(df, "o_orderpriority")


@query(
    "encode_onehot_full",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F",
              CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
              CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P" FROM orders""",
)
def encode_onehot_full(t: Tables):
    return onehot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", drop_first=False)


def _codes_sql(column: str, source: str, nulls: str) -> str:
    value = f"coalesce({column}, 'nan')" if nulls == "category" else column
    return f"""(SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code
               FROM (SELECT DISTINCT {value} AS v FROM {source}) WHERE v IS NOT NULL)"""


NAMED = "(SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_name END AS p_name, p_brand, p_type FROM part)"


@query(
    "encode_label",
    f"""SELECT p_partkey, code AS p_name FROM {NAMED} n JOIN {_codes_sql('p_name', NAMED, 'category')} c
        ON coalesce(n.p_name, 'nan') = c.v""",
)
def encode_label(t: Tables):
    df = holes(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey % 8 = 0")
    return label_encode(df, "p_name")


@query(
    "encode_ordinal",
    f"""SELECT p_partkey, coalesce(code, -1) AS p_name FROM {NAMED} n LEFT JOIN {_codes_sql('p_name', NAMED, 'null')} c
        ON n.p_name = c.v""",
)
def encode_ordinal(t: Tables):
    df = holes(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey % 8 = 0")
    return ordinal_encode(df, "p_name")


@query(
    "encode_label_table",
    f"""SELECT p_partkey, n.code AS p_name, b.code AS p_brand, y.code AS p_type FROM part
        JOIN {_codes_sql('p_name', 'part', 'category')} n ON p_name = n.v
        JOIN {_codes_sql('p_brand', 'part', 'category')} b ON p_brand = b.v
        JOIN {_codes_sql('p_type', 'part', 'category')} y ON p_type = y.v""",
)
def encode_label_table(t: Tables):
    return label_encode_table(t.part.select("p_partkey", "p_name", "p_brand", "p_type"))


def _target_sql(n: str, s: str, q: str, mean: str, var: str) -> str:
    within = f"greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0)"
    weight = f"({var} * {n} / ({var} * {n} + {within}))"
    return f"{weight} * {s} / {n} + (1 - {weight}) * {mean}"


TARGET_SQL = f"""WITH o AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders),
        c AS (SELECT o_orderpriority AS k, count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q
              FROM orders GROUP BY 1)
        SELECT o_orderkey, round({_target_sql('n', 's', 'q', 'm', 'v')}, 2) AS o_orderpriority
        FROM orders JOIN c ON k = orders.o_orderpriority, o"""


@query("encode_target", TARGET_SQL)
def encode_target(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(target_encode(df, "o_orderpriority", "o_totalprice").drop("o_totalprice"), 2)


HASH_ORDER = "CAST('0x' || substr(md5({key} || '|42'), 1, 13) AS BIGINT)"


def ntile_sql(key: str, folds: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"CAST(ntile({folds}) OVER ({part}ORDER BY {HASH_ORDER.format(key=key)}, CAST({key} AS VARCHAR)) - 1 AS INTEGER)"


CROSSFIT_SQL = f"""WITH f AS (SELECT o_orderkey, o_orderpriority AS k, o_totalprice AS y, {ntile_sql('o_orderkey', 5)} AS fold FROM orders),
        cell AS (SELECT fold, k, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM f GROUP BY 1, 2),
        cat AS (SELECT k, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cell GROUP BY 1),
        per AS (SELECT fold, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cell GROUP BY 1),
        al AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cell),
        fit AS (SELECT fold, (al.s - per.s) / (al.n - per.n) AS m,
                (al.q - per.q) / (al.n - per.n) - ((al.s - per.s) / (al.n - per.n)) * ((al.s - per.s) / (al.n - per.n)) AS v
                FROM per, al),
        rest AS (SELECT cell.fold, cell.k, cat.n - cell.n AS n, cat.s - cell.s AS s, cat.q - cell.q AS q
                 FROM cell JOIN cat ON cell.k = cat.k)
        SELECT o_orderkey, round({_target_sql('rest.n', 'rest.s', 'rest.q', 'fit.m', 'fit.v')}, 2) AS o_orderpriority
        FROM f JOIN rest ON rest.fold = f.fold AND rest.k = f.k JOIN fit ON fit.fold = f.fold"""


@query("encode_target_crossfit", CROSSFIT_SQL)
def encode_target_cross(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = target_encode_crossfit(df, "o_orderpriority", "o_totalprice", ["o_orderkey"])
    return rounded(out.drop("o_totalprice"), 2)


def _engineered(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    table, fitted = engineer_features(df, "o_totalprice", interactions=False, scaling=None, selection=None, keys=["o_orderkey"])
    path = scratch_path(t.spark, "features")
    fitted.save(path)
    return table, Features.load(t.spark, path), df


@query("engineer_features_fitting", CROSSFIT_SQL)
def engineer_features_fitting(t: Tables):
    """Rows of the fit are encoded from the other folds, also after saving and loading."""
    _, fitted, _ = _engineered(t)
    return rounded(fitted.fitting.drop("o_totalprice"), 2)


@query("engineer_features_scoring", TARGET_SQL)
def engineer_features_scoring(t: Tables):
    """All other rows are encoded from all rows of the fit."""
    _, fitted, df = _engineered(t)
    return rounded(fitted.apply(df).drop("o_totalprice"), 2)


@query(
    "encode_join",
    f"SELECT p_partkey, p_brand, code FROM part JOIN {_codes_sql('p_brand', 'part', 'null')} c ON p_brand = c.v",
)
def encode_join(t: Tables):
    codes = fit_codes(t.part, "p_brand").withColumnRenamed("__code", "code")
    return lookup_join(t.part.select("p_partkey", "p_brand"), codes, ["p_brand"])


@query(
    "params_join",
    """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) - min(c_acctbal) AS w FROM customer)
       SELECT c_custkey, round((c_acctbal - lo) / w, 6) AS c_acctbal FROM customer, s""",
)
def params_join(t: Tables):
    # fitted on the customers, applied as constants: no join is left in the plan
    fitted = fit_scaler(t.customer, ["c_acctbal"], "minmax")
    return rounded(fitted.apply(t.customer.select("c_custkey", "c_acctbal")), 6)


# --- scaling --------------------------------------------------------------------------------------


def _scaled_sql(fit: str, expression: str) -> str:
    return f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value FROM events),
               s AS (SELECT {fit} FROM x) SELECT event_id, round({expression}, 6) AS value FROM x, s"""


def _scaled(t: Tables, method: str):
    df = holes(t.events.select("event_id", "value"), "value", "event_id % 6 = 0")
    return rounded(scale(df, ["value"], method), 6)


@query("scale_zscore", _scaled_sql("avg(value) AS m, stddev_pop(value) AS d", "(value - m) / d"))
def scale_zscore(t: Tables):
    return _scaled(t, "z-score")


@query("scale_minmax", _scaled_sql("min(value) AS m, max(value) - min(value) AS d", "(value - m) / d"))
def scale_minmax(t: Tables):
    return _scaled(t, "min-max")


@query(
    "scale_robust",
    _scaled_sql(
        "quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS d", "(value - m) / d"
    ),
)
def scale_robust(t: Tables):
    return _scaled(t, "robust")


@query("scale_maxabs", _scaled_sql("max(abs(value)) AS d", "value / d"))
def scale_maxabs(t: Tables):
    return _scaled(t, "max-abs")


SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "scale_table",
    f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in SCALED)} FROM lineitem)
        SELECT {LINE}, {', '.join(f'round(({c} - m_{c}) / d_{c}, 4) AS {c}' for c in SCALED)} FROM lineitem, s""",
)
def scale_table(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *SCALED)
    return rounded(scale(df, SCALED, "standard"))


# --- step lists and recommendations ---------------------------------------------------------------


@query(
    "apply_preprocessing",
    """WITH h AS (SELECT DISTINCT c_custkey, c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS b
                  FROM customer),
       i AS (SELECT c_custkey, c_mktsegment, coalesce(b, (SELECT avg(b) FROM h)) AS b FROM h),
       z AS (SELECT c_custkey, c_mktsegment, (b - (SELECT avg(b) FROM i)) / (SELECT stddev_pop(b) FROM i) AS b FROM i)
       SELECT c_custkey, round(b, 6) AS c_acctbal,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS "c_mktsegment_BUILDING",
              CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS "c_mktsegment_FURNITURE",
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "c_mktsegment_HOUSEHOLD",
              CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS "c_mktsegment_MACHINERY"
       FROM z WHERE c_custkey BETWEEN (SELECT avg(c_custkey) - 3 * stddev_samp(c_custkey) FROM z)
                                  AND (SELECT avg(c_custkey) + 3 * stddev_samp(c_custkey) FROM z)""",
)
def apply_preprocessing_query(t: Tables):
    df = holes(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_custkey % 6 = 0")
    steps = {
        "imputation": "c_acctbal", "normalization": "c_acctbal", "rotation": "c_custkey", "encoding": "c_mktsegment",
        "cleaning": "c_custkey",
    }
    return rounded(apply_preprocessing(df, steps).data, 6)


RECOMMEND_SQL = """
WITH h AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value,
                  CASE WHEN event_id % 30 = 0 THEN NULL ELSE event_type END AS event_type, props FROM events),
r AS (SELECT max(event_id) - min(event_id) AS a, max(user_id) - min(user_id) AS b, max(value) - min(value) AS c FROM h),
ratio AS (SELECT greatest(a, b, c) / least(a, b, c) AS v FROM r),
q AS (SELECT quantile_cont(event_id, 0.25) AS e1, quantile_cont(event_id, 0.75) AS e3, quantile_cont(user_id, 0.25) AS u1,
             quantile_cont(user_id, 0.75) AS u3, quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3 FROM h),
o AS (SELECT 'event_id' AS c, 100.0 * sum(CASE WHEN event_id < e1 - 1.5 * (e3 - e1) OR event_id > e3 + 1.5 * (e3 - e1) THEN 1 ELSE 0 END) / count(*) AS p FROM h, q
      UNION ALL SELECT 'user_id', 100.0 * sum(CASE WHEN user_id < u1 - 1.5 * (u3 - u1) OR user_id > u3 + 1.5 * (u3 - u1) THEN 1 ELSE 0 END) / count(*) FROM h, q
      UNION ALL SELECT 'value', 100.0 * sum(CASE WHEN value < v1 - 1.5 * (v3 - v1) OR value > v3 + 1.5 * (v3 - v1) THEN 1 ELSE 0 END) / count(*) FROM h, q),
rec AS (
  SELECT CASE WHEN p >= 20 THEN 'deletion' ELSE 'imputation' END AS operation, 'value' AS "column",
         CASE WHEN p < 5 THEN 'mean' WHEN p < 20 THEN 'knn' ELSE 'drop_column' END AS method, p AS detail
  FROM (SELECT 100.0 * (count(*) - count(value)) / count(*) AS p FROM h) WHERE p > 0
  UNION ALL
  SELECT 'imputation', 'event_type', 'mode', p FROM (SELECT 100.0 * (count(*) - count(event_type)) / count(*) AS p FROM h) WHERE p > 0
  UNION ALL
  SELECT 'encoding', 'event_type', CASE WHEN d > 10 THEN 'label' ELSE 'one-hot' END, d FROM (SELECT count(DISTINCT event_type) AS d FROM h)
  UNION ALL
  SELECT 'encoding', 'props', CASE WHEN d > 10 THEN 'label' ELSE 'one-hot' END, d FROM (SELECT count(DISTINCT props) AS d FROM h)
  UNION ALL
  SELECT 'normalization', c, 'standard', v FROM (SELECT unnest(['event_id', 'user_id', 'value']) AS c), ratio WHERE v > 10
  UNION ALL
  SELECT 'cleaning', c, 'outlier_removal', p FROM o WHERE p > 5)
SELECT operation, "column", method, round(CAST(detail AS DOUBLE), 4) AS detail FROM rec"""


@query("recommend", RECOMMEND_SQL)
def recommend_query(t: Tables):
    df = t.events.select("event_id", "user_id", "value", "event_type", "props")
    df = holes(holes(df, "value", "event_id % 4 = 0"), "event_type", "event_id % 30 = 0")
    return rounded(recommend(df))




GAPPED = {"p_size": "p_partkey % 5 = 1", "p_retailprice": "p_partkey % 7 = 2", "width": "p_partkey % 11 IN (1, 3)"}


def _neighbours_sql() -> str:
    """Five nearest rows over the columns both have, for each missing cell."""
    gapped = ", ".join(f"CASE WHEN NOT ({w}) THEN CAST({'length(p_name)' if c == 'width' else c} AS DOUBLE) END AS {c}" for c, w in GAPPED.items())
    terms = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in GAPPED)
    shared = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in GAPPED)
    cells = " UNION ALL ".join(f"""SELECT q, '{c}' AS c, avg(y) AS y FROM (
        SELECT q, y_{c} AS y, row_number() OVER (PARTITION BY q ORDER BY sqrt(d * (3.0::DOUBLE / n)), r) AS rank FROM pairs
        WHERE x_{c} IS NULL AND y_{c} IS NOT NULL AND n > 0) WHERE rank <= 5 GROUP BY q""" for c in GAPPED)
    sides = ", ".join(f"a.{c} AS x_{c}, b.{c} AS y_{c}" for c in GAPPED)
    filled = ", ".join(f"round(coalesce(g.{c}, (SELECT y FROM cells WHERE q = g.p_partkey AND c = '{c}'), avg(g.{c}) OVER ()), 4) AS {c}" for c in GAPPED)
    return f"""WITH g AS (SELECT p_partkey, {gapped} FROM part),
        pairs AS (SELECT a.p_partkey AS q, b.p_partkey AS r, {terms} AS d, {shared} AS n, {sides} FROM g a CROSS JOIN g b
                  WHERE a.p_size IS NULL OR a.p_retailprice IS NULL OR a.width IS NULL),
        cells AS ({cells}) SELECT p_partkey, {filled} FROM g"""


@query("impute_knn_columns", _neighbours_sql())
def impute_knn_columns(t: Tables):
    """Gaps in three columns, filled from the rows nearest in the others."""
    df = t.part.select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("width"))
    for column, where in GAPPED.items():
        df = holes(df, column, where)
    return rounded(impute_neighbours(df, list(GAPPED), key="p_partkey"))
