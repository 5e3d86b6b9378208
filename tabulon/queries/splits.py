"""Splits, folds, task detection and row positions."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..operators.detect import classify_target, detect_task
from ..operators.ordered import row_numbers
from ..operators.split import fold_column, holdout, three_way, time_split
from .base import Tables, query
from .preparation import HASH_ORDER, ntile_sql

ORDER = HASH_ORDER.format(key="o_orderkey") + ", CAST(o_orderkey AS VARCHAR)"


@query(
    "split_holdout",
    f"""SELECT o_orderkey, o_orderstatus, CASE WHEN r <= ceil(n * 0.2) THEN 1 ELSE 0 END AS is_test FROM (
        SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER}) AS r,
               count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def split_holdout(t: Tables):
    return holdout(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.2, "o_orderstatus")


@query(
    "split_three_way",
    f"""SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2) THEN 'test' WHEN r <= 2 * ceil(n * 0.2) THEN 'validation'
        ELSE 'train' END AS part FROM (
        SELECT o_orderkey, row_number() OVER (ORDER BY {ORDER}) AS r, count(*) OVER () AS n FROM orders)""",
)
def split_three_way(t: Tables):
    return three_way(t.orders.select("o_orderkey"), ["o_orderkey"])


@query(
    "split_time",
    """SELECT event_id, ts, CASE WHEN ts > (SELECT quantile_disc(ts, 0.8) FROM events) THEN 1 ELSE 0 END AS is_test
       FROM events""",
)
def split_time(t: Tables):
    return time_split(t.events.select("event_id", "ts"), "ts")


@query("fold_kfold", f"SELECT o_orderkey, {ntile_sql('o_orderkey', 5)} AS fold FROM orders")
def fold_kfold(t: Tables):
    return fold_column(t.orders.select("o_orderkey"), ["o_orderkey"], 5)


@query(
    "fold_stratified",
    f"SELECT o_orderkey, o_orderpriority, {ntile_sql('o_orderkey', 5, 'o_orderpriority')} AS fold FROM orders",
)
def fold_stratified(t: Tables):
    return fold_column(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 5, "o_orderpriority")


@query(
    "split_rank",
    f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER}) AS position
        FROM orders""",
)
def split_rank(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return row_numbers(df, [hash_order(["o_orderkey"]), F.col("o_orderkey").cast("string")], "position", ["o_orderstatus"])


def _task_sql(table: str, column: str, text: bool) -> str:
    kind = "true" if text else "false"
    return f"""SELECT '{column}' AS "column", CASE WHEN {kind} OR count(DISTINCT {column}) <= 20 THEN 'classification'
        ELSE 'regression' END AS script_rule,
        {kind} OR count(DISTINCT {column}) < 10 AS selection_rule,
        count(DISTINCT {column}) < 10 OR count(DISTINCT {column}) < 0.05 * count(*) AS share_rule FROM {table}"""


TARGETS = [
    ("lineitem", "l_linestatus", True), ("lineitem", "l_quantity", False), ("lineitem", "l_discount", False),
    ("lineitem", "l_extendedprice", False), ("labels", "quality", False),
]


@query("detect_task", " UNION ALL ".join(_task_sql(*x) for x in TARGETS))
def detect_task_query(t: Tables):
    rows = []
    for table, column, _ in TARGETS:
        df = getattr(t, table)
        rows.append(
            (column, detect_task(df, column), classify_target(df, column, "selection"), classify_target(df, column, "share"))
        )
    return t.spark.createDataFrame(rows, "column string, script_rule string, selection_rule boolean, share_rule boolean")
