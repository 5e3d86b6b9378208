"""Sources and sinks."""

from pyspark.sql import functions as F

from ..operators.profile import preview, table_checksum
from ..plans.preprocess import engineer_features, export_processed, prepare_data
from ..session import scratch_path
from ..sources.files import read_table, write_table
from ..sources.snapshots import current_version, registry, snapshot_dataset
from .base import Tables, holes, query, rounded

ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _round_trip(t: Tables, df, fmt: str):
    path = scratch_path(t.spark, f"table-{fmt}")
    write_table(df, path, fmt)
    return read_table(t.spark, path, fmt, schema=df.schema)


@query("scan_parquet", ORDERS_SQL)
def scan_parquet(t: Tables):
    return read_table(t.spark, f"{t.folder}/orders.parquet")


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(t: Tables):
    return _round_trip(t, t.customer, "csv")


@query("scan_json", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_json(t: Tables):
    return _round_trip(t, t.part, "json")


@query("sink_csv", "SELECT event_id, user_id, ts, event_type, value, props FROM events")
def sink_csv(t: Tables):
    return _round_trip(t, t.events, "csv")


@query(
    "sink_json",
    """SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(text) END AS digest
       FROM documents""",
)
def sink_json(t: Tables):
    back = _round_trip(t, holes(t.documents, "text", "doc_id % 5 = 0"), "json")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("sink_parquet", ORDERS_SQL)
def sink_parquet(t: Tables):
    return _round_trip(t, t.orders, "parquet")


@query(
    "preview",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total_rows
       FROM orders ORDER BY o_orderkey LIMIT 5""",
)
def preview_query(t: Tables):
    return preview(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), 5, ["o_orderkey"])


def fences_sql(source: str, columns: list[str], prefix: str = "s") -> str:
    """CTEs that filter ``source`` by the quartile fences of each column in turn."""
    parts, current = [], source
    for i, c in enumerate(columns):
        parts.append(
            f"{prefix}q{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {current}), "
            f"{prefix}{i} AS (SELECT x.* FROM {current} x, {prefix}q{i} "
            f"WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"
        )
        current = f"{prefix}{i}"
    return ", ".join(parts)


PREPARE_SQL = f"""
WITH base AS (
  SELECT DISTINCT event_id, user_id,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events),
medians AS (SELECT quantile_cont(value, 0.5) AS m FROM base),
modes AS (SELECT event_type AS v FROM base WHERE event_type IS NOT NULL
          GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1),
filled AS (SELECT event_id, user_id, coalesce(event_type, v) AS event_type, coalesce(value, m) AS value
           FROM base, medians, modes),
{fences_sql("filled", ["event_id", "user_id", "value"])}
SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, event_type, round(value, 4) AS value
FROM s2"""


def _messy_events(t: Tables):
    df = t.events.select("event_id", "user_id", "event_type", "value")
    df = holes(holes(df, "event_type", "event_id % 9 = 0"), "value", "event_id % 7 = 0")
    return df.unionByName(df.where("event_id % 10 = 3"))


@query("prepared_table", PREPARE_SQL)
def prepared_table(t: Tables):
    path = scratch_path(t.spark, "prepared")
    write_table(prepare_data(_messy_events(t)), path, "parquet")
    return rounded(read_table(t.spark, path, "parquet"))


@query("prepare_data", PREPARE_SQL)
def prepare_data_query(t: Tables):
    return rounded(prepare_data(_messy_events(t)))


@query("engineered_table")
def engineered_table(t: Tables):
    df = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    table, _ = engineer_features(df, "l_extendedprice")
    path = scratch_path(t.spark, "engineered")
    write_table(table, path, "parquet")
    return rounded(read_table(t.spark, path, "parquet"))


@query("export_processed")
def export_processed_query(t: Tables):
    path = scratch_path(t.spark, "export")
    steps = {"imputation": "c_acctbal", "encoding": "c_mktsegment", "normalization": "c_acctbal"}
    export_processed(holes(t.customer, "c_acctbal", "c_custkey % 6 = 0"), steps, path, "csv")
    return rounded(read_table(t.spark, path, "csv"))


@query("snapshot_dataset")
def snapshot_query(t: Tables):
    root = scratch_path(t.spark, "snapshots")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    snapshot_dataset(orders, root, "sales", "orders")
    snapshot_dataset(orders.dropDuplicates(["o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_custkey", "o_orderstatus", "o_orderpriority"),
                     root, "sales", "orders", tag="preprocessed")
    snapshot_dataset(orders, root, "sales", "orders", make_current=False)
    current = current_version(t.spark, root, "sales", "orders").first()["version"]
    known = registry(t.spark, root).select("version", "tag", "num_rows", "num_columns", "checksum", "is_current")
    return known.withColumn("current", F.col("version") == current).orderBy("version")


CHECKSUM_SQL = """
SELECT count(*) AS n_rows,
       CAST(CAST(sum(CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
            CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
            l_returnflag, l_linestatus)), 1, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS checksum
FROM lineitem"""


@query("table_checksum", CHECKSUM_SQL)
def checksum_query(t: Tables):
    def cents(c: str):
        return F.round(F.col(c) * 100).cast("long")

    columns = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    columns += [cents("l_quantity"), cents("l_extendedprice"), F.col("l_returnflag"), F.col("l_linestatus")]
    return table_checksum(t.lineitem, columns)
