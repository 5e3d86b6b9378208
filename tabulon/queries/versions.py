"""Registry queries over tables derived from the given ones."""

from pyspark.sql import functions as F

from ..operators.versions import (
    compare_models, expired_sessions, keep_latest_n, latest_version, list_versions, model_run_metrics, next_version,
    project_summary, rank_models, select_model, uptime_hours,
)
from .base import Tables, query, rounded

# every order is one dataset version: customer = project, priority = dataset name
VERSIONS = """(SELECT o_orderkey AS id, o_custkey AS project, o_orderpriority AS name,
    'V' || CAST(1 + o_orderkey % 3 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.' || CAST(o_orderkey % 11 AS VARCHAR) ELSE '' END
    AS version, o_orderdate AS created_at, o_orderstatus = 'F' AS is_current FROM orders)"""


def _versions(t: Tables):
    key = F.col("o_orderkey")
    minor = F.when(key % 2 == 0, F.concat(F.lit("."), (key % 11).cast("string"))).otherwise("")
    return t.orders.select(
        key.alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("V"), (1 + key % 3).cast("string"), minor).alias("version"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("is_current"),
    )


def _newest(keys: str, order: str, source: str = VERSIONS) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r FROM {source}) WHERE r = 1)"


@query(
    "latest_version",
    f"SELECT id, project, name, version FROM {_newest('project, name', 'is_current DESC, created_at DESC, id DESC')}",
)
def latest_version_query(t: Tables):
    return latest_version(_versions(t), ["project", "name"], "created_at", "id", "is_current").select(
        "id", "project", "name", "version"
    )


@query(
    "current_version",
    f"SELECT id, name, version, is_current FROM {_newest('name', 'is_current DESC, created_at DESC, id DESC')}",
)
def current_version_query(t: Tables):
    found = latest_version(_versions(t), ["name"], "created_at", "id", "is_current")
    return found.select("id", "name", "version", "is_current")


@query(
    "next_version",
    f"""SELECT project, name, version, CASE WHEN version = 'V1' THEN 'V2' WHEN version NOT LIKE '%.%' THEN version || '.1'
        ELSE split_part(version, '.', 1) || '.' || CAST(CAST(split_part(version, '.', 2) AS INTEGER) + 1 AS VARCHAR) END AS next_version
        FROM {_newest('project, name', 'created_at DESC, id DESC')}""",
)
def next_version_query(t: Tables):
    return next_version(_versions(t), ["project", "name"], "version", "created_at", "id")


@query(
    "keep_latest_n",
    f"""SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id DESC) <= 5 AS keep
        FROM {VERSIONS}""",
)
def keep_latest_query(t: Tables):
    return keep_latest_n(_versions(t), ["project"], "created_at", "id").select("id", "project", "keep")


@query("list_versions", f"SELECT id, version, created_at FROM {VERSIONS} WHERE name = '1-URGENT' ORDER BY created_at DESC, id DESC")
def list_versions_query(t: Tables):
    return list_versions(_versions(t), "created_at", "id", name="1-URGENT").select("id", "version", "created_at")


@query("recent_versions", f"SELECT id, name, version, created_at FROM {VERSIONS} ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_versions(t: Tables):
    return list_versions(_versions(t), "created_at", "id", limit=10).select("id", "name", "version", "created_at")


@query(
    "expired_sessions",
    """SELECT event_id, user_id, ts + INTERVAL 24 HOUR AS expires_at FROM events
       WHERE ts + INTERVAL 24 HOUR < TIMESTAMP '2024-01-15 00:00:00'""",
)
def expired_query(t: Tables):
    sessions = t.events.select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return expired_sessions(sessions, F.expr("timestamp_ntz'2024-01-15 00:00:00'"))


@query(
    "project_summary",
    """SELECT c.c_custkey AS project, c.c_nationkey AS owner, k.balance, coalesce(e.n, 0) AS experiment_count, coalesce(m.n, 0) AS model_count
       FROM customer c LEFT JOIN (SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) k ON k.c_custkey = c.c_custkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) e ON e.o_custkey = c.c_custkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) m ON m.o_custkey = c.c_custkey""",
)
def project_summary_query(t: Tables):
    projects = t.customer.select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("owner"))
    configs = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("project"), F.col("c_acctbal").alias("balance"))
    experiments = t.orders.select(F.col("o_custkey").alias("project"), "o_orderstatus")
    return project_summary(projects, configs, experiments, experiments.where("o_orderstatus = 'F'"), "project")


def _models(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "P", "archived").otherwise("active").alias("status"),
        F.create_map(F.lit("f1_score"), price / 500000, F.lit("accuracy"), price / 450000).alias("metrics"),
        F.col("o_orderdate").alias("created_at"), (price * 400).cast("long").alias("size_bytes"),
    )


RUN_METRICS = """SELECT o_orderkey AS id, o_totalprice / 500000 AS f1_score,
       CASE WHEN c_custkey IS NOT NULL THEN c_acctbal / 10000 ELSE o_totalprice / 450000 END AS accuracy,
       c_acctbal / 20000 AS loss
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'"""


@query("model_run_metrics", RUN_METRICS)
def model_run_query(t: Tables):
    runs = t.customer.where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("run_id"),
        F.create_map(F.lit("accuracy"), F.col("c_acctbal") / 10000, F.lit("loss"), F.col("c_acctbal") / 20000).alias("metrics"),
    )
    return _run_metrics(_models(t), runs)


def _run_metrics(models, runs):
    merged = model_run_metrics(models, runs)
    return merged.select("id", *[F.element_at("all_metrics", F.lit(k)).alias(k) for k in ("f1_score", "accuracy", "loss")])


@query("stored_metrics", RUN_METRICS)
def stored_metrics_query(t: Tables):
    numbers = F.create_map(F.lit("accuracy"), F.col("c_acctbal") / 10000, F.lit("loss"), F.col("c_acctbal") / 20000)
    runs = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("run_id"), F.to_json(numbers).alias("metrics"))
    return _run_metrics(_models(t).withColumn("metrics", F.to_json("metrics")), runs)


@query("uptime_hours", "SELECT event_id, round((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 3600000000.0, 4) AS hours FROM events")
def uptime_query(t: Tables):
    now = F.lit("2030-01-01").cast(t.events.schema["ts"].dataType)
    return rounded(t.events.select("event_id", uptime_hours(F.col("ts"), now).alias("hours")))


COMPARED = """(SELECT id, f1 + 0.1 * greatest(0, 1 - days / 30.0) AS score, size_mb, f1 >= 0.6 AND acc >= 0.7 AND size_mb <= 180 AS is_eligible,
    concat_ws('; ', CASE WHEN f1 < 0.6 THEN 'Primary metric f1_score below threshold' END,
              CASE WHEN acc < 0.7 THEN 'Secondary metric thresholds not met' END,
              CASE WHEN size_mb > 180 THEN 'Model size exceeds limit' END) AS reasons
    FROM (SELECT o_orderkey AS id, o_totalprice / 500000 AS f1, o_totalprice / 450000 AS acc,
                 date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS days,
                 trunc(o_totalprice * 400) / 1048576 AS size_mb FROM orders))"""


def _compared(t: Tables):
    return compare_models(
        _models(t), "f1_score", 0.6, {"accuracy": 0.7}, F.to_date(F.lit("2001-08-02")), max_size_mb=180.0
    )


def _shown(df):
    return rounded(
        df.select("id", "score", "size_mb", "is_eligible", F.concat_ws("; ", "eligibility_reasons").alias("reasons")), 10
    )


SHOWN_SQL = f"SELECT id, round(score, 10) AS score, round(size_mb, 10) AS size_mb, is_eligible, reasons FROM {COMPARED} x"


@query("compare_models", SHOWN_SQL)
def compare_query(t: Tables):
    return _shown(_compared(t))


@query("rank_models", SHOWN_SQL + " ORDER BY x.score DESC, id LIMIT 20")
def rank_query(t: Tables):
    return _shown(rank_models(_compared(t), "id", 20))


@query("select_model", SHOWN_SQL + " WHERE is_eligible ORDER BY x.score DESC, id LIMIT 1")
def select_query(t: Tables):
    return _shown(select_model(_compared(t), "id"))
