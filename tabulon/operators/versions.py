"""Queries over version, model and session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import col, require
from .lookup import lookup_join

KEEP_VERSIONS = 5
AGE_BONUS_DAYS = 30
AGE_BONUS_WEIGHT = 0.1
#: Why a model isn't eligible.
REASONS = ("Primary metric {primary} below threshold", "Secondary metric thresholds not met", "Model size exceeds limit")


def _best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The greatest row per key by ``order`` (ascending columns), as a combining aggregate.

    max_by needs no sort and a hot key shrinks to one row per task before the shuffle.
    """
    row = F.struct(*[col(n) for n in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*[col(k) for k in keys]).agg(F.max_by(row, rank).alias("__best"))
    return best.select("__best.*")


def latest_version(
    versions: DataFrame, keys: Sequence[str], created: str, tie: str, current: str | None = None
) -> DataFrame:
    """One row per dataset: the flagged current one if there is any, else the newest."""
    require(versions, *keys, created, tie)
    flag = [F.coalesce(col(current).cast("int"), F.lit(0))] if current else []
    return _best_per(versions, keys, [*flag, col(created), col(tie)])


def next_version_of(version: Column) -> Column:
    """none -> V1, V1 -> V2, Vn -> Vn.1, Vn.m -> Vn.(m+1)."""
    major = F.regexp_extract(version, r"^(.*)\.([^.]*)$", 1)
    minor = F.regexp_extract(version, r"^(.*)\.([^.]*)$", 2)
    return (
        F.when(version.isNull(), "V1").when(version == "V1", "V2")
        .when(~version.contains("."), F.concat(version, F.lit(".1")))
        .otherwise(F.concat(major, F.lit("."), (minor.cast("int") + 1).cast("string")))
    )


def next_version(versions: DataFrame, keys: Sequence[str], version: str, created: str, tie: str) -> DataFrame:
    """(keys, version, next_version) for every dataset, from its newest version."""
    newest = latest_version(versions, keys, created, tie)
    return newest.select(*[col(k) for k in keys], col(version), next_version_of(col(version)).alias("next_version"))


def keep_latest_n(
    versions: DataFrame, keys: Sequence[str], created: str, tie: str, n: int = KEEP_VERSIONS
) -> DataFrame:
    """Add ``keep``: whether a version is among the newest n of its dataset.

    The n-th newest (created, tie) per dataset comes from a combining pass over salted parts, and goes
    back to the rows as a lookup, so no dataset is ever sorted in one task.
    """
    require(versions, *keys, created, tie)
    salt = F.pmod(F.xxhash64(col(tie)), F.lit(64))
    stamp = versions.select(*[col(k) for k in keys], col(created).alias("__c"), col(tie).alias("__t"), salt.alias("__s"))
    order = [F.desc("__c"), F.desc("__t")]
    parts = stamp.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*order)))
    few = parts.where(F.col("__r") <= n).drop("__r")
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cut = ranked.where(F.col("__r") <= n).groupBy(*keys).agg(F.min(F.struct("__c", "__t")).alias("__cut"))
    keyed = lookup_join(versions, cut, list(keys))
    inside = F.struct(col(created).alias("__c"), col(tie).alias("__t")) >= F.col("__cut")
    return keyed.withColumn("keep", inside).drop("__cut")


def list_versions(
    versions: DataFrame, created: str, tie: str, name: str | None = None, name_column: str = "name",
    limit: int | None = None,
) -> DataFrame:
    """Newest first, optionally of one dataset, optionally only the first few."""
    chosen = versions if name is None else versions.where(col(name_column) == name)
    ordered = chosen.orderBy(F.desc(created), F.desc(tie))
    return ordered if limit is None else ordered.limit(limit)


def expired_sessions(sessions: DataFrame, asof: Column, expires: str = "expires_at") -> DataFrame:
    return sessions.where(col(expires) < asof)


def registry_filter(table: DataFrame, **equal) -> DataFrame:
    """Equality filters by column; unknown columns are an error."""
    require(table, *equal)
    for name, value in equal.items():
        table = table.where(col(name) == F.lit(value))
    return table


def project_summary(
    projects: DataFrame, configs: DataFrame, experiments: DataFrame, models: DataFrame, key: str,
    owner: str | None = None, owner_column: str = "owner",
) -> DataFrame:
    """Projects with their configuration and their numbers of experiments and models."""
    chosen = projects if owner is None else projects.where(col(owner_column) == owner)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(col(key)).agg(F.count(F.lit(1)).alias(name))

    out = lookup_join(chosen, configs, [key], derived=False)
    out = lookup_join(out, counted(experiments, "experiment_count"), [key])
    out = lookup_join(out, counted(models, "model_count"), [key])
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("experiment_count", "model_count")}
    )


def stored_metrics(df: DataFrame, column: str = "metrics") -> DataFrame:
    """Metrics stored as JSON text become a map of names to numbers; anything else in the text is null."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, F.from_json(col(column), "map<string,double>"))


def uptime_hours(start: Column, end: Column) -> Column:
    """Hours from one timestamp to another, negative if the second is earlier."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3_600_000_000.0)


def model_run_metrics(models: DataFrame, runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Active models with ``all_metrics``: their own metrics overlaid by those of their run; maps or JSON text."""
    require(models, run_id, "status", "metrics")
    models, runs = stored_metrics(models), stored_metrics(runs)
    active = models.where(F.col("status") == "active")
    overlay = runs.select(col(run_id), F.col("metrics").alias("run_metrics"))
    joined = lookup_join(active, overlay, [run_id], derived=False)
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    own, run = F.coalesce("metrics", empty), F.coalesce("run_metrics", empty)
    kept = F.map_filter(own, lambda name, _: ~F.map_contains_key(run, name))
    return joined.withColumn("all_metrics", F.map_concat(kept, run)).drop("run_metrics")


def compare_models(
    models: DataFrame,
    primary: str,
    threshold: float,
    secondary: dict[str, float],
    asof: Column,
    max_size_mb: float | None = None,
    prefer_latest: bool = True,
    metrics: str = "metrics",
    created: str = "created_at",
    size: str = "size_bytes",
) -> DataFrame:
    """Add score, size_mb, is_eligible and eligibility_reasons."""
    def metric(name: str) -> Column:
        return F.coalesce(F.element_at(col(metrics), F.lit(name)), F.lit(0.0))

    value = metric(primary)
    days = F.datediff(asof, col(created))
    bonus = F.greatest(F.lit(0.0), 1 - days / F.lit(float(AGE_BONUS_DAYS))) * AGE_BONUS_WEIGHT
    size_mb = F.coalesce(col(size), F.lit(0)) / (1024 * 1024)
    meets = value >= threshold
    meets_rest = F.lit(True)
    for name, floor in secondary.items():
        meets_rest = meets_rest & (metric(name) >= floor)
    fits = size_mb <= max_size_mb if max_size_mb else F.lit(True)
    reasons = F.array_compact(
        F.array(
            *[F.when(~holds, reason.format(primary=primary)) for holds, reason in zip((meets, meets_rest, fits), REASONS, strict=True)]
        )
    )
    return models.withColumns(
        {
            "score": value + bonus if prefer_latest else value, "size_mb": size_mb,
            "is_eligible": meets & meets_rest & fits, "eligibility_reasons": reasons,
        }
    )


def rank_models(compared: DataFrame, tie: str, k: int | None = None) -> DataFrame:
    """Best score first, ties by id."""
    ordered = compared.orderBy(F.desc("score"), F.asc(tie))
    return ordered if k is None else ordered.limit(k)


def select_model(compared: DataFrame, tie: str, manual=None) -> DataFrame:
    """The manually named model if it exists, else the best eligible one."""
    if manual is not None:
        named = compared.where(col(tie) == F.lit(manual)).limit(1)
        if not named.isEmpty():
            return named
    return rank_models(compared.where("is_eligible"), tie, 1)
