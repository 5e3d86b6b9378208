"""Numbered dataset snapshots with a registry table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..operators.profile import table_checksum, version_statistics
from ..operators.versions import next_version_of

REGISTRY = (
    "project string, name string, version string, tag string, path string, num_rows long, num_columns int, "
    "schema_info map<string,string>, statistics string, checksum string, size_bytes long, "
    "is_current boolean, created_at timestamp"
)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All recorded versions; the newest of a dataset that was recorded as current is the current one."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{root}/registry")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def snapshot_dataset(
    df: DataFrame, root: str, project: str, name: str, tag: str = "raw data", make_current: bool = True,
    checksum_columns: list[Column] | None = None,
) -> dict:
    """Copy a table to ``root/project/name/version`` and append its registry row.

    The digest and statistics are taken from the copy, so the source is read once.
    """
    spark = df.sparkSession
    known = registry(spark, root).where((F.col("project") == project) & (F.col("name") == name))
    last = known.agg(F.max_by("version", "created_at").alias("version"))
    version = last.select(next_version_of(F.col("version"))).first()[0]
    path = f"{root}/{project}/{name}/{version}"
    df.write.mode("errorifexists").parquet(path)
    copy = spark.read.parquet(path)
    columns = [col(c) for c in copy.columns] if checksum_columns is None else checksum_columns
    digest = table_checksum(copy, columns).first()
    statistics = version_statistics(copy).agg(
        F.to_json(F.collect_list(F.struct("column", "mean", "std", "nulls"))).alias("s")  # one entry per column
    ).first()[0]
    size = spark.read.format("binaryFile").load(f"{path}/*.parquet").agg(F.sum("length")).first()[0]
    row = {
        "project": project, "name": name, "version": version, "tag": tag, "path": path,
        "num_rows": digest["n_rows"], "num_columns": len(copy.columns), "schema_info": dict(copy.dtypes),
        "statistics": statistics, "checksum": digest["checksum"], "size_bytes": size,
        "is_current": make_current, "created_at": datetime.now(timezone.utc).replace(tzinfo=None),
    }
    spark.createDataFrame([tuple(row.values())], REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return row


def current_version(spark: SparkSession, root: str, project: str, name: str) -> DataFrame:
    """The newest version recorded as current, else the newest."""
    known = registry(spark, root).where((F.col("project") == project) & (F.col("name") == name))
    rank = F.struct(F.col("is_current").cast("int"), F.col("created_at"))
    best = known.agg(F.max_by(F.struct(*known.columns), rank).alias("b")).where("b IS NOT NULL")
    return best.select("b.*")
