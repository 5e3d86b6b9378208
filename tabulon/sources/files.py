"""Reading and writing tables by file type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col

FORMATS = ("csv", "json", "parquet")
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def format_of(path: str, fmt: str | None = None) -> str:
    name = (fmt or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported file type: {name}")
    return name


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
    json_array: bool = False,
) -> DataFrame:
    """Load CSV (with header), JSON or Parquet.

    Give a schema for large CSV and JSON inputs: inferring one reads the data an extra time.
    ``json_array`` reads files that hold one JSON array instead of one record per line.
    """
    fmt = format_of(path, fmt)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", False)
        return (reader if schema else reader.option("inferSchema", True)).csv(path)
    if fmt == "json":
        return reader.option("multiLine", json_array).json(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """Write CSV (with header), JSON lines or Parquet; every task writes its own part."""
    fmt = format_of(path, fmt)
    # all digits of a time, which the default formats cut to milliseconds
    writer = df.write.mode(mode).option("timestampNTZFormat", MICROS).option("timestampFormat", MICROS + "[XXX]")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        # a key whose value is null must come back as a column
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """(column, dtype) as recorded with a dataset version."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in df.dtypes]
    return df.sparkSession.range(1).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def as_written(df: DataFrame) -> DataFrame:
    """The columns a flat file can hold: nested ones become JSON text."""
    out = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        out.append(F.to_json(col(f.name)).alias(f.name) if nested else col(f.name))
    return df.select(*out)
