"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "tabulon", cores: str | int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of this process's applications, by application id.
_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Only a local session may do without that setting; it then gets a fresh temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            import tempfile

            shared = tempfile.mkdtemp(prefix="tabulon-")
        root = f"{shared.rstrip('/')}/tabulon-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, label: str = "frozen") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, keeps column pruning."""
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(frozen: DataFrame) -> None:
    """Delete the files of a frozen table that nothing reads any more; files outside the scratch folder stay."""
    spark = frozen.sparkSession
    root = scratch_root(spark).removeprefix("file://").removeprefix("file:")
    folders = {f.rsplit("/", 1)[0] for f in frozen.inputFiles()}
    for folder in folders:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
