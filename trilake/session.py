"""Session defaults, the shared scratch folder, and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "trilake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # The JVM does not compile methods beyond 8000 bytes of code: let Spark split those.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str = "run") -> str:
    """A fresh path for intermediate tables in the folder the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    without that setting may fall back to a machine-local folder: executors on
    other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trilake-")
    path = f"{base.rstrip('/')}/trilake-{label}-{uuid.uuid4().hex}"
    # gone when the application ends
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: computed once."""
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
