"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; choose a folder only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="zetamill-ckpt-"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, in a session whose Arrow batches have at most so many rows.

    Rows here are whole texts, and a batch stands in memory several times (in the JVM outside the heap, in the pipe and in
    the worker), so the default of 10,000 rows would take hundreds of MB for each task.  A plan takes this setting when it
    is executed, after the operator has returned, so the setting stays lowered for the session.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back: this cuts its lineage.

    Unlike checkpoint(), which hands on estimates of sizes that are multiplied by every join, a table has its real size,
    by which joins are planned.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
