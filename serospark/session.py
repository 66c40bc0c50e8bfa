"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Deletes the shuffle files of a plan when it has ended; releases without the setting ignore it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "serospark", **conf) -> SparkSession:
    """A session with adaptive execution on; extra settings go in ``conf`` (dots as keys)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and (warehouse.startswith("file:") or ":" not in warehouse.split("/")[0]):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share; the warehouse is a folder of this machine")
    return os.path.join(warehouse, "_scratch")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir``, else a folder in the warehouse.

    Both are places that the cluster shares; a machine-local temporary folder is never used, and a warehouse on a machine's own
    disk is refused unless the session is local.
    """
    shared = _shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table inside the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str = "state", *folders: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, split into ``folders`` by these columns, and continue from it.

    Unlike an RDD checkpoint the table is columnar and has true sizes, so the following joins are
    planned on facts, and a lost executor only means reading files again. What the plan shuffled is deleted
    as soon as the table is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.repartition(*folders).write.partitionBy(*folders) if folders else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut_lineage`` that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
