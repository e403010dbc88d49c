"""Session builder and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tessera", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A session with the settings this library assumes.

    AQE picks the number of reduce partitions, so ``partitions`` is only the
    upper bound before coalescing; timestamps are read in UTC.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of this machine; on a
    cluster a missing setting is an error, since a lost executor would take
    the intermediate tables with it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = os.path.join(tempfile.gettempdir(), f"tessera-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, so a lost executor costs a re-read and not a re-run, and
    gives later stages true sizes to plan with.
    """
    return Growing(df.sparkSession, name).add(df)


class Growing:
    """A table in the shared folder that grows by whole batches of rows; each reading sees the batches added before it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Append ``df`` and read all rows so far, as one scan and not as a union of many."""
        df.write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.spark.read.schema(df.schema).parquet(self.path)
