"""The event log as a stream: a tail without gaps and repeats, windows over event time, running sums for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 4) -> DataFrame:
    """The event files of a folder as they appear; ``ts`` as an instant, so that it can carry a watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tail(events: DataFrame, since: int = 0, kinds: list[str] | None = None, late: str = "1 day") -> DataFrame:
    """Events after a cursor, each id once; an id may come again within the watermark."""
    out = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).where(F.col("event_id") > since)
    return out.where(F.col("event_type").isin(*kinds)) if kinds else out


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """``(start, event_type, n, total)`` of windows over event time; a window closes when the watermark passes its end."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(user_id, start, end, n)`` of runs of a user's events with no longer gap between two."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is there, batch by batch, and stops; started again it goes on after the last batch."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_readings(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch under its number; a batch that is run again replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
