"""Commit streams: each micro-batch of file changes becomes a new version of the chunk view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import incremental

COMMIT_SCHEMA = "seq long, file string, level string, content string, deleted boolean"


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Change files dropped into a folder, as a stream."""
    return spark.readStream.schema(COMMIT_SCHEMA).json(path)


STATE_SCHEMA = "seq long, file string, level string, content string, deleted boolean, content_hash string"


def applied(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest change of each file and level, deletions among them; a change that comes late does not undo a newer one."""
    rows = state.select("seq", "file", "level", "content", "deleted").unionByName(batch.select("seq", "file", "level", "content", "deleted"))
    last = rows.groupBy("file", "level").agg(F.max_by(F.struct("seq", "content", "deleted"), F.struct("seq", "content")).alias("r"))
    return last.select("r.seq", "file", "level", "r.content", F.coalesce("r.deleted", F.lit(False)).alias("deleted")).withColumn("content_hash", F.md5("content"))


def live_chunks(state: DataFrame) -> DataFrame:
    """Current chunk of each file and level."""
    return state.filter("not deleted").select("file", "level", "seq", "content", "content_hash")


def apply_delta(root: str):
    """For ``foreachBatch``: the last state and the batch give the next state; its view and the delta against the last are written.

    The work grows with the state and the batch, not with the history. A batch that is run again writes the same
    version again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], STATE_SCHEMA)
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{root}/states/v{batch_id - 1}") if batch_id else empty
        applied(state, batch).write.mode("overwrite").parquet(f"{root}/states/v{batch_id}")
        new = live_chunks(spark.read.schema(STATE_SCHEMA).parquet(f"{root}/states/v{batch_id}"))
        new.write.mode("overwrite").parquet(f"{root}/versions/v{batch_id}")
        incremental.chunk_delta(live_chunks(state), new).write.mode("overwrite").parquet(f"{root}/deltas/v{batch_id}")

    return run


def start(spark: SparkSession, source: str, root: str):
    return read_commits(spark, source).writeStream.foreachBatch(apply_delta(root)).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window, with a bound on lateness."""
    return events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
