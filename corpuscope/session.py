"""The session's shared folder: where lineage is cut and stored views are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all hosts share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager)


#: Inputs of up to so many bytes, by Spark's own statistics, are dealt out to all cores.
SMALL_INPUT = 256 << 20


#: Bytes, by Spark's own statistics, of one part of a table that is dealt out by a key.
PART_INPUT = 1 << 20
#: A table of more such parts has no known size (Spark then says 8 EB).
MOST_PARTS = 1 << 16


def size_of(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(*tables: DataFrame) -> int | None:
    """How many parts tables are dealt out in together, the more the larger they are; None where Spark knows no size."""
    n = -(-sum(size_of(t) for t in tables) // PART_INPUT)
    return None if n > MOST_PARTS else max(tables[0].sparkSession.sparkContext.defaultParallelism, n)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by a key in parts whose number grows with the table; as the session is set, where Spark knows no size."""
    n = parts(df)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows of a table of which nearly all are: dealt out whole, in parts whose number grows with the table.

    Hash tables before the exchange would hold a part of a file each and leave out nothing, and those after it would
    hold as much as the session's fixed number of partitions makes of the table.
    """
    return dealt(df, *df.columns).distinct()


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out evenly: a file of one row group would be worked on by one task. Larger ones stay as they are."""
    if size_of(df) > SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
