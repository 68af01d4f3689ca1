"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir or checkpoint directory names it.

    Only a local session, where all run on one machine, gets one of its own if none is set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scopes: list[list[str]] = []


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared folder: smaller than a checkpoint where rows hold text, and of known size.

    What no ``scratch`` around it deletes, as a result still reads it, goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, system = _hadoop(spark, path)
    system.deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """The paths of the tables stored inside; those that are still listed are deleted at the end."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            at, system = _hadoop(spark, path)
            system.delete(at, True)


def kept_by(paths: list[str], df: DataFrame) -> DataFrame:
    """df, stored in the scope around the one of paths, whose other tables can go."""
    out = stored(df)
    own = paths.pop()
    if len(_scopes) > 1:
        _scopes[-2].append(own)
    return out


def small_batches(spark: SparkSession) -> None:
    """Rows with texts go to Python a thousand at a time, unless the session says how many: Arrow's buffers and workers then hold a few MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default
        spark.conf.set(key, "1000")


def lower_ascii(col):
    """A-Z lower-cased, all else unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches, rows: int = 500):
    """Arrow batches in small slices, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
