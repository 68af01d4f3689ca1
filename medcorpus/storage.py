"""Tables that a job stores: intermediate ones, and results that are whole or not there.

A result's rows go to a new folder first. Then one small file, the entry, names that folder, and readers only follow entries. An entry is
made by a rename that does not replace, so a driver that is lost at any point leaves either no entry, and so the state before, or the whole
result; of two writers of one entry the first wins. (A file system whose rename replaces, as a local disk's, needs one writer at a time.)
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        if sc.applicationId not in _local:
            _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="medcorpus-")
        found = _local[sc.applicationId]
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, cut from its lineage and of known size; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, system = _at(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes in fewer parts than there are, as a small file does; a larger table stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Rows with texts go to Python a thousand at a time, unless the session says how many, so that a task's batch is a few MB however long its partition is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default
        spark.conf.set(key, "1000")


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    at, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def entries(spark: SparkSession, root: str) -> dict[str, dict]:
    """The entries made under root by name; none if root is not there."""
    at, system = _at(spark, root)
    found = {}
    for status in system.listStatus(at) if system.exists(at) else ():
        name = status.getPath().getName()
        if name.startswith("entry-") and name.endswith(".json"):
            stream = system.open(status.getPath())
            try:
                found[name[6:-5]] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return found


def enter(spark: SparkSession, root: str, name: str, entry: dict) -> bool:
    """Makes an entry visible; False if there is one of that name, which stays."""
    to, system = _at(spark, f"{root}/entry-{name}.json")
    if system.exists(to):
        return False
    draft, _ = _at(spark, f"{root}/_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    if system.rename(draft, to):
        return True
    system.delete(draft, False)
    return False


def write_data(df: DataFrame, root: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> str:
    """Writes df to a new folder under root, which nobody reads before an entry names it, and returns its path."""
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.format(fmt).partitionBy(*by).save(path)
    return path


def write_version(df: DataFrame, folder: str, root: str, fmt: str = "parquet", about: dict | None = None) -> dict:
    """Writes df under folder and enters it under root as the next version. The version before stays for its readers, older ones are deleted."""
    spark = df.sparkSession
    entry = {**(about or {}), "path": write_data(df, folder, fmt), "format": fmt, "columns": df.columns}
    version = max(map(int, entries(spark, root)), default=0) + 1
    while not enter(spark, root, f"{version:09}", entry):
        version += 1
    for name, old in entries(spark, root).items():
        if int(name) < version - 1:
            for path in (f"{root}/entry-{name}.json", old["path"]):
                at, system = _at(spark, path)
                system.delete(at, True)
    return entry


def last_version(spark: SparkSession, root: str) -> dict | None:
    """The newest entry of write_version under root."""
    found = entries(spark, root)
    return found[max(found, key=int)] if found else None


def read_entry(spark: SparkSession, entry: dict) -> DataFrame:
    return spark.read.format(entry["format"]).load(entry["path"]).select(*entry["columns"])


def delete_unentered(spark: SparkSession, folder: str, root: str | None = None) -> int:
    """Deletes the folders of data under folder that no entry under root names, left by writers that were lost; returns their number.

    Not for use while another job writes there.
    """
    at, system = _at(spark, folder)
    named = {e["path"].rsplit("/", 1)[-1] for e in entries(spark, root or folder).values()}
    own = [s.getPath() for s in (system.listStatus(at) if system.exists(at) else ())]
    lost = [p for p in own if p.getName().startswith("data-") and p.getName() not in named]
    for p in lost:
        system.delete(p, True)
    return len(lost)
