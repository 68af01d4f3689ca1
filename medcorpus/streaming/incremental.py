"""Work that goes on where it stopped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medcorpus import storage


def pending_requests(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Requests without an answer."""
    return requests.join(answers.select(key), key, "left_anti")


def ingest_predictions(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, keys: tuple[str, ...] = ("tag", "id"), fmt: str = "json", buckets: int = 64, files_a_batch: int | None = None) -> None:
    """Appends what is new in source to the table at target (see ``read_ingested``), once a key, and ends.

    No keys are held as state: the table itself says what is there. Each batch is compared with the keys of the batches before, of those
    buckets only that it touches, and is entered under its number in one step. A batch that is run again after a lost driver finds the same
    rows before it, and either its entry, or none and writes anew; so no row is lost or doubled wherever the job was killed.
    """
    names = list(keys)

    def write(batch: DataFrame, number: int) -> None:
        own, done = batch.sparkSession, storage.entries(batch.sparkSession, target)
        if f"{number:012}" in done:
            return
        new = batch.dropDuplicates(names).withColumn("_bucket", F.pmod(F.hash(*names), F.lit(buckets)))
        touched = {f"_bucket={r[0]}" for r in new.select("_bucket").distinct().collect()}
        # of each earlier batch the keys of the buckets in question; buckets are folders
        before = [f"{e['path']}/{b}" for name, e in done.items() if int(name) < number for b in e["buckets"] if b in touched]
        if before:
            old = own.read.schema(StructType([batch.schema[n] for n in names])).option("recursiveFileLookup", True).parquet(*before)
            same = reduce(lambda a, b: a & b, [F.col(f"new.`{n}`").eqNullSafe(F.col(f"old.`{n}`")) for n in names])
            new = new.alias("new").join(old.alias("old"), same, "left_anti")
        path = storage.write_data(new, target, by=("_bucket",))
        written = [b for b in storage.children(own, path) if b.startswith("_bucket=")]
        storage.enter(own, target, f"{number:012}", {"path": path, "format": "parquet", "columns": batch.columns, "buckets": written})

    rows = spark.readStream.format(fmt).schema(schema)
    rows = (rows.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else rows).load(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that were entered at target."""
    empty = spark.createDataFrame([], schema)
    paths = [e["path"] for e in storage.entries(spark, target).values() if e["buckets"]]
    # the buckets' folders are no column of the rows
    return spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(*paths) if paths else empty


def ingest_events(spark: SparkSession, source: str, schema: StructType | str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of a stream of events(ts, event_type, value) by window and type, late rows up to a limit."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
