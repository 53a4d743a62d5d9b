"""Event streams: counts by hour, sessions, and ingestion without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exports import unseen
from ..scratch import folder as new_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema of what is there and `ts` as an instant."""
    there = spark.read.parquet(path)
    source = spark.readStream.schema(there.schema)
    if all(f.endswith(path.rpartition("/")[2]) for f in there.inputFiles()):  # a file, not a folder of them
        folder, _, name = path.rpartition("/")
        rows = source.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = source.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and type; with a watermark state is dropped as hours close."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(15,2)")).cast("decimal(25,2)").alias("value"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "value")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def appended(events: DataFrame, target: str, key: str) -> None:
    """Appends all that a stream has now to the table at `target`, each key once for ever.

    A batch meets the keys that are stored by other batches, however long ago, and overwrites its own folder, so
    that a batch that is run again, after a failure or by a stream without its checkpoint, changes nothing.
    """
    spark = events.sparkSession
    schema = f"{key} {dict(events.dtypes)[key]}, batch long"

    def write(rows: DataFrame, batch: int) -> None:
        there = spark.read.schema(schema).option("basePath", target).parquet(target).filter(F.col("batch") != batch)
        unseen(rows, there, key).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    query = events.writeStream.option("checkpointLocation", f"{new_folder(spark)}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(result: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the files there are now, written to the shared folder and read back."""
    spark = result.sparkSession
    folder = new_folder(spark)
    write = "overwrite" if mode == "complete" else "append"
    query = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda df, _: df.write.mode(write).parquet(f"{folder}/rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")
