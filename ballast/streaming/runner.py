"""Running streams to tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import scratch_path


def table_stream(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """A parquet table, a single file or a directory of part files, as a stream.

    A file source takes a directory or a pattern, so the table is named by a pattern.
    `files_per_batch` bounds a micro-batch.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(f"{path}*")


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run what is available, appending to a new table; the table is returned.

    Rules that depend on the order of a key's rows are evaluated on the landed rows, so
    they do not depend on how files fell into micro-batches.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregation; each epoch is a folder that a replay
    overwrites, and the latest row per key is the answer."""
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    written = []

    def write(batch: DataFrame, epoch: int) -> None:
        written.append(epoch)
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    stored = spark.read.schema(stream.schema.add("epoch", "long")).parquet(target)
    rest = [name for name in stored.columns if name not in [*keys, "epoch"]]
    packed = F.struct(*[F.col(name) for name in rest])
    latest = stored.groupBy(*keys).agg(F.max_by(packed, "epoch").alias("_row"))
    return latest.select(*keys, "_row.*")


#: Marks a clock row: it moves the watermark of an otherwise quiet stream and belongs to no key.
CLOCK = "is_clock"


def run_closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], label: str, time: str = "ts") -> DataFrame:
    """Run a stateful append query over what is available, then close everything still open.

    Windows and timers end when the watermark passes them, and in a stream that has ended
    nothing moves it. A second source, a clock, is part of the query from the start: the query
    runs to the end of `events`, stops, and continues from its checkpoint with one clock row far
    in the future. `build` gets the stream with the column CLOCK and has to let clock rows pass
    its watermark. Landed rows are never read again; the output table is returned.
    """
    spark = events.sparkSession
    ticks = scratch_path(spark, f"{label}-clock")
    schema = events.schema.add(CLOCK, "boolean")
    spark.createDataFrame([], schema).write.parquet(ticks)
    clock = spark.readStream.schema(schema).parquet(ticks)
    result = build(events.withColumn(CLOCK, F.lit(False)).unionByName(clock))
    target, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def run() -> None:
        query = (
            result.writeStream.format("parquet").outputMode("append")
            .option("path", target).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    late = F.lit("2200-01-01").cast(events.schema[time].dataType)
    tick = [late.alias(f.name) if f.name == time else F.lit(f.name == CLOCK or None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*tick).write.mode("append").parquet(ticks)
    run()
    return spark.read.schema(result.schema).parquet(target)
