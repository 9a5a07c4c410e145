"""Streams (an extension: the batch pipeline has none): late rows, repeated deliveries, windowed rates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.session import shared_folder


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream; the schema is that of the files now there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a single file is found by a pattern over its folder, a directory of parts as it is
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else source.parquet(f"{folder}/{name}.parquet")


def drained(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """All that the stream gives until its present end, through a checkpointed run, as a table.

    ``complete``: the whole result as it stands at the end (windows that are still open too), for aggregations; else the
    rows that are final.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if complete:
        done: list[int] = []

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/{number}")
            done.append(number)

        writer.outputMode("complete").foreachBatch(keep).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows/{max(done)}") if done else spark.createDataFrame([], stream.schema)
    writer.outputMode("append").format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def without_repeats(stream: DataFrame, keys: list[str], at: str, delay: str = "60 days") -> DataFrame:
    """The first delivery of each key; state is kept for ``delay`` of event time only."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 day", delay: str = "60 days") -> DataFrame:
    """``start, by, n`` per window of event time; rows later than ``delay`` are dropped, windows appear once closed."""
    marked = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return marked.groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def with_late_rows(stream: DataFrame, keys: list[str], at: str, delay: str = "60 days", name: str = "deliveries") -> tuple[DataFrame, DataFrame]:
    """All that the stream gives until its present end, each key once, and apart the rows that came too late to be told
    from repeats: ``(rows, late)``.

    A row is late if its event time is more than ``delay`` before the greatest one of earlier batches; null event times
    are late. Rows on time are kept if no earlier batch has their key. Each batch is written to a folder of its own, so one
    that is run again replaces what it wrote.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(stream.schema).parquet(*[f"{path}/rows/{n}" for n in done if n != number]) if set(done) - {number} else spark.createDataFrame([], stream.schema)
        latest = earlier.agg(F.max(at)).collect()[0][0]
        too_late = F.col(at).isNull() if latest is None else F.col(at).isNull() | (F.col(at) < F.lit(latest) - F.expr(f"interval {delay}"))
        batch.where(F.coalesce(too_late, F.lit(True))).write.mode("overwrite").parquet(f"{path}/late/{number}")
        fresh = batch.where(~F.coalesce(too_late, F.lit(True))).join(earlier.select(*keys), keys, "left_anti").dropDuplicates(keys)
        fresh.select(*stream.columns).write.mode("overwrite").parquet(f"{path}/rows/{number}")
        if number not in done:
            done.append(number)

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not done:
        empty = spark.createDataFrame([], stream.schema)
        return empty, empty
    read = lambda part: spark.read.schema(stream.schema).parquet(*[f"{path}/{part}/{n}" for n in done])
    return read("rows"), read("late")
