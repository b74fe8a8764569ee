"""Incremental counts over a stream of membership rows; windowed counts of events are an extension of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder (or of one file), with the schema that they have now."""
    known = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(known).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def term_counts(members: DataFrame, genes: DataFrame, gene: str, term: str) -> DataFrame:
    """(cluster, term, n) of a stream of (term, gene) rows against a static (cluster, gene) table; kept in state by key."""
    return members.join(genes, gene).groupBy("cluster", term).agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, minutes: int = 60, late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window; windows close when the watermark passes them."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", f"{minutes} minutes")
    return d.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, run through the stream once, as a table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return spark.table(name)
    finally:
        query.stop()
