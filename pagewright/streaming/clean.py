"""Cleaning of documents that arrive as a stream (an addition; batches and streams share the same expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagewright.operators.stats import estimate_tokens
from pagewright.operators.steps import Pipeline, default_pipeline
from pagewright.options import Options
from pagewright.session import checkpoint_folder
from pagewright.sources import files


def cleaned(stream: DataFrame, text: str = "text", pipeline: Pipeline | None = None) -> DataFrame:
    """The cleaned text and its tokens; stateless."""
    return (pipeline or default_pipeline()).clean(stream, text).withColumn("tokens_estimated", estimate_tokens(F.col(text)))


def without_repeats(stream: DataFrame, text: str = "text", time: str = "loaded_at", delay: str = "2 days") -> DataFrame:
    """Drops texts that came before within the delay; state is bounded by the watermark."""
    keyed = stream.withColumn("__key", F.sha2(F.col(text), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def tokens_by_window(stream: DataFrame, time: str = "loaded_at", text: str = "text", width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Documents and tokens by source in event-time windows; rows later than the delay are left out."""
    d = stream.withWatermark(time, delay).withColumn("__tokens", estimate_tokens(F.col(text)))
    return d.groupBy(F.window(time, width), "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("__tokens").alias("tokens"))


def extract_stream(spark: SparkSession, folder: str, options: Options = Options(), per_trigger: int = 1000) -> DataFrame:
    """Documents of the files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.extract(arriving, options)


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Runs a stream into a function of micro-batches; progress is kept in the shared folder, so that a restart goes on."""
    writer = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{checkpoint_folder(stream.sparkSession)}/streams/{name}").foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
