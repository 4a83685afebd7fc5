"""Events of a run as rows: what happened to each document is told by the columns of its result.

Nothing is logged in the executors. Rows are made from the result by one projection, filtered by level, and written as JSON
lines by Spark, or appended to one file or shown on the console by the driver, row by row.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts string, level string, logger string, event string, module string, data map<string,string>, exc string"
# Names of the events.
EVENTS = (
    "extraction_start", "extraction_failed", "extraction_complete", "cleaning_pipeline_complete", "ocr_skipped", "ocr_start", "ocr_cache_hit",
    "ocr_complete", "ocr_cache_miss",
)
#: Levels from the least on; warnings about documents that are images have one of their own.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def _event(name: str, module: str, level: str = "INFO", when: Column | None = None, exc: Column | None = None, **data: Column) -> Column:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    told = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    row = F.struct(
        F.lit(level).alias("level"), F.lit(f"pagewright.{module}").alias("logger"), F.lit(name).alias("event"), F.lit(module.rpartition(".")[2]).alias("module"),
        told.alias("data"), (F.lit(None).cast("string") if exc is None else exc).alias("exc"),
    )
    return row if when is None else F.when(when, row)


def of_documents(done: DataFrame, n_steps: int, at: Column | None = None) -> DataFrame:
    """SCHEMA: the events of each document of process_files, in order; n_steps is the number of cleaning steps.

    Recognition is told for kinds that have pages or are images: skipped where no page needed it or it is switched off, else
    started, with the pages that were found in the cache and those that were not, and completed.
    """
    path, failed = F.col("source"), F.col("error").isNotNull()
    good, scanned = ~failed, F.col("source_type").isin("pdf", "image")
    asked = good & scanned & (F.coalesce("ocr_wanted", F.lit(0)) > 0)
    hits = F.coalesce("ocr_hits", F.lit(0))
    rows = [
        _event("extraction_start", "plans.process", path=path, extension=F.lower(F.regexp_extract("source", r"(\.[^./\\]+)$", 1))),
        _event("ocr_skipped", "operators.ocr", when=good & scanned & ~asked, path=path),
        _event("ocr_start", "operators.ocr", when=asked, path=path, pages=F.col("ocr_wanted")),
        _event("ocr_cache_hit", "operators.ocr", when=asked & (hits > 0), path=path, pages=hits),
        _event("ocr_cache_miss", "operators.ocr", when=asked & (hits < F.col("ocr_wanted")), path=path, pages=F.col("ocr_wanted") - hits),
        _event("ocr_complete", "operators.ocr", when=asked, path=path, pages=F.size("ocr_pages")),
        _event("image_based", "operators.pages", "WARNING", good & F.coalesce("image_based", F.lit(False)) & ~F.col("ocr_used"), path=path, reason=F.col("image_based_reason")),
        _event("extraction_failed", "plans.process", "ERROR", failed, F.concat_ws(": ", "error_type", "error"), path=path, error_type=F.col("error_type"), error=F.col("error")),
        _event(
            "extraction_complete", "plans.process", when=good, path=path, sections=F.size("sections"), ocr_used=F.col("ocr_used"), ocr_pages=F.size("ocr_pages"),
            original_chars=F.col("original_chars"), cleaned_chars=F.col("cleaned_chars"), reduction_percent=F.col("reduction_percent"),
        ),
        _event("cleaning_pipeline_complete", "plans.process", when=good & (F.col("original_chars") > 0), path=path, steps=F.lit(n_steps)),
    ]
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    listed = done.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return listed.select((now if at is None else at).alias("ts"), *(x.split(" ")[0] for x in SCHEMA.split(", ")[1:]))


def at_least(events: DataFrame, level: str) -> DataFrame:
    """The events of a level and the ones above it."""
    return events.where(F.col("level").isin(*LEVELS[LEVELS.index(level) :]))


def json_line(events: DataFrame) -> DataFrame:
    """(value): one JSON object a row; empty data and missing exc are left out."""
    shown = events.withColumn("data", F.when(F.size("data") > 0, F.col("data")))
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("value"))


def key_values(events: DataFrame) -> DataFrame:
    """(value): the event followed by its data as k=v, by k."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return events.select(F.rtrim(F.concat(F.col("event"), F.lit(" "), pairs)).alias("value"))


def write_events(events: DataFrame, folder: str) -> None:
    """Appends the events to a folder of JSON lines, by the executors."""
    json_line(events).write.mode("append").text(folder)


def append_to_file(events: DataFrame, file: str | Path) -> None:
    """Appends the events to one file of the driver, row by row."""
    Path(file).parent.mkdir(parents=True, exist_ok=True)
    with open(file, "a", encoding="utf-8") as out:
        out.writelines(f"{r.value}\n" for r in json_line(events).toLocalIterator())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
