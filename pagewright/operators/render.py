"""Documents as Markdown with front matter, plain text and JSON, and as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.pages import METRICS

# The figures in the order in which they are written.
FIGURES = (
    "original_size_bytes", "cleaned_size_bytes", "reduction_percent", "original_chars", "cleaned_chars", "tokens_estimated",
    "tokens_original_estimated", "tokens_reduction_percent", "tokens_input_estimated", "tokens_input_reduction_percent",
)
#: Texts that YAML would read as something else, or that need quotes to be read at all.
NEEDS_QUOTES = (
    r"(?i)\A(?:|[-?:]|[-?:] .*|[,\[\]{}#&*!|>'\"%@`].*|.*: .*|.* #.*|.*:|\s.*|.*\s|~|null|yes|no|on|off|true|false|y|n|[-+.\d][\d_.:,eE+\-TZ]*|[-+]?0[xob][\da-f_]+|[-+]?\.(?:inf|nan)|---.*|=|<<)\z"
)


def yaml_text(t: Column) -> Column:
    """A text as a YAML scalar: plain, in single quotes where needed, in double ones with control characters."""
    single = F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(t.rlike(r"[\x00-\x1f\x7f\x85  ]"), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2)).when(t.rlike(NEEDS_QUOTES), single).otherwise(t)


def number_text(c: Column) -> Column:
    """Numbers as they are; doubles with at least one decimal."""
    return c.cast("string")


def yaml_list(a: Column, indent: str = "") -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("\n" + indent + "- "), F.array_join(F.transform(a, lambda x: x.cast("string")), "\n" + indent + "- "))).otherwise(F.lit(" []"))


def front_matter(df: DataFrame, extracted_at: Column) -> Column:
    """YAML lines of a document row; optional columns filtered_pages, image_based and image_based_metrics (see page_findings) add theirs."""
    parts = [
        F.concat(F.lit("source: "), yaml_text(F.col("source"))),
        F.concat(F.lit("type: "), yaml_text(F.col("source_type"))),
        F.concat(F.lit("extracted_at: '"), extracted_at, F.lit("'")),
        F.concat(F.lit("ocr_used: "), F.col("ocr_used").cast("string")),
        F.concat(F.lit("ocr_pages:"), yaml_list(F.col("ocr_pages"))),
        F.concat(F.lit("language: "), yaml_text(F.coalesce("language", F.lit("")))),
        F.lit("stats:"),
        *[F.concat(F.lit(f"  {f}: "), number_text(F.col(f))) for f in FIGURES],
    ]
    if "filtered_pages" in df.columns:
        kinds = [
            F.when(F.size(F.col("filtered_pages")[k]) > 0, F.concat(F.lit(f"  {k}:"), yaml_list(F.col("filtered_pages")[k], "  ")))
            for k in ("toc", "bibliography", "sparse")
        ]
        some = F.concat_ws("\n", *kinds)
        parts.append(F.when(some != "", F.concat(F.lit("filtered_pages:\n"), some)))
    if "image_based" in df.columns:
        parts.append(F.when(F.col("image_based"), F.lit("image_based: true")))
    if "image_based_metrics" in df.columns:
        lines = [F.concat(F.lit(f"  {m}: "), number_text(F.col("image_based_metrics")[m])) for m in METRICS]
        parts.append(F.when(F.col("image_based") & F.col("image_based_metrics").isNotNull(), F.concat_ws("\n", F.lit("image_based_metrics:"), *lines)))
    return F.concat_ws("\n", *parts)


def _section_parts(x: Column) -> Column:
    head = F.when((x["header"] != "") & ~x["continuation"], F.concat(F.lit("## "), x["header"]))
    body = T.rstrip(x["content"])
    return F.filter(F.array(head, F.when(body != "", body)), lambda p: p.isNotNull())


def markdown(df: DataFrame, extracted_at: Column) -> Column:
    """Front matter, title and sections, a blank line after each part and one line end at the last; sections is an array in order."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.array(F.concat(F.lit("# "), F.col("title")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(title, F.flatten(F.transform("sections", _section_parts))), "\n\n")
    head = F.concat(F.lit("---\n"), front_matter(df, extracted_at), F.lit("\n---\n"))
    return F.concat(head, F.when(body != "", F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise(F.lit("")))


def plain_text() -> Column:
    """Title, headers and contents that aren't empty, whatever carries on."""
    parts = F.flatten(F.transform("sections", lambda x: F.array(x["header"], x["content"])))
    all_parts = F.filter(F.concat(F.array(F.coalesce("title", F.lit(""))), parts), lambda p: p != "")
    return F.concat(F.array_join(all_parts, "\n\n"), F.lit("\n"))


def json_text() -> Column:
    """One JSON object in a row; a missing title is null."""
    sections = F.transform("sections", lambda x: F.struct(x["header"].alias("header"), x["content"].alias("content")))
    body = F.struct(
        "source", F.col("source_type").alias("type"), "title", "ocr_used", "ocr_pages", sections.alias("sections"), F.struct(*FIGURES).alias("stats")
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def render(df: DataFrame, kind: str, extracted_at: Column, max_chars: int = 0) -> DataFrame:
    """df with output, cut after max_chars characters where that isn't 0."""
    if kind not in ("md", "txt", "json"):
        raise ValueError(f"unknown format {kind!r}; md, txt and json are known")
    out = {"md": lambda: markdown(df, extracted_at), "txt": plain_text, "json": json_text}[kind]()
    return df.withColumn("output", F.left(out, F.lit(max_chars)) if max_chars else out)


def now_text() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def output_name(source: Column, key: Column, kind: str) -> Column:
    """File name of a document's output; the key keeps equal stems apart."""
    return F.concat(T.stem(source), F.lit("."), key.cast("string"), F.lit(f".clean.{kind}"))


def write_files(df: DataFrame, folder: str, kind: str) -> None:
    """One file per document in a folder of any file system that Spark knows; every file ends with a line end.

    Spark's committer makes the outputs whole or not at all, one folder a document beside the others; the driver then only
    renames them, so no text passes through it. Names hold the document's id, so no two documents meet.
    """
    spark = df.sparkSession
    path, unescape = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    beside = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    value = F.regexp_replace("output", "\n\\z", "")
    rows = df.select(output_name(F.col("source"), F.col("doc_id"), kind).alias("name"), value.alias("value"))
    try:
        rows.write.option("lineSep", "\n").partitionBy("name").text(beside)
        for d in (d for d in files.listStatus(path(beside)) if d.isDirectory()):
            target = path(folder, unescape(d.getPath().getName().removeprefix("name=")))
            for part in files.listStatus(d.getPath()):
                files.delete(target, False)
                files.rename(part.getPath(), target)
    finally:
        files.delete(path(beside), True)
