"""The whole way from files or sections to rendered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import ocr, pages, render, stats
from pagewright.operators.steps import Pipeline, default_pipeline
from pagewright.options import Options
from pagewright.session import cut_lineage
from pagewright.sources import files


def clean_sections(sections: DataFrame, pipeline: Pipeline, content: str = "content") -> DataFrame:
    """Cleans each section by itself; a blank one becomes empty. Repeats across sections stay."""
    blank = T.is_blank(F.col(content))
    return pipeline.clean(sections.withColumn(content, F.when(blank, "").otherwise(F.col(content))), content)


def clean_pages(page_table: DataFrame, pipeline: Pipeline, threshold: float = 0.30) -> DataFrame:
    """(doc_id, text): pages without recurring lines, joined and cleaned as one text, so that repeats across pages go as well."""
    stripped = pages.strip_headers_footers(page_table, threshold)
    parts = F.array_sort(F.collect_list(F.struct("page_idx", "text")))
    joined = stripped.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
    return pipeline.clean(joined, "text")


def processed(documents: DataFrame, sections: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Documents (doc_id, source, source_type, title, ocr_used, ocr_pages, language, original_size_bytes) with their cleaned sections and figures.

    Cleaning is a projection of the sections; they are grouped by document once, original and cleaned text together.
    """
    kept = sections.select("doc_id", "pos", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("content", F.lit("")).alias("original"), F.coalesce("continuation", F.lit(False)).alias("continuation"))
    cleaned = clean_sections(kept.withColumn("content", F.col("original")), pipeline)
    grouped = cleaned.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "header", "content", "continuation", "original"))).alias("all"))

    def text(field: str):
        return F.array_join(F.filter(F.transform("all", lambda x: x[field]), lambda t: t != ""), "\n\n")

    shaped = grouped.select(
        "doc_id",
        text("original").alias("original"),
        text("content").alias("cleaned"),
        F.transform("all", lambda x: F.struct(x["pos"].alias("pos"), x["header"].alias("header"), x["content"].alias("content"), x["continuation"].alias("continuation"), x["original"].alias("original"))).alias("sections"),
    )
    empty = F.array().cast("array<struct<pos:int,header:string,content:string,continuation:boolean,original:string>>")
    d = documents.join(shaped, "doc_id", "left").select(
        *documents.columns, F.coalesce("original", F.lit("")).alias("original"), F.coalesce("cleaned", F.lit("")).alias("cleaned"), F.coalesce("sections", empty).alias("sections")
    )
    return stats.with_statistics(d)


def recognised(found: DataFrame, options: Options, cache_folder: str | None = None) -> DataFrame:
    """(doc_id, page_idx, text, cache_hit) of the images of extracted documents; new texts are appended to the cache."""
    spark = found.sparkSession
    use = bool(cache_folder) and options.use_cache
    texts, _ = ocr.recognise(found.select("doc_id", F.inline("images")), options, ocr.read_cache(spark, cache_folder, options.cache_ttl_days) if use else None)
    texts = cut_lineage(texts.select("doc_id", "page_idx", "cache_key", "text", "cache_hit"))
    if use:
        ocr.keep_in_cache(texts.where("not cache_hit and text is not null").dropDuplicates(["cache_key"]), cache_folder)
    return texts.drop("cache_key")


def with_recognised(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Extracted documents with the recognised texts in their pages, or as section of an image, and how many were wanted and known."""
    by = texts.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("page_idx", "text"))).alias("__read"), F.count(F.lit(1)).alias("ocr_wanted"), F.count_if("cache_hit").alias("ocr_hits")
    )
    d = found.drop("images").join(by, "doc_id", "left")
    pages = F.transform("pages", lambda p: p.withField("ocr_text", F.col("__read")[p["page_idx"]]))
    image = F.col("__read")[F.lit(files.IMAGE_PAGE)]
    section = F.struct(F.lit(0).alias("pos"), F.lit(files.IMAGE_HEADER).alias("header"), image.alias("content"), F.lit(False).alias("continuation"))
    is_image = image.isNotNull()
    return (
        d.withColumn("pages", F.when(F.col("__read").isNotNull(), pages).otherwise(F.col("pages")))
        .withColumn("sections", F.when(is_image, F.array(section)).otherwise(F.col("sections")))
        .withColumn("ocr_used", is_image)
        .withColumn("ocr_pages", F.when(is_image, F.array(F.lit(1))).otherwise(F.col("ocr_pages")))
        .drop("__read")
    )


def sections_of(extracted: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, pos, header, content, continuation) of extracted documents; paged ones pass the page operators."""
    plain = extracted.select("doc_id", F.inline("sections"))
    paged = extracted.select("doc_id", F.inline("pages"))
    return plain.unionByName(pages.page_plan(paged, options).select("doc_id", "pos", "header", "content", "continuation"))


def process_files(
    spark: SparkSession, paths: str | list[str], options: Options = Options(), kind: str = "md", recursive: bool = False, extracted_at: str | None = None,
    pipeline: Pipeline | None = None, cache_folder: str | None = None,
) -> DataFrame:
    """Rendered documents of files: doc_id (hash of the path), figures, what was found on their pages, output, error_type and error.

    Files are read once: what was extracted is kept in the shared folder, as sections, pages and images go different ways.
    """
    found = cut_lineage(files.extract(files.read_files(spark, paths, recursive), options).withColumn("doc_id", F.xxhash64("path")))
    found = with_recognised(found, recognised(found, options, cache_folder))
    findings = pages.page_findings(found.select("doc_id", F.inline("pages")), options)
    documents = found.drop("sections", "pages", "path", "encoding").join(findings, "doc_id", "left")
    read = F.size(F.coalesce("read_pages", F.array().cast("array<int>"))) > 0
    documents = documents.withColumn("ocr_used", F.col("ocr_used") | read).withColumn("ocr_pages", F.when(read, F.col("read_pages")).otherwise(F.col("ocr_pages"))).drop("read_pages")
    documents = documents.withColumn("language", F.when(F.col("ocr_used"), F.lit(options.ocr_languages)).otherwise(F.col("language")))
    reason = pages.image_based_reason(options, ocr.BACKENDS[options.ocr_backend].is_available())
    documents = documents.withColumn("image_based_reason", F.when(F.col("image_based") & ~F.col("ocr_used"), F.lit(reason)))
    done = processed(documents, sections_of(found, options), pipeline or default_pipeline(options.aggressive, options.dedup_min_occurrences))
    at = F.lit(extracted_at) if extracted_at else render.now_text()
    return render.render(done, kind, at, options.max_chars)
