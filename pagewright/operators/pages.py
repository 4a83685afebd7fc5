"""Operators on pages (doc_id, page_idx, text): recurring lines, detectors, filters, continuation, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.options import Options

# Patterns and thresholds of the page detectors, in Java's syntax with Unix line ends.
PAGE_NUMBER = r"(?i)\A(?:page|p\.?)[" + T.BLANKS + r"]*\p{Nd}+(?:[" + T.BLANKS + r"]*[/-][" + T.BLANKS + r"]*\p{Nd}+)?\z"
TOC_LINE = r"(?md)^\s*\S.{1,120}?(?:\.{3,}|\s{4,}|\t+)\s*\d{1,4}\s*$"
TOC_TITLE = r"(?iu)\b(?:sommaire|table\s+des\s+mati[èe]res|table\s+of\s+contents|contents)\b"
BIBLIOGRAPHY_TITLE = (
    r"(?iu)\b(?:bibliographie|r[ée]f[ée]rences(?:\s+bibliographiques)?|references|works\s+cited|sources(?:\s+cit[ée]es)?|webographie)\b"
)
REFERENCES = (r"\[\d{1,4}\]", r"\([A-Z][a-zéèêA-Z]+(?:\s+(?:et\s+al\.?|&)\s*[A-Z]?[a-z]*)?,?\s+\d{4}\)", r"(?md)^\s*\d{1,3}\.\s+[A-Z]")
TOC_LINES, REFERENCE_COUNT, SPARSE_WORDS, OUTER_LINES = 5, 8, 30, 3
SENTENCE_END = r"[.!?:;»\")\]]\z"
LEADING_NUMBER = rf"\A[{T.BLANKS}]*\p{{Nd}}{{1,4}}[{T.BLANKS}]+"
GOES_ON = rf"\A[{T.BLANKS}]*[a-zàâäçéèêëîïôöùûüÿ,;\-)\]]"


def is_page_number(line: Column) -> Column:
    return T.strip(line).rlike(PAGE_NUMBER)


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, pos, raw, line (stripped)."""
    return pages.select("doc_id", "page_idx", F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).withColumn("line", T.strip(F.col("raw")))


def outer_lines(text: Column) -> Column:
    """The distinct first and last filled lines of a page as an array, cut inside the row: no window and no sort."""
    filled = F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")
    return F.array_union(F.slice(filled, 1, OUTER_LINES), F.slice(F.reverse(filled), 1, OUTER_LINES))


def recurring_lines(pages: DataFrame, threshold: float = 0.30) -> DataFrame:
    """(doc_id, line, n_pages) of outer lines on enough pages of a document with three pages or more; blank pages count as pages.

    Pages are counted along with the lines, as an empty line of each page, so that they are read once; only counts meet by document.
    """
    lines = pages.select("doc_id", F.explode(F.concat(F.array(F.lit("")), outer_lines(F.col("text")))).alias("line"))
    counted = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")
    total = F.max(F.when(F.col("line") == "", F.col("n_pages"))).over(Window.partitionBy("doc_id"))
    enough = F.greatest(F.lit(2), F.floor(F.col("total") * F.lit(threshold)))
    return counted.withColumn("total", total).where((F.col("line") != "") & (F.col("total") >= 3) & (F.col("n_pages") >= enough)).select("doc_id", "line", "n_pages")


def strip_headers_footers(pages: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Pages without recurring lines, anywhere on them, and without page-number lines; a page may come out empty.

    The recurring lines of a document come as one array, so pages are joined once by document and rebuilt in place.
    """
    known = recurring_lines(pages, threshold).groupBy("doc_id").agg(F.collect_set("line").alias("__recurring"))
    joined = pages.join(known, "doc_id", "left")
    none = F.coalesce("__recurring", F.array().cast("array<string>"))
    kept = F.filter(T.lines(F.col("text")), lambda x: ~F.array_contains(none, T.strip(x)) & ~is_page_number(x))
    return joined.withColumn("text", F.array_join(kept, "\n")).drop("__recurring").select(*pages.columns)


def is_toc(t: Column) -> Column:
    return t.rlike(TOC_TITLE) | (F.regexp_count(t, F.lit(TOC_LINE)) >= TOC_LINES)


def is_bibliography(t: Column) -> Column:
    found = F.regexp_count(t, F.lit(REFERENCES[0]))
    for r in REFERENCES[1:]:
        found = found + F.regexp_count(t, F.lit(r))
    return t.rlike(BIBLIOGRAPHY_TITLE) | (found >= REFERENCE_COUNT)


def classify_pages(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds word_count, is_toc, is_bibliography, is_sparse, reasons and should_filter; a page is sparse only if it is neither of the others."""
    t = F.col("text")
    d = pages.withColumn("word_count", T.word_count(t))
    d = d.withColumn("is_toc", is_toc(t) if options.filter_toc else F.lit(False))
    d = d.withColumn("is_bibliography", is_bibliography(t) if options.filter_bibliography else F.lit(False))
    sparse = ~F.col("is_toc") & ~F.col("is_bibliography") & (F.col("word_count") < SPARSE_WORDS)
    d = d.withColumn("is_sparse", sparse if options.filter_sparse else F.lit(False))
    flags = ("toc", "bibliography", "sparse")
    reasons = F.filter(F.array(*[F.when(F.col(f"is_{f}"), F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    return d.withColumn("reasons", reasons).withColumn("should_filter", F.col("is_toc") | F.col("is_bibliography") | F.col("is_sparse"))


def filter_report(classified: DataFrame) -> DataFrame:
    """(doc_id, toc, bibliography, sparse, kept): numbers, from 1, of the pages left out by first category, and of those kept."""
    kind = F.when(F.col("is_toc"), "toc").when(F.col("is_bibliography"), "bibliography").when(F.col("is_sparse"), "sparse").otherwise("kept")
    number = F.col("page_idx") + 1
    return classified.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(kind == k, number))).alias(k) for k in ("toc", "bibliography", "sparse", "kept")])


def drop_empty(pages: DataFrame, least_words: int = 5) -> DataFrame:
    return pages.where(T.word_count(F.col("text")) >= least_words)


def ends_open(t: Column) -> Column:
    """Whether a text is filled and ends within a sentence."""
    return ~T.is_blank(t) & ~T.rstrip(t).rlike(SENTENCE_END)


def starts_within(t: Column) -> Column:
    """Whether a text is filled and, a leading number apart, starts within a sentence."""
    return ~T.is_blank(t) & F.regexp_replace(t, LEADING_NUMBER, "").rlike(GOES_ON)


def goes_on(before: Column, text: Column) -> Column:
    """Whether text carries on the sentence of the page before; null before gives false."""
    return F.coalesce(ends_open(before) & starts_within(text), F.lit(False))


def mark_continuations(pages: DataFrame) -> DataFrame:
    """Adds continuation, by the page kept before. Of each page only whether it ends open goes to the next row."""
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    told = pages.withColumn("__open", ends_open(F.col("text"))).withColumn("__within", starts_within(F.col("text")))
    return told.withColumn("continuation", F.coalesce(F.lag("__open").over(w) & F.col("__within"), F.lit(False))).drop("__open", "__within")


def image_based(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, page_count, total_native_chars, avg_chars_per_page, total_images, avg_images_per_page, image_based); pages need n_images."""
    d = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(T.n_chars(T.strip(F.col("text")))).alias("total_native_chars"), F.sum(F.col("n_images").cast("bigint")).alias("total_images")
    )
    chars, images = F.col("total_native_chars") / F.col("page_count"), F.col("total_images") / F.col("page_count")
    flag = (
        (F.col("page_count") >= options.pdf_image_based_min_pages)
        & (chars < options.pdf_image_based_max_chars_per_page)
        & (images >= options.pdf_image_based_min_images_per_page)
    )
    return d.select(
        "doc_id", "page_count", "total_native_chars", F.bround(chars, 1).alias("avg_chars_per_page"), "total_images", F.bround(images, 1).alias("avg_images_per_page"), flag.alias("image_based")
    )


def image_based_reason(options: Options, available: bool) -> str:
    """Why pages that are images came out without text."""
    return "recognition is switched off" if options.no_ocr else "the backend is not available" if not available else "recognition gave no text"


def needs_ocr(text: Column, options: Options = Options()) -> Column:
    if options.no_ocr:
        return F.lit(False)
    return F.lit(True) if options.force_ocr else F.length(T.strip(text)) < options.pdf_min_native_chars_per_page


def page_segmentation(page_idx: Column, options: Options = Options()) -> Column:
    """The first page is read as sparse text (11) whatever is set, the others as set."""
    return F.when(page_idx == 0, F.lit(11)).otherwise(F.lit(options.ocr_psm))


def coalesce_ocr(native: Column, ocr: Column, options: Options = Options()) -> tuple[Column, Column]:
    """(text, whether recognition gave it): recognised text where it was needed and isn't blank."""
    used = F.coalesce(needs_ocr(native, options) & ~T.is_blank(ocr), F.lit(False))
    return F.when(used, ocr).otherwise(native), used


def page_header(page_idx: Column, ocr_used: Column) -> Column:
    return F.concat(F.lit("Page "), (page_idx + 1).cast("string"), F.when(ocr_used, " (OCR)").otherwise(""))


def _ready(pages: DataFrame, options: Options) -> DataFrame:
    """Pages with recognised text, without recurring lines and without empty ones, in the order that later thresholds rely on."""
    text, used = coalesce_ocr(F.col("text"), F.col("ocr_text"), options)
    d = pages.select("doc_id", "page_idx", text.alias("text"), used.alias("ocr_used"))
    d = strip_headers_footers(d, options.header_footer_threshold)
    return drop_empty(d, options.empty_page_min_words) if options.drop_empty_pages else d


def page_plan(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Sections from pages (doc_id, page_idx, text, ocr_text, n_images): ready pages pass the detectors, then continuation is marked."""
    d = _ready(pages, options)
    if options.smart_filter:
        d = classify_pages(d, options).where("not should_filter").select("doc_id", "page_idx", "text", "ocr_used")
    d = mark_continuations(d) if options.merge_continuations else d.withColumn("continuation", F.lit(False))
    return d.select("doc_id", F.col("page_idx").alias("pos"), page_header(F.col("page_idx"), F.col("ocr_used")).alias("header"), F.col("text").alias("content"), "continuation", "ocr_used")


METRICS = ("page_count", "total_native_chars", "avg_chars_per_page", "total_images", "avg_images_per_page")


def page_findings(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, image_based, image_based_metrics, filtered_pages, read_pages) of paged documents: null where there is nothing to tell.

    filtered_pages are the numbers of the pages that the detectors left out, read_pages of those whose text was recognised.
    """
    _, used = coalesce_ocr(F.col("text"), F.col("ocr_text"), options)
    read = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(used, (F.col("page_idx") + 1).cast("int")))).alias("read_pages"))
    images = image_based(pages, options).select("doc_id", "image_based", F.when(F.col("image_based"), F.struct(*METRICS)).alias("image_based_metrics"))
    found = read.join(images, "doc_id")
    if not options.smart_filter:
        return found.withColumn("filtered_pages", F.lit(None).cast("struct<toc:array<int>,bibliography:array<int>,sparse:array<int>>"))
    kinds = ("toc", "bibliography", "sparse")
    report = filter_report(classify_pages(_ready(pages, options), options))
    some = F.size(F.concat(*kinds)) > 0
    return found.join(report.select("doc_id", F.when(some, F.struct(*[F.col(k).cast("array<int>").alias(k) for k in kinds])).alias("filtered_pages")), "doc_id", "left")
