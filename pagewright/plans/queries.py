"""Queries over the tables of a data folder, and the SQL that gives the same rows.

Pages are the sections of paged documents; dirty() adds to the flat corpus what the cleaning steps are there for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import ocr, pages, render, stats, steps, tabular
from pagewright.options import Options
from pagewright.plans import process, sql
from pagewright.sources import files
from pagewright.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
EXTRACTED_AT = "2025-01-01T00:00:00Z"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source and text of the filled documents, with noise by doc_id."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "source", "text")
    t, key = F.col("text"), F.col("doc_id")

    def put(d: DataFrame, k: int, r: int, changed: Column) -> DataFrame:
        return d.withColumn("text", F.when(key % k == r, changed).otherwise(t))

    gap = F.lit("\n\n")
    d = put(d, 2, 0, F.replace(t, F.lit("ti"), F.lit("t-\ni")))
    d = put(d, 3, 0, F.replace(t, F.lit(". "), F.lit(".  \t ")))
    d = put(d, 5, 0, F.replace(t, F.lit("\n"), F.lit("\n\n\n\n")))
    d = d.withColumn("text", F.when(key % 4 == 0, F.concat(t, gap, t, gap, t)).when(key % 4 == 1, F.concat(t, gap, t)).otherwise(t))
    d = put(d, 2, 1, F.concat(t, F.lit("\n---\n\n???\n!!\n| --- | --- |\n")))
    d = put(d, 7, 0, F.replace(t, F.lit("\n"), F.lit("\r\n")))
    return put(d, 3, 1, F.replace(F.replace(t, F.lit("e "), F.lit("e​ ")), F.lit("fi"), F.lit("ﬁ")))


def page_table(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page_idx and text of paged documents, each page once."""
    s = table(spark, folder, "sections").where("header like 'Page %'")
    return s.groupBy("doc_id", F.col("pos").alias("page_idx")).agg(F.max(F.coalesce("content", F.lit(""))).alias("text"))


@query("SELECT source, count(*) AS docs, count(text) AS filled, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def scan_documents_profile(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count("text").alias("filled"), F.sum(T.n_chars(F.col("text"))).alias("chars"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    )


def _step(name: str, step: Callable[[Column], Column], expression: Callable[[str], str]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return dirty(spark, folder).select("doc_id", step(F.col("text")).alias("text"))

    run.__name__ = name
    query(f"WITH {sql.DIRTY} SELECT doc_id, {expression('text')} AS text FROM dirty")(run)


_step("normalize_nfkc", steps.normalize_unicode, sql.normalize)
_step("strip_invisibles", steps.strip_invisibles, sql.invisible)
_step("convert_ligatures", steps.convert_ligatures, sql.ligatures)
_step("rejoin_hyphenated", steps.rejoin_hyphenated, sql.hyphens)
_step("collapse_whitespace", steps.collapse_whitespace, sql.whitespace)
_step("limit_newlines", steps.limit_newlines, sql.newlines)
_step("dedup_paragraphs", steps.dedup_paragraphs, sql.dedup)
_step("dedup_paragraphs_aggressive", lambda t: steps.dedup_paragraphs(t, 2), lambda x: sql.dedup(x, 2))
_step("strip_punctuation_lines", steps.strip_punctuation_lines, sql.punctuation)
_step("finalize", steps.finalize, sql.finalize)


@query(f"WITH {sql.DIRTY}, {sql.chain('dirty', 'doc_id')} SELECT doc_id, c10 AS text, length(c0)::BIGINT AS chars_in, length(c10)::BIGINT AS chars_out, {sql.tokens('c10')} AS tokens FROM s10")
def clean_text_full(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty(spark, folder).select("doc_id", F.col("text").alias("original"))
    done = steps.default_pipeline().clean(d, "original", "text")
    return done.select("doc_id", "text", T.n_chars(F.col("original")).alias("chars_in"), T.n_chars(F.col("text")).alias("chars_out"), stats.estimate_tokens(F.col("text")).alias("tokens"))


_METRICS = f"WITH {sql.DIRTY}, {sql.chain('(SELECT * FROM dirty WHERE NOT (' + sql.blank('text') + '))', 'doc_id')}, m AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i}::INTEGER AS step_no, '{name}' AS name, length(c{i - 1})::BIGINT AS chars_in, length(c{i})::BIGINT AS chars_out FROM s10" for i, (name, _) in enumerate(sql.STEPS, 1)
) + ")"


@query(_METRICS + " SELECT * FROM m")
def step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return steps.default_pipeline().metrics(dirty(spark, folder), ["doc_id"])


@query(
    _METRICS
    + " SELECT min(step_no) AS first_step, name, sum(chars_in)::BIGINT AS chars_in, sum(chars_out)::BIGINT AS chars_out, (sum(chars_in) - sum(chars_out))::BIGINT AS chars_removed, "
    + sql.percent("sum(chars_out)", "sum(chars_in)")
    + " AS reduction_percent FROM m GROUP BY name"
)
def step_metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return steps.rollup(step_metrics(spark, folder))


@query(
    _METRICS
    + ", g AS (SELECT min(step_no) AS first_step, name, (sum(chars_in) - sum(chars_out))::BIGINT AS chars_removed FROM m GROUP BY name)"
    " SELECT first_step, name, chars_removed, round_even(chars_removed::DOUBLE / (SELECT sum(chars_removed) FROM g) * 100, 1) AS share_percent FROM g"
)
def step_shares(spark: SparkSession, folder: str) -> DataFrame:
    return steps.shares(step_metrics_rollup(spark, folder)).select("first_step", "name", "chars_removed", "share_percent")


_ONE = f"(SELECT doc_id, pos, CASE WHEN {sql.blank('content')} THEN '' ELSE content END AS content FROM one WHERE content IS NOT NULL)"


@query(f"WITH one AS (SELECT doc_id, pos, max(content) AS content FROM sections GROUP BY 1, 2), {sql.chain(_ONE, 'doc_id, pos', 'content')} SELECT doc_id, pos, c10 AS content FROM s10")
def clean_sections(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "sections").where("content is not null").groupBy("doc_id", "pos").agg(F.max("content").alias("content"))
    return process.clean_sections(one, steps.default_pipeline())


@query(
    f"WITH {sql.STRIPPED}, joined AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_idx) AS text FROM stripped GROUP BY 1), {sql.chain('joined', 'doc_id')}"
    " SELECT doc_id, c10 AS text FROM s10"
)
def clean_pages_full(spark: SparkSession, folder: str) -> DataFrame:
    return process.clean_pages(page_table(spark, folder), steps.default_pipeline())


@query(f"WITH {sql.RECURRING} SELECT doc_id, line, n_pages::BIGINT AS n_pages FROM rec")
def recurring_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pages.recurring_lines(page_table(spark, folder))


@query(f"WITH {sql.STRIPPED} SELECT doc_id, page_idx, text FROM stripped")
def strip_headers_footers(spark: SparkSession, folder: str) -> DataFrame:
    return pages.strip_headers_footers(page_table(spark, folder))


@query(f"WITH {sql.STRIPPED}, sizes2 AS (SELECT doc_id FROM pages GROUP BY 1 HAVING count(*) < 3) SELECT doc_id, page_idx, text FROM stripped SEMI JOIN sizes2 USING (doc_id)")
def strip_page_numbers_short_docs(spark: SparkSession, folder: str) -> DataFrame:
    p = page_table(spark, folder)
    short = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n < 3").select("doc_id")
    return pages.strip_headers_footers(p.join(short, "doc_id", "left_semi"))


@query(f"WITH {sql.PAGES} SELECT doc_id, count(*)::BIGINT AS n_pages, count(*) FILTER (WHERE {sql.word_count('text')} >= 5)::BIGINT AS kept FROM pages GROUP BY 1")
def drop_empty_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = page_table(spark, folder)
    kept = pages.drop_empty(p).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).join(kept, "doc_id", "left").select("doc_id", "n_pages", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"))


@query(f"WITH {sql.PAGES}, {sql.classified('pages')} SELECT doc_id, page_idx FROM cls WHERE is_toc")
def detect_toc(spark: SparkSession, folder: str) -> DataFrame:
    return page_table(spark, folder).where(pages.is_toc(F.col("text"))).select("doc_id", "page_idx")


@query(f"WITH {sql.PAGES}, {sql.classified('pages')} SELECT doc_id, page_idx FROM cls WHERE is_bibliography")
def detect_bibliography(spark: SparkSession, folder: str) -> DataFrame:
    return page_table(spark, folder).where(pages.is_bibliography(F.col("text"))).select("doc_id", "page_idx")


@query(
    f"WITH {sql.PAGES}, {sql.classified('pages')} SELECT doc_id, page_idx, word_count, is_toc, is_bibliography, is_sparse, array_to_string(list_filter([CASE WHEN is_toc THEN 'toc' END,"
    " CASE WHEN is_bibliography THEN 'bibliography' END, CASE WHEN is_sparse THEN 'sparse' END], lambda x: x IS NOT NULL), '+') AS reasons FROM cls"
)
def classify_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.classify_pages(page_table(spark, folder)).select("doc_id", "page_idx", "word_count", "is_toc", "is_bibliography", "is_sparse", F.array_join("reasons", "+").alias("reasons"))


@query(
    f"WITH {sql.PAGES}, {sql.classified('pages')}, k AS (SELECT *, CASE WHEN is_toc THEN 'toc' WHEN is_bibliography THEN 'bibliography' WHEN is_sparse THEN 'sparse' ELSE 'kept' END AS kind FROM cls) SELECT doc_id, "
    + ", ".join(f"coalesce(string_agg((page_idx + 1)::VARCHAR, ',' ORDER BY page_idx) FILTER (WHERE kind = '{k}'), '') AS {k}" for k in ("toc", "bibliography", "sparse", "kept"))
    + " FROM k GROUP BY doc_id"
)
def filter_pages_report(spark: SparkSession, folder: str) -> DataFrame:
    r = pages.filter_report(pages.classify_pages(page_table(spark, folder)))
    return r.select("doc_id", *[F.array_join(F.col(k).cast("array<string>"), ",").alias(k) for k in ("toc", "bibliography", "sparse", "kept")])


@query(
    f"WITH {sql.PAGES}, l AS (SELECT doc_id, page_idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY page_idx) AS before FROM pages WHERE {sql.word_count('text')} >= 5)"
    f" SELECT doc_id, page_idx, {sql.goes_on('before', 'text')} AS continuation FROM l"
)
def mark_continuations(spark: SparkSession, folder: str) -> DataFrame:
    return pages.mark_continuations(pages.drop_empty(page_table(spark, folder))).select("doc_id", "page_idx", "continuation")


@query(
    f"WITH {sql.PAGES}, g AS (SELECT doc_id, count(*) AS page_count, sum(length({sql.strip('text')}))::BIGINT AS total_native_chars, sum(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE page_idx % 2 END)::BIGINT AS total_images"
    " FROM (SELECT doc_id, page_idx, CASE WHEN doc_id % 3 = 0 THEN left(text, 60) ELSE text END AS text FROM pages) GROUP BY 1) SELECT doc_id, page_count::BIGINT AS page_count, total_native_chars,"
    " round_even(total_native_chars::DOUBLE / page_count, 1) AS avg_chars_per_page, total_images, round_even(total_images::DOUBLE / page_count, 1) AS avg_images_per_page,"
    " page_count >= 3 AND total_native_chars::DOUBLE / page_count < 100 AND total_images::DOUBLE / page_count >= 2 AS image_based FROM g"
)
def image_based_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every third document stands for a scanned one: short native text and four images a page."""
    scanned = F.col("doc_id") % 3 == 0
    p = page_table(spark, folder).select(
        "doc_id", "page_idx", F.when(scanned, F.left("text", F.lit(60))).otherwise(F.col("text")).alias("text"), F.when(scanned, 4).otherwise(F.col("page_idx") % 2).alias("n_images")
    )
    return pages.image_based(p)


_NATIVE = f"native AS (SELECT doc_id, page_idx, text AS ocr_text, CASE WHEN page_idx % 3 = 0 THEN left(text, 40) ELSE text END AS text FROM pages)"


def native_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose native text is short on every third one, as a scan's would be; the whole text stands for what recognition reads."""
    p = page_table(spark, folder).withColumn("ocr_text", F.col("text"))
    return p.withColumn("text", F.when(F.col("page_idx") % 3 == 0, F.left("text", F.lit(40))).otherwise(F.col("text")))


@query(f"WITH {sql.PAGES}, {_NATIVE} SELECT doc_id, page_idx, length({sql.strip('text')}) < 50 AS needs_ocr, CASE WHEN page_idx = 0 THEN 11 ELSE 6 END::INTEGER AS psm FROM native")
def ocr_page_selection(spark: SparkSession, folder: str) -> DataFrame:
    return native_pages(spark, folder).select("doc_id", "page_idx", pages.needs_ocr(F.col("text")).alias("needs_ocr"), pages.page_segmentation(F.col("page_idx")).alias("psm"))


@query(
    f"WITH {sql.PAGES}, {_NATIVE}, u AS (SELECT doc_id, page_idx, text, ocr_text, length({sql.strip('text')}) < 50 AND NOT ({sql.blank('ocr_text')}) AS used FROM native)"
    " SELECT doc_id, page_idx, CASE WHEN used THEN ocr_text ELSE text END AS text, used, 'Page ' || (page_idx + 1)::VARCHAR || CASE WHEN used THEN ' (OCR)' ELSE '' END AS header FROM u"
)
def ocr_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    text, used = pages.coalesce_ocr(F.col("text"), F.col("ocr_text"))
    d = native_pages(spark, folder).select("doc_id", "page_idx", text.alias("text"), used.alias("used"))
    return d.select("*", pages.page_header(F.col("page_idx"), F.col("used")).alias("header"))


_KEYED = f"k AS (SELECT doc_id, page_idx, sha256(text || '|lang=tesseract:fra+eng|psm=' || CASE WHEN page_idx = 0 THEN '11' ELSE '6' END) AS cache_key FROM pages)"


@query(f"WITH {sql.PAGES}, {_KEYED}, c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id % 2 = 0) SELECT doc_id, page_idx, cache_key, cache_key IN (SELECT cache_key FROM c) AS hit FROM k")
def ocr_cache_split(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stand for images; the results of every other document are known already."""
    p = page_table(spark, folder)
    key = ocr.cache_key_column(F.col("text"), F.lit("tesseract:fra+eng"), pages.page_segmentation(F.col("page_idx")))
    images = p.select("doc_id", "page_idx", key.alias("cache_key"))
    cache = images.where("doc_id % 2 = 0").select("cache_key", F.lit("known").alias("text"))
    hits, pending = ocr.split_by_cache(images, cache)
    return hits.select("doc_id", "page_idx", "cache_key", F.lit(True).alias("hit")).unionByName(pending.select("doc_id", "page_idx", "cache_key", F.lit(False).alias("hit")))


_FIGURES = (
    f"WITH {sql.DIRTY}, {sql.chain('dirty', 'doc_id, source')}, f AS (SELECT doc_id, source, (strlen(c0) * 2)::BIGINT AS original_size_bytes, strlen(c10)::BIGINT AS cleaned_size_bytes, length(c0)::BIGINT AS original_chars,"
    f" length(c10)::BIGINT AS cleaned_chars, {sql.tokens('c10')} AS tokens_estimated, {sql.tokens('c0')} AS tokens_original_estimated, (strlen(c0) * 2 // 4)::BIGINT AS tokens_input_estimated FROM s10)"
)


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """A file of twice its text's bytes stands behind each document."""
    d = dirty(spark, folder).withColumnRenamed("text", "original")
    done = steps.default_pipeline().clean(d, "original", "cleaned").withColumn("original_size_bytes", (F.octet_length("original") * 2).cast("bigint"))
    return stats.with_statistics(done).drop("original", "cleaned")


@query(
    _FIGURES
    + f" SELECT *, {sql.percent('cleaned_size_bytes', 'original_size_bytes')} AS reduction_percent, {sql.percent('tokens_estimated', 'tokens_original_estimated')} AS tokens_reduction_percent,"
    f" {sql.percent('tokens_estimated', 'tokens_input_estimated')} AS tokens_input_reduction_percent FROM f"
)
def reduction_stats(spark: SparkSession, folder: str) -> DataFrame:
    return figures(spark, folder)


_SAVED = (
    ("size", "original_size_bytes", "cleaned_size_bytes", sql.size_text), ("characters", "original_chars", "cleaned_chars", sql.count_text),
    ("tokens of the file", "tokens_input_estimated", "tokens_estimated", sql.count_text), ("tokens of the text", "tokens_original_estimated", "tokens_estimated", sql.count_text),
)


@query(_FIGURES + " " + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, {shown(b)} AS before, {shown(a)} AS after, {sql.percent(a, b)} AS gain FROM f" for m, b, a, shown in _SAVED))
def savings_table(spark: SparkSession, folder: str) -> DataFrame:
    return stats.savings(figures(spark, folder))


@query(
    _FIGURES
    + ", r AS (SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 11 <> 0) AS successes, count(*) FILTER (WHERE doc_id % 11 = 0) AS failures, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN doc_id % 11 <> 0 THEN {c} ELSE 0 END), 0)::BIGINT AS {a}"
        for c, a in (("original_size_bytes", "bytes_before"), ("cleaned_size_bytes", "bytes_after"), ("tokens_input_estimated", "tokens_before"), ("tokens_estimated", "tokens_after"))
    )
    + f" FROM f) SELECT *, {sql.percent('bytes_after', 'bytes_before', 1)} AS size_gain, {sql.percent('tokens_after', 'tokens_before', 1)} AS token_gain FROM r"
)
def batch_recap(spark: SparkSession, folder: str) -> DataFrame:
    """Every eleventh file failed."""
    return stats.recap(figures(spark, folder).withColumn("error", F.when(F.col("doc_id") % 11 == 0, "failed")))


@query(f"SELECT doc_id, {sql.tokens('text')} AS tokens, {sql.word_count('text')} AS words FROM documents WHERE text IS NOT NULL")
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", stats.estimate_tokens(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


@query(
    f"WITH n AS (SELECT doc_id, (n_chars * n_chars * n_chars)::BIGINT AS n FROM documents) SELECT doc_id, {sql.size_text('n')} AS size, {sql.size_text('n', ('o', 'Ko', 'Mo', 'Go', 'To'))} AS taille,"
    " replace(format('{:,}', n), ',', ' ') AS count FROM n"
)
def format_sizes(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n")
    d = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("n"))
    return d.select("doc_id", T.size_text(n).alias("size"), T.size_text(n, ("o", "Ko", "Mo", "Go", "To")).alias("taille"), T.count_text(n).alias("count"))


def _cells_table(d: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """A table for each group, with the names of the columns as its head."""
    body = d.select(F.col(group).cast("bigint").alias("doc_id"), F.col(order).cast("bigint").alias("row_idx"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
    head = body.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("bigint").alias("row_idx"), F.array(*[F.lit(c) for c in columns]).alias("cells"))
    return tabular.markdown_tables(head.unionByName(body))


@query(
    "SELECT n_regionkey::BIGINT AS doc_id, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content"
    " FROM nation GROUP BY n_regionkey"
)
def markdown_table_nation(spark: SparkSession, folder: str) -> DataFrame:
    return _cells_table(table(spark, folder, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query(
    "SELECT c_nationkey::BIGINT AS doc_id, '| c_custkey | c_name | c_mktsegment |' || chr(10) || '| --- | --- | --- |' || chr(10)"
    " || string_agg('| ' || c_custkey || ' | ' || replace(c_name, '#', '|').replace('|', '\\|') || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey"
)
def markdown_table_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Names have a pipe in place of their number sign, to be escaped."""
    d = table(spark, folder, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("|")))
    return _cells_table(d, "c_nationkey", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


def documents_with_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted documents, once each, through cleaning to figures and ordered sections."""
    docs = table(spark, folder, "documents_out")
    documents = docs.groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in ("source", "source_type", "title", "ocr_used", "ocr_pages", "language")], (F.max("n_sections").cast("bigint") * 3000).alias("original_size_bytes")
    )
    one = table(spark, folder, "sections").groupBy("doc_id", "pos").agg(*[F.max(c).alias(c) for c in ("header", "content", "continuation")])
    return process.processed(documents, one, steps.default_pipeline().without("dedup_paragraphs"))


_SHORT = tuple(x for x in sql.STEPS if x[0] != "dedup_paragraphs")
_DOCS = (
    "WITH docs AS (SELECT doc_id, max(source) AS source, max(source_type) AS source_type, max(title) AS title, bool_or(ocr_used) AS ocr_used, max(ocr_pages) AS ocr_pages, max(language) AS language,"
    " (max(n_sections) * 3000)::BIGINT AS original_size_bytes FROM documents_out GROUP BY 1), one AS (SELECT doc_id, pos, coalesce(max(header), '') AS header, max(content) AS content, bool_or(continuation) AS continuation FROM sections GROUP BY 1, 2), "
    + sql.chain("(SELECT doc_id, pos, header, continuation, coalesce(content, '') AS original, CASE WHEN content IS NULL OR " + sql.blank("content") + " THEN '' ELSE content END AS content FROM one)", "doc_id, pos, header, continuation, original", "content", _SHORT)
    + f", cl AS (SELECT doc_id, pos, header, continuation, original, c{len(_SHORT)} AS content FROM s{len(_SHORT)})"
)
_BY_DOC = _DOCS + (
    ", agg AS (SELECT doc_id, coalesce(string_agg(original, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE original <> ''), '') AS original, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE content <> ''), '') AS cleaned,"
    " list(header ORDER BY pos) AS headers, list(content ORDER BY pos) AS contents, list(continuation ORDER BY pos) AS goes FROM cl GROUP BY 1),"
    " j AS (SELECT d.*, coalesce(a.original, '') AS original, coalesce(a.cleaned, '') AS cleaned, coalesce(a.headers, []) AS headers, coalesce(a.contents, []) AS contents, coalesce(a.goes, []) AS goes FROM docs d LEFT JOIN agg a USING (doc_id))"
)


@query(
    _BY_DOC
    + " SELECT doc_id, array_to_string(list_concat(CASE WHEN coalesce(title, '') <> '' THEN [title] ELSE [] END, list_filter(flatten(list_transform(range(1, len(headers) + 1), lambda i: [headers[i], contents[i]])), lambda p: p <> '')), chr(10) || chr(10)) || chr(10) AS output FROM j"
)
def render_txt(spark: SparkSession, folder: str) -> DataFrame:
    return render.render(documents_with_sections(spark, folder), "txt", F.lit(EXTRACTED_AT)).select("doc_id", "output")


@query(
    _BY_DOC
    + f", m AS (SELECT doc_id, array_to_string(list_concat(CASE WHEN coalesce(title, '') <> '' THEN ['# ' || title] ELSE [] END, list_filter(flatten(list_transform(range(1, len(headers) + 1), lambda i: [CASE WHEN headers[i] <> '' AND NOT goes[i] THEN '## ' || headers[i] ELSE '' END, {sql.strip('contents[i]')}])), lambda p: p <> '')), chr(10) || chr(10)) AS body FROM j)"
    " SELECT doc_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS body FROM m"
)
def render_markdown_body(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered document after its front matter."""
    d = render.render(documents_with_sections(spark, folder), "md", F.lit(EXTRACTED_AT))
    return d.select("doc_id", F.regexp_replace("output", r"(?s)\A---\n.*?\n---\n\n?", "").alias("body"))


_BODY = f"array_to_string(list_concat(CASE WHEN coalesce(title, '') <> '' THEN ['# ' || title] ELSE [] END, list_filter(flatten(list_transform(range(1, len(headers) + 1), lambda i: [CASE WHEN headers[i] <> '' AND NOT goes[i] THEN '## ' || headers[i] ELSE '' END, {sql.strip('contents[i]')}])), lambda p: p <> '')), chr(10) || chr(10))"
_NUMBERS = (
    f"n AS (SELECT *, strlen(cleaned)::BIGINT AS cleaned_size_bytes, length(original)::BIGINT AS original_chars, length(cleaned)::BIGINT AS cleaned_chars, {sql.tokens('cleaned')} AS tokens_estimated,"
    f" {sql.tokens('original')} AS tokens_original_estimated, (original_size_bytes // 4)::BIGINT AS tokens_input_estimated, {_BODY} AS body FROM j), q AS (SELECT *, {sql.percent('cleaned_size_bytes', 'original_size_bytes')} AS reduction_percent,"
    f" {sql.percent('tokens_estimated', 'tokens_original_estimated')} AS tokens_reduction_percent, {sql.percent('tokens_estimated', 'tokens_input_estimated')} AS tokens_input_reduction_percent FROM n)"
)
_LANGUAGE = "coalesce(language, '')"
_HEAD = " || chr(10) || ".join(
    [
        "'---'", f"'source: ' || {sql.yaml_text('source')}", f"'type: ' || {sql.yaml_text('source_type')}", f"'extracted_at: ' || chr(39) || '{EXTRACTED_AT}' || chr(39)", "'ocr_used: ' || ocr_used",
        "'ocr_pages:' || CASE WHEN len(ocr_pages) > 0 THEN chr(10) || '- ' || array_to_string(ocr_pages, chr(10) || '- ') ELSE ' []' END", f"'language: ' || {sql.yaml_text(_LANGUAGE)}", "'stats:'",
        *(f"'  {f}: ' || {f}" for f in render.FIGURES), "'---' || chr(10)",
    ]
)


@query(_BY_DOC + f", {_NUMBERS} SELECT doc_id, {_HEAD} || CASE WHEN body = '' THEN '' ELSE chr(10) || body || chr(10) END AS output FROM q")
def render_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return render.render(documents_with_sections(spark, folder), "md", F.lit(EXTRACTED_AT)).select("doc_id", "output")


@query(
    _BY_DOC
    + f" SELECT doc_id, source, title, len(headers)::INTEGER AS n_sections, {sql.tokens('cleaned')} AS tokens, array_to_string(headers, '|') AS headers, array_to_string(contents, '|') AS contents FROM j"
)
def render_json(spark: SparkSession, folder: str) -> DataFrame:
    """Fields read back from the JSON output."""
    d = render.render(documents_with_sections(spark, folder), "json", F.lit(EXTRACTED_AT))
    schema = "source string, title string, sections array<struct<header:string,content:string>>, stats struct<tokens_estimated:bigint>"
    d = d.select("doc_id", F.from_json("output", schema).alias("o"))
    return d.select("doc_id", "o.source", "o.title", F.size("o.sections").alias("n_sections"), F.col("o.stats.tokens_estimated").alias("tokens"), F.array_join("o.sections.header", "|").alias("headers"), F.array_join("o.sections.content", "|").alias("contents"))


@query(
    _BY_DOC + " SELECT doc_id, left(array_to_string(list_concat(CASE WHEN coalesce(title, '') <> '' THEN [title] ELSE [] END, list_filter(flatten(list_transform(range(1, len(headers) + 1), lambda i: [headers[i], contents[i]])), lambda p: p <> '')), chr(10) || chr(10)) || chr(10), 500) AS output FROM j"
)
def render_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """The option to cut the output after so many characters."""
    return render.render(documents_with_sections(spark, folder), "txt", F.lit(EXTRACTED_AT), 500).select("doc_id", "output")


_KIND = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{k}'" for e, k in files.KINDS.items()) + " END"


@query(
    "WITH p AS (SELECT doc_id, max(source) AS source FROM documents_out GROUP BY 1), q AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) WHEN doc_id % 7 = 0 THEN source || '.xyz' ELSE source END AS path FROM p),"
    " e AS (SELECT doc_id, path, lower(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS ext FROM q)"
    f" SELECT doc_id, path, {_KIND} AS kind, regexp_extract(path, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) || '.' || doc_id || '.clean.md' AS output FROM e"
)
def extension_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the extracted documents, some in capitals and some with an unknown extension."""
    d = table(spark, folder, "documents_out").groupBy("doc_id").agg(F.max("source").alias("path"))
    d = d.withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.upper("path")).when(F.col("doc_id") % 7 == 0, F.concat("path", F.lit(".xyz"))).otherwise(F.col("path")))
    return d.select("doc_id", "path", files.kind_of(F.col("path")).alias("kind"), render.output_name(F.col("path"), F.col("doc_id"), "md").alias("output"))


@query(
    "SELECT event_type, (ts::DATE)::VARCHAR AS day, count(*)::BIGINT AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS k_total, max(props->>'$.k') AS k_last FROM events GROUP BY 1, 2"
)
def event_log_rollup(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), F.get_json_object("props", "$.k").alias("k"))
    return d.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("k").cast("bigint")).alias("k_total"), F.max("k").alias("k_last"))


@query()
def html_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with HTML through the file reader."""
    d = table(spark, folder, "sections").where(F.col("content").rlike(r"(?i)<(?:[a-z][a-z0-9]*\b[^<>]*|/[a-z][a-z0-9]*\s*)>"))
    d = d.select("doc_id", "pos", "content").distinct()
    named = d.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.concat(F.col("pos").cast("string"), F.lit(".html"))).alias("path"), F.col("content").cast("binary").alias("content"))
    got = files.extract(named)
    parts = F.split("path", r"[/.]")
    return got.select(parts[0].cast("bigint").alias("doc_id"), parts[1].cast("int").alias("pos"), F.col("sections")[0]["content"].alias("content"))


_PLANNED = (
    f"WITH {sql.PAGES.replace('pages AS', 'whole AS', 1)}, {_NATIVE.replace('FROM pages', 'FROM whole')}, u AS (SELECT doc_id, page_idx, length({sql.strip('text')}) < 50 AND NOT ({sql.blank('ocr_text')}) AS used, text, ocr_text FROM native),"
    f" pages AS (SELECT doc_id, page_idx, CASE WHEN used THEN ocr_text ELSE text END AS text FROM u), {sql.STRIPPED.removeprefix(sql.PAGES + ', ')}, full_pages AS (SELECT * FROM stripped WHERE {sql.word_count('text')} >= 5),"
    f" {sql.classified('full_pages')}, k AS (SELECT doc_id, page_idx, text FROM cls WHERE NOT is_toc AND NOT is_bibliography AND NOT is_sparse),"
    " l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY page_idx) AS before FROM k)"
)


@query(
    _PLANNED + f" SELECT doc_id, page_idx AS pos, 'Page ' || (page_idx + 1) || CASE WHEN used THEN ' (OCR)' ELSE '' END AS header, l.text AS content, {sql.goes_on('before', 'l.text')} AS continuation FROM l JOIN u USING (doc_id, page_idx)"
)
def smart_page_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The page operators in their order, with all detectors."""
    p = native_pages(spark, folder).withColumn("n_images", F.lit(0))
    return pages.page_plan(p, Options(smart_filter=True)).select("doc_id", "pos", "header", "content", "continuation")


@query(
    _PLANNED
    + ", f AS (SELECT doc_id, "
    + ", ".join(f"coalesce(string_agg((page_idx + 1)::VARCHAR, ',' ORDER BY page_idx) FILTER (WHERE {w}), '') AS {k}" for k, w in (("toc", "is_toc"), ("bibliography", "is_bibliography AND NOT is_toc"), ("sparse", "is_sparse")))
    + f" FROM cls GROUP BY 1), g AS (SELECT doc_id, count(*) AS n, sum(length({sql.strip('text')})) AS chars, string_agg((page_idx + 1)::VARCHAR, ',' ORDER BY page_idx) FILTER (WHERE used) AS read_pages FROM u GROUP BY 1)"
    " SELECT doc_id, n >= 3 AND chars::DOUBLE / n < 100 AS image_based, CASE WHEN n >= 3 AND chars::DOUBLE / n < 100 THEN round_even(chars::DOUBLE / n, 1) END AS avg_chars, coalesce(read_pages, '') AS read_pages,"
    " nullif(coalesce(toc, '') || ';' || coalesce(bibliography, '') || ';' || coalesce(sparse, ''), ';;') AS filtered FROM g LEFT JOIN f USING (doc_id)"
)
def page_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What a document's pages tell its front matter, with two images on each page."""
    d = pages.page_findings(native_pages(spark, folder).withColumn("n_images", F.lit(2)), Options(smart_filter=True))
    kinds = [F.array_join(F.col("filtered_pages")[k].cast("array<string>"), ",") for k in ("toc", "bibliography", "sparse")]
    filtered = F.when(F.col("filtered_pages").isNotNull(), F.concat_ws(";", *kinds))
    return d.select("doc_id", "image_based", F.col("image_based_metrics")["avg_chars_per_page"].alias("avg_chars"), F.array_join(F.col("read_pages").cast("array<string>"), ",").alias("read_pages"), filtered.alias("filtered"))


from pagewright.plans import source_queries  # noqa: E402, F401  registers its queries
