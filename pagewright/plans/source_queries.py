"""Queries that send files made of table rows through the readers, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import events
from pagewright.operators import ocr, stats
from pagewright.options import Options
from pagewright.plans import queries, samples, sql
from pagewright.plans.queries import query
from pagewright.sources import files
from pagewright.tables import table

LF = "chr(10)"


def _named(df: DataFrame, path, content) -> DataFrame:
    return df.select(path.alias("path"), content.alias("content"))


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """name and nations (struct of number and name, in order) of each region."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    listed = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return listed.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), "nations")


_REGIONS = "r AS (SELECT r_name AS region, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _first(df: DataFrame, *columns) -> DataFrame:
    return df.select("source", "source_type", *columns, F.col("sections")[0]["header"].alias("header"), F.col("sections")[0]["content"].alias("content"), F.size("sections").alias("n_sections"))


@query(
    "SELECT n_regionkey || '.csv' AS path, 'Feuille : ' || n_regionkey AS header, regexp_replace(string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey || ',\"' || n_name),"
    " '^([^\\n]*)', '\\1' || chr(10) || '| --- | --- |') AS content, 'utf-8' AS encoding, NULL::VARCHAR AS error FROM nation GROUP BY n_regionkey"
)
def csv_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as files of comma-separated values, by region, through the file reader."""
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"'))))).alias("rows"))
    named = rows.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.array_join("rows", "\n").cast("binary").alias("content"))
    return files.extract(named).select("path", F.col("sections")[0]["header"].alias("header"), F.col("sections")[0]["content"].alias("content"), "encoding", "error")


@query(
    "SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'markdown' END AS source_type, text AS content,"
    " CASE WHEN doc_id % 3 = 1 THEN 'utf-8-sig' WHEN doc_id % 3 = 2 THEN 'utf-16' ELSE 'utf-8' END AS encoding, CASE WHEN doc_id % 3 = 1 THEN strlen(text) + 3"
    " WHEN doc_id % 3 = 2 THEN 2 + 2 * (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]'))) ELSE strlen(text) END::BIGINT AS original_size_bytes FROM documents WHERE text IS NOT NULL"
)
def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text and Markdown files in three encodings, the marks of which are recognised."""
    d, t, key = table(spark, folder, "documents").where("text is not null"), F.col("text"), F.col("doc_id")
    data = F.when(key % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(key % 3 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).otherwise(F.encode(t, "UTF-8"))
    named = _named(d, F.concat(key.cast("string"), F.when(key % 2 == 0, ".txt").otherwise(".md")), data)
    return files.extract(named).select("source", "source_type", F.col("sections")[0]["content"].alias("content"), "encoding", "original_size_bytes")


@query(
    "SELECT s_suppkey || '.html' AS source, 'html' AS source_type, 'Supplier ' || s_suppkey AS title, '' AS header, '# ' || s_name || chr(10) || chr(10) || 'In **' || n_name || '** & [region](/' || n_regionkey || ')' || chr(10) || chr(10)"
    " || '- one' || chr(10) || '- two' AS content, 1::INTEGER AS n_sections FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
def read_html_files(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as HTML pages: head, style and script go, structure stays."""
    d = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    page = F.format_string(
        "<html><head><title> Supplier %d </title><style>h1 {}</style></head><body><h1>%s</h1><p>In <b>%s</b> &amp; <a href='/%d'>region</a></p><ul><li>one<li>two</ul><script>no()</script></body></html>",
        "s_suppkey", "s_name", "n_name", "n_regionkey",
    )
    return _first(files.extract(_named(d, F.concat(F.col("s_suppkey").cast("string"), F.lit(".html")), F.encode(page, "UTF-8"))), "title")


@query(
    "SELECT n_nationkey || '.rtf' AS source, 'rtf' AS source_type, '' AS header, n_name || '’s {region}' || chr(10) || 'é' || chr(9) || n_regionkey AS content, 1::INTEGER AS n_sections FROM nation"
)
def read_rtf_files(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "nation")
    text = F.concat(F.lit(r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}"), F.col("n_name"), F.lit("\\" + r"u8217?s \{region\}\par \'e9\tab "), F.col("n_regionkey").cast("string"), F.lit("}"))
    return _first(files.extract(_named(d, F.concat(F.col("n_nationkey").cast("string"), F.lit(".rtf")), F.encode(text, "UTF-8"))))


def _packed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(region: pd.Series, nations: pd.Series) -> pd.Series:
        out = []
        for name, own in zip(region, nations):
            rows = [(int(x["n_nationkey"]), x["n_name"]) for x in own]
            if kind == "docx":
                out.append(samples.docx(name, [n for _, n in rows], [["key", "name"], *([str(k), n] for k, n in rows)]))
            elif kind == "pdf":
                out.append(samples.pdf(name, [[n, f"number {k} (of {name})", "été"] for k, n in rows], packed=len(name) % 2 == 0))
            elif kind == "pptx":
                out.append(samples.pptx([(n, f"Number {k} of {name}") for k, n in rows]))
            else:
                out.append(samples.xlsx(name, [(n, k) for k, n in rows]))
        return pd.Series(out)

    d = _regions(spark, folder)
    return files.extract(_named(d, F.concat("region", F.lit(f".{kind}")), pack("region", "nations")))


@query(
    f"WITH {_REGIONS} SELECT region || '.docx' AS source, 'docx' AS source_type, '' AS header, '# ' || region || {LF} || string_agg('- ' || n_name, {LF} ORDER BY i) || {LF} || {LF} || '| key | name |' || {LF} || '| --- | --- |' || {LF}"
    f" || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', {LF} ORDER BY i) || {LF} AS content, 1::INTEGER AS n_sections FROM r GROUP BY region"
)
def read_docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each region: heading, list and table."""
    return _first(_packed(spark, folder, "docx"))


@query(f"WITH {_REGIONS} SELECT region || '.pptx' AS source, (i - 1)::INTEGER AS pos, 'Slide ' || i || ' — ' || n_name AS header, 'Number ' || n_nationkey || ' of ' || region AS content FROM r")
def read_pptx_files(spark: SparkSession, folder: str) -> DataFrame:
    """A slide for each nation."""
    return _packed(spark, folder, "pptx").select("source", F.inline("sections")).select("source", "pos", "header", "content")


@query(
    f"WITH {_REGIONS} SELECT region || '.xlsx' AS source, 'xlsx' AS source_type, 'Feuille : ' || region AS header, regexp_replace(string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', {LF} ORDER BY i),"
    " '^([^\\n]*)', '\\1' || chr(10) || '| --- | --- |') AS content, 1::INTEGER AS n_sections FROM r GROUP BY region"
)
def read_xlsx_files(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook for each region; its empty sheet gives no section."""
    return _first(_packed(spark, folder, "xlsx"))


@query(f"WITH {_REGIONS} SELECT region || '.pdf' AS source, region AS title, (i - 1)::INTEGER AS page_idx, n_name || {LF} || 'number ' || n_nationkey || ' (of ' || region || ')' || {LF} || 'été' || {LF} AS text, 0::INTEGER AS n_images FROM r")
def read_pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each nation, in compressed streams and in plain ones."""
    return _packed(spark, folder, "pdf").select("source", "title", F.inline("pages")).select("source", "title", "page_idx", "text", "n_images")


@query(
    "SELECT c_custkey || k.ext AS source, k.kind AS source_type, k.error AS error_type, CASE WHEN k.error IS NULL THEN 1 ELSE 0 END::INTEGER AS n_sections, strlen(c_name)::BIGINT AS original_size_bytes FROM customer JOIN"
    " (VALUES (0, '.TXT', 'txt', NULL), (1, '.docx', NULL, 'ExtractionError'), (2, '.xyz', NULL, 'UnsupportedFormatError'), (3, '.xlsx', NULL, 'ExtractionError'), (4, '', NULL, 'UnsupportedFormatError')) AS k(m, ext, kind, error) ON c_custkey % 5 = k.m"
)
def read_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Names of customers as files that can and can't be read: failures become rows."""
    m = F.col("c_custkey") % 5
    ext = F.when(m == 0, ".TXT").when(m == 1, ".docx").when(m == 2, ".xyz").when(m == 3, ".xlsx").otherwise("")
    got = files.extract(_named(table(spark, folder, "customer"), F.concat(F.col("c_custkey").cast("string"), ext), F.encode("c_name", "UTF-8")))
    return got.select("source", "source_type", "error_type", F.size("sections").alias("n_sections"), "original_size_bytes")


@query(
    f"WITH {sql.PAGES}, k AS (SELECT doc_id, page_idx, text, CASE WHEN page_idx = 0 THEN 11 ELSE 6 END AS psm FROM pages), c AS (SELECT DISTINCT text, psm FROM k WHERE doc_id % 2 = 0)"
    " SELECT k.doc_id, k.page_idx, CASE WHEN c.text IS NULL THEN strlen(k.text) || ' bytes, fra, ' || k.psm ELSE 'known' END AS text, c.text IS NOT NULL AS cache_hit FROM k LEFT JOIN c ON k.text = c.text AND k.psm = c.psm"
)
def ocr_recognise(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stand for images, a backend tells their size; the results of every other document are in the cache."""
    ocr.BACKENDS.add(samples.LengthReader(), replace=True)
    images = queries.page_table(spark, folder).select("doc_id", "page_idx", F.col("text").cast("binary").alias("payload"))
    psm = F.when(F.col("page_idx") == 0, F.lit(11)).otherwise(F.lit(6))
    cache = images.where("doc_id % 2 = 0").select(ocr.cache_key_column(F.col("payload"), F.lit("length:fra"), psm).alias("cache_key"), F.lit("known").alias("text"))
    done, _ = ocr.recognise(images, Options(ocr_backend="length", ocr_languages="fra"), cache)
    return done.select("doc_id", "page_idx", "text", "cache_hit")


_TOLD = (
    "extraction_start;INFO;plans.process;true;NULL", "ocr_skipped;INFO;operators.ocr;scanned AND wanted = 0;NULL", "ocr_start;INFO;operators.ocr;wanted > 0;wanted",
    "ocr_cache_hit;INFO;operators.ocr;hits > 0;hits", "ocr_cache_miss;INFO;operators.ocr;wanted > hits;wanted - hits", "ocr_complete;INFO;operators.ocr;wanted > 0;wanted",
    "extraction_failed;ERROR;plans.process;failed;NULL", "extraction_complete;INFO;plans.process;NOT failed;NULL", "cleaning_pipeline_complete;INFO;plans.process;NOT failed AND doc_id % 2 = 0;NULL",
)


@query(
    "WITH d AS (SELECT doc_id, max(source) AS source, max(source_type) AS source_type, doc_id % 11 = 0 AS failed, coalesce(max(len(ocr_pages)), 0)::INTEGER AS pages FROM documents_out GROUP BY doc_id),"
    " e AS (SELECT doc_id, source, failed, NOT failed AND source_type IN ('pdf', 'image') AS scanned, CASE WHEN NOT failed AND source_type IN ('pdf', 'image') THEN pages ELSE 0 END AS wanted,"
    " CASE WHEN NOT failed AND source_type IN ('pdf', 'image') THEN pages // 2 ELSE 0 END AS hits FROM d) "
    + " UNION ALL ".join(
        f"SELECT source, '{name}' AS event, '{level}' AS level, 'pagewright.{module}' AS logger, '{module.split('.')[1]}' AS module, ({pages})::VARCHAR AS pages, {'true' if name == 'extraction_failed' else 'false'} AS has_exc FROM e WHERE {when}"
        for name, level, module, when, pages in (x.split(";") for x in _TOLD)
    )
)
def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What a run would tell of the extracted documents; every eleventh has failed, half of the recognised pages were known."""
    docs = table(spark, folder, "documents_out").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("source_type").alias("source_type"), F.max("ocr_pages").alias("pages"), F.coalesce(F.max(F.size("ocr_pages")), F.lit(0)).alias("n"))
    failed = F.col("doc_id") % 11 == 0
    done = docs.select(
        "source", "source_type", F.when(failed, "ExtractionError").alias("error_type"), F.when(failed, "broken").alias("error"), F.greatest("n", F.lit(0)).alias("ocr_wanted"), F.floor(F.greatest("n", F.lit(0)) / 2).alias("ocr_hits"),
        F.array_repeat(F.lit(1), F.greatest("n", F.lit(0))).alias("ocr_pages"), F.lit(False).alias("image_based"), F.lit(True).alias("ocr_used"), F.lit("").alias("image_based_reason"), F.array().alias("sections"),
        F.when(F.col("doc_id") % 2 == 0, 5).otherwise(0).alias("original_chars"), F.lit(3).alias("cleaned_chars"), F.lit(40.0).alias("reduction_percent"),
    )
    told = events.of_documents(done, 10)
    return told.select(F.col("data")["path"].alias("source"), "event", "level", "logger", "module", F.when(F.col("event").startswith("ocr_"), F.col("data")["pages"]).alias("pages"), F.col("exc").isNotNull().alias("has_exc"))


@query(
    "WITH d AS (SELECT doc_id, max(source) AS source FROM documents_out GROUP BY 1) SELECT doc_id, row_number() OVER (ORDER BY source, doc_id)::BIGINT AS number, count(*) OVER ()::BIGINT AS total,"
    " last_value(doc_id) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM d"
)
def batch_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each file in its batch by path, how many there are, and the last one."""
    d = table(spark, folder, "documents_out").groupBy("doc_id").agg(F.max("source").alias("source"))
    last = d.agg(F.max_by("doc_id", F.struct("source", "doc_id")).alias("last"))
    return stats.numbered(d, "source", "doc_id").crossJoin(F.broadcast(last)).select("doc_id", "number", "total", "last")
