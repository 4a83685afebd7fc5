import pytest
from pyspark.sql import functions as F

from pagewright.operators import pages
from pagewright.options import Options


def frame(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id int, page_idx int, text string")


def texts(df):
    return [r.text for r in sorted(df.collect(), key=lambda r: r.page_idx)]


def test_recurring_lines_and_page_numbers_go(spark):
    got = texts(pages.strip_headers_footers(frame(spark, [f"ACME corp\nbody {i} of it\nPage {i} / 4" for i in range(1, 5)])))
    assert got == [f"body {i} of it" for i in range(1, 5)]


def test_short_documents_only_lose_page_numbers(spark):
    assert texts(pages.strip_headers_footers(frame(spark, ["same\nPage 1", "same\np. 2"]))) == ["same", "same"]


def test_unique_lines_stay_and_emptied_pages_survive(spark):
    assert texts(pages.strip_headers_footers(frame(spark, ["one", "two", "three"]))) == ["one", "two", "three"]
    assert texts(pages.strip_headers_footers(frame(spark, ["x", "x", "x"]))) == ["", "", ""]


def test_a_recurring_line_goes_from_the_body_too(spark):
    page = "HEAD\na\nb\nc\nHEAD\nd\ne\nf\ng"
    assert "HEAD" not in texts(pages.strip_headers_footers(frame(spark, [page, page.replace("a", "z"), "HEAD\nq"])))[0]


@pytest.mark.parametrize(("n", "times", "gone"), [(9, 2, True), (10, 2, False), (10, 3, True), (14, 3, False), (14, 4, True)])
def test_threshold_follows_the_number_of_pages(spark, n, times, gone):
    got = texts(pages.strip_headers_footers(frame(spark, [f"{'TITLE' if i < times else f'other {i}x'}\nbody {i}y" for i in range(n)])))
    assert ("TITLE" not in got[0]) == gone


TOC = [("Sommaire\n\nx", True), ("see Table of Contents", True), ("\n".join(f"Chapter {i} ...... {i}" for i in range(6)), True),
       ("\n".join(f"Chapter {i}      {i}" for i in range(6)), True), ("Just prose without any list of chapters at all.", False), ("\n".join(f"Chapter {i} ...... {i}" for i in range(4)), False)]
BIB = [("Bibliographie\nx", True), ("RÉFÉRENCES", True), (" ".join(f"[{i}]" for i in range(11)), True), (" ".join("(Smith, 2001)" for _ in range(10)), True), ("One (Smith, 2001) only.", False)]


@pytest.mark.parametrize(("text", "expected"), TOC)
def test_toc(spark, text, expected):
    assert frame(spark, [text]).select(pages.is_toc(F.col("text"))).first()[0] is expected


@pytest.mark.parametrize(("text", "expected"), BIB)
def test_bibliography(spark, text, expected):
    assert frame(spark, [text]).select(pages.is_bibliography(F.col("text"))).first()[0] is expected


def test_classes_and_report(spark):
    p = frame(spark, ["cover", "Sommaire\nx", "word " * 200, "Bibliographie\nx"])
    c = {r.page_idx: r for r in pages.classify_pages(p).collect()}
    assert [c[i].reasons for i in range(4)] == [["sparse"], ["toc"], [], ["bibliography"]]
    r = pages.filter_report(pages.classify_pages(p)).first()
    assert (r.toc, r.bibliography, r.sparse, r.kept) == ([2], [4], [1], [3])
    off = pages.classify_pages(p, Options(filter_toc=False, filter_sparse=False))
    assert sorted(r.page_idx for r in off.where("should_filter").collect()) == [3]


@pytest.mark.parametrize(
    ("before", "text", "flag"),
    [("the end of", "a line", True), ("The end.", "a line", False), ("why?", "a", False), ("the end", "Next", False), ("the end", "5 principal", True), ("", "a", False), ("the end", ", and", True), ("the end", "œuvre", False), (None, "a", False)],
)
def test_goes_on(spark, before, text, flag):
    df = spark.createDataFrame([(before, text)], "b string, t string")
    assert df.select(pages.goes_on(F.col("b"), F.col("t"))).first()[0] is flag


def test_images(spark):
    short = frame(spark, ["x"] * 10).withColumn("n_images", F.lit(5))
    long = frame(spark, ["x" * 500] * 10, 2).withColumn("n_images", F.lit(5))
    few = frame(spark, ["x"] * 2, 3).withColumn("n_images", F.lit(5))
    got = {r.doc_id: r.image_based for r in pages.image_based(short.unionByName(long).unionByName(few)).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert pages.image_based(short.limit(0)).count() == 0


def test_plan_keeps_page_numbers_and_order(spark):
    rows = [(1, 0, "a short native", "recognised text of the first page goes", 0), (1, 1, "2", None, 0), (1, 2, "on to the third page, which is native and long enough to stay as it is", None, 0)]
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, text string, ocr_text string, n_images int")
    got = sorted(pages.page_plan(df).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.header, r.continuation) for r in got] == [(0, "Page 1 (OCR)", False), (2, "Page 3", True)]


def test_scan_reads_only_what_it_needs(spark, folder):
    from pagewright.plans.queries import recurring_lines

    plan = recurring_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "loaded_at" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
