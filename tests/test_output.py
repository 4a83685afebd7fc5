import hashlib
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright import errors, events, options
from pagewright.functions import text as T
from pagewright.operators import ocr, render, stats, tabular


def test_tokens_and_percentages(spark):
    df = spark.createDataFrame([("",), ("abc",), ("a" * 9,), (None,)], "t string")
    assert [r[0] for r in df.select(stats.estimate_tokens(F.col("t"))).collect()] == [0, 1, 2, None]
    pairs = spark.createDataFrame([(10, 100), (0, 0), (150, 100), (1, 3)], "a long, b long")
    assert [r[0] for r in pairs.select(T.percent_less(F.col("a"), F.col("b"))).collect()] == [90.0, 0.0, -50.0, 66.67]


@pytest.mark.parametrize(("n", "text"), [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (1 << 42, "4.0 TB"), (1 << 52, "4096.0 TB")])
def test_size_text(spark, n, text):
    assert spark.range(1).select(T.size_text(F.lit(n))).first()[0] == text


def test_count_text_and_paths(spark):
    row = spark.range(1).select(T.count_text(F.lit(1234567)), T.stem(F.lit("a/b.c/x.tar.PDF")), T.extension(F.lit("a/b.c/x.tar.PDF")), T.extension(F.lit("a.b/c")), T.stem(F.lit("c"))).first()
    assert tuple(row) == ("1 234 567", "x.tar", ".pdf", "", "c")


def test_tables(spark):
    rows = spark.createDataFrame([(1, 1, ["a|b", None]), (1, 0, ["h"]), (1, 2, [" x\ny "])], "doc_id int, row_idx int, cells array<string>")
    assert tabular.markdown_tables(rows).first().content == "| h |  |\n| --- | --- |\n| a\\|b |  |\n| x y |  |"
    assert rows.where(tabular.blank_row(F.col("cells"))).count() == 0


def document(spark, **changes):
    base = {"doc_id": 1, "source": "a: b.pdf", "source_type": "pdf", "title": "Title", "ocr_used": True, "ocr_pages": [3, 7], "language": "fra+eng", "original_size_bytes": 1000}
    base |= changes
    kinds = "doc_id int, source string, source_type string, title string, ocr_used boolean, ocr_pages array<int>, language string, original_size_bytes long, original string, cleaned string, sections array<struct<pos:int,header:string,content:string,continuation:boolean>>"
    sections = [(0, "Page 1", "one ", False), (1, "Page 2", "goes on", True), (2, "Page 3", "", False)]
    return stats.with_statistics(spark.createDataFrame([(*base.values(), "one\n\ngoes on", "one goes", sections)], kinds))


def test_markdown(spark):
    out = render.render(document(spark), "md", F.lit("2025-01-01T00:00:00Z")).first().output
    head, body = out.split("\n---\n", 1)
    assert body == "\n# Title\n\n## Page 1\n\none\n\ngoes on\n\n## Page 3\n"
    try:
        import yaml
    except ImportError:
        return
    got = yaml.safe_load(head.removeprefix("---\n"))
    assert list(got) == ["source", "type", "extracted_at", "ocr_used", "ocr_pages", "language", "stats"]
    assert got["source"] == "a: b.pdf" and got["ocr_pages"] == [3, 7] and got["extracted_at"] == "2025-01-01T00:00:00Z" and got["stats"]["tokens_estimated"] == 2


def test_yaml_scalars_survive(spark):
    yaml = pytest.importorskip("yaml")
    values = ["", "yes", "null", "12", "1.5", "2024-01-01", "- x", "a: b", "a #b", "it's", "'q'", " x", "x ", "plain é", "#c", "[x]", "a\nb", "~", "key:", "@x", "1e5", "0x1f", "x: 'y'", "é: ü"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [yaml.safe_load("k: " + r[0])["k"] for r in df.select(render.yaml_text(F.col("v"))).collect()] == values


def test_txt_and_json(spark):
    assert render.render(document(spark), "txt", F.lit("")).first().output == "Title\n\nPage 1\n\none \n\nPage 2\n\ngoes on\n\nPage 3\n"
    got = json.loads(render.render(document(spark, title=None), "json", F.lit("")).first().output)
    assert got["title"] is None and got["sections"][2] == {"header": "Page 3", "content": ""} and len(got["stats"]) == 10
    with pytest.raises(ValueError):
        render.render(document(spark), "doc", F.lit(""))


def test_recap_of_nothing_and_of_failures(spark):
    kinds = "error string, original_size_bytes long, cleaned_size_bytes long, tokens_input_estimated long, tokens_estimated long"
    empty = stats.recap(spark.createDataFrame([], kinds)).first()
    assert (empty.files, empty.bytes_before, empty.size_gain) == (0, 0, 0.0)
    r = stats.recap(spark.createDataFrame([(None, 100, 10, 50, 5), ("x", 7, 7, 7, 7)], kinds)).first()
    assert (r.successes, r.failures, r.bytes_before, r.size_gain, r.token_gain) == (1, 1, 100, 90.0, 90.0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


class Fake:
    name = "fake"

    def is_available(self):
        return True

    def extract(self, image, *, languages, psm):
        return f"{len(image)}:{languages}:{psm}"

    def install_hint(self):
        return ""


def test_recognition_uses_the_cache(spark):
    ocr.BACKENDS.add(Fake(), replace=True)
    try:
        o = options.Options(ocr_backend="fake", ocr_languages="eng")
        images = spark.createDataFrame([(1, 0, bytearray(b"abc")), (1, 1, bytearray(b"abc")), (2, 1, bytearray(b"abc")), (2, 2, bytearray(b"wxyz"))], "doc_id int, page_idx int, payload binary")
        known = spark.createDataFrame([(ocr.cache_key(b"wxyz", "fake:eng", 6), "known"), (ocr.cache_key(b"wxyz", "fake:eng", 6), "known")], "cache_key string, text string")
        done, new = ocr.recognise(images, o, known)
        assert sorted((r.doc_id, r.page_idx, r.text) for r in done.collect()) == [(1, 0, "3:eng:11"), (1, 1, "3:eng:6"), (2, 1, "3:eng:6"), (2, 2, "known")]
        assert new.count() == 2
    finally:
        ocr.BACKENDS.pop("fake")


def test_backends():
    with pytest.raises(errors.OcrError):
        ocr.BACKENDS["none"]
    with pytest.raises(ValueError):
        ocr.BACKENDS.add(ocr.Tesseract())
    assert "tesseract" in ocr.BACKENDS and isinstance(ocr.BACKENDS["tesseract"], ocr.Backend)


def test_tokens_by_vocabulary(spark, tmp_path):
    import base64

    pytest.importorskip("tiktoken")
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    (tmp_path / "v.ranks").write_bytes(b"\n".join(base64.b64encode(r) + f" {i}".encode() for i, r in enumerate(ranks)))
    df = spark.createDataFrame([("abab c",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(stats.count_tokens(F.col("t"), str(tmp_path / "v.ranks"), r"\S+|\s+")).collect()] == [3, 0, None, 2]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "a int, number_of int").repartition(5)
    got = stats.numbered(df, "a").collect()
    assert sorted((r.a, r.number, r.total) for r in got) == [(i, i + 1, 50) for i in range(50)]
    assert stats.numbered(df.limit(0), "a").count() == 0


def test_event_lines(spark):
    rows = [("t", "INFO", "l", "e", "m", {"k": "1", "z": "x"}, None), ("t", "ERROR", "l", "f", "m", {}, "X: y")]
    df = spark.createDataFrame(rows, events.SCHEMA)
    assert [json.loads(r.value) for r in events.json_line(df).collect()] == [{"ts": "t", "level": "INFO", "logger": "l", "event": "e", "module": "m", "data": {"k": "1", "z": "x"}}, {"ts": "t", "level": "ERROR", "logger": "l", "event": "f", "module": "m", "exc": "X: y"}]
    assert [r.value for r in events.key_values(df).collect()] == ["e k=1 z=x", "f"]
    assert [r.event for r in events.at_least(df, "WARNING").collect()] == ["f"]


def test_cache_key_in_both_worlds(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff"),)], "p binary")
    assert df.select(ocr.cache_key_column(F.col("p"), F.lit("t:fra"), F.lit(6))).first()[0] == ocr.cache_key(b"\x00\xff", "t:fra", 6) == hashlib.sha256(b"\x00\xff|lang=t:fra|psm=6").hexdigest()


def test_image_preparation():
    a = np.full((120, 200), 255, np.uint8)
    a[20:100:16, 20:180] = 0
    y, x = np.mgrid[0:120, 0:200]
    tilted = np.where(((y - x * np.tan(np.radians(3))).astype(int) % 16) == 0, 0, 255).astype(np.uint8)
    assert abs(abs(ocr.skew(tilted)) - 3) <= 0.5 and ocr.deskew(np.full((20, 20), 255, np.uint8)).shape == (20, 20)
    assert set(np.unique(ocr.binarize(a))) <= {0, 255} and ocr.upscale(a, 72).shape == (360, 600) and ocr.upscale(a, 150).shape == (240, 400) and ocr.upscale(a, 300) is a
    framed = np.zeros((100, 100), np.uint8)
    framed[15:85, 15:85] = 255
    assert ocr.crop_borders(framed).shape == (70, 70) and ocr.crop_borders(framed[10:90, 10:90]).shape == (80, 80)
    assert ocr.equalise(a).shape == a.shape and ocr.median3(a).shape == a.shape and ocr.prepare(a, 300).ndim == 2


def test_options_and_files(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[ocr]\nlanguages = "deu"\nunknown = 1\n[cleaning]\naggressive = true\n[cache]\ndisabled = true\n[else]\nx = 1\n')
    o = options.load_config(path).options
    assert (o.ocr_languages, o.aggressive, o.use_cache, o.ocr_psm) == ("deu", True, False, 6)
    assert options.with_overrides(o, ocr_languages="eng", ocr_psm=None).ocr_languages == "eng"
    for bad in ("[ocr", "[ocr]\nno_ocr = true\nforce_ocr = true"):
        path.write_text(bad)
        with pytest.raises(errors.ConfigError):
            options.load_config(path)
    with pytest.raises(errors.ConfigError):
        options.load_config(tmp_path / "none.toml")


def test_default_config(tmp_path, monkeypatch):
    monkeypatch.setenv("PAGEWRIGHT_HOME", str(tmp_path))
    assert options.load_config() == options.Config()
