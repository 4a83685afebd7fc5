import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright import errors
from pagewright.sources import files, html, rtf
from pagewright.sources.decode import decode, detect_encoding

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CORE = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The title</dc:title></c>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    def p(t, style=None):
        return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'

    def cell(t):
        return f"<w:tc>{p(t)}</w:tc>"

    body = p("One", "H1") + p("text") + p("item", "LB") + p("step", "LN") + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('d')}{cell('e')}</w:tr></w:tbl>" + p("Nine", "H9")
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H9", "heading 9"), ("LB", "List Bullet"), ("LN", "List Number")))
    return package(**{"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {NS}>{styles}</w:styles>", "docProps/core.xml": CORE})


def test_docx():
    got = files.extract_one("a/x.docx", docx())
    assert got["title"] == "The title" and got["source_type"] == "docx"
    assert got["sections"] == [("", "# One\ntext\n- item\n1. step\n###### Nine\n\n| a\\|b | c |\n| --- | --- |\n| d | e |\n")]


def rels(*items):
    return "<r>" + "".join(f'<x Id="{i}" Type="t/{k}" Target="{t}"/>' for i, k, t in items) + "</r>"


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def shape(t, kind=None):
        return f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'

    def slide(*shapes):
        return f"<p:sld {ns}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"

    data = package(**{
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("Start", "title"), shape("one"), shape("two")),
        "ppt/slides/slide2.xml": slide(shape("body only")),
        "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/notes1.xml")),
        "ppt/notesSlides/notes1.xml": slide(shape("say this", "body")),
    })
    assert files.extract_one("x.pptx", data)["sections"] == [("Slide 1 — Start", "one\n\ntwo"), ("Slide 2", "body only\n\n### Notes du présentateur\n\nsay this")]


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="B3" s="1"><v>45292</v></c><c r="C3" t="inlineStr"><is><t>x|y</t></is></c></row>'
    return package(**{
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/s1.xml"), ("b", "worksheet", "/xl/worksheets/s2.xml")),
        "xl/worksheets/s1.xml": f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/s2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>head</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })


def test_xlsx():
    got = files.extract_one("x.xlsx", xlsx())
    assert got["sections"] == [("Feuille : One", "| head |  | True |\n| --- | --- | --- |\n|  |  |  |\n| 1.5 | 2024-01-01 00:00:00 | x\\|y |")]


def test_csv_keeps_ragged_rows_and_joins_quoted_lines():
    got = files.extract_one("d/t.csv", 'a,b\n"x\ny",z,é\n'.encode())
    assert got["sections"] == [("Feuille : t", "| a | b |  |\n| --- | --- | --- |\n| xy | z | é |")]
    assert files.extract_one("t.csv", b"")["sections"] == []


@pytest.mark.parametrize(("data", "encoding", "text"), [("é".encode(), "utf-8", "é"), (b"\xef\xbb\xbfa", "utf-8-sig", "a"), ("aé".encode("utf-16"), "utf-16", "aé"), (b"", "utf-8", "")])
def test_decoding(data, encoding, text):
    assert detect_encoding(data) == encoding and decode(data)[0] == text


def test_latin_is_read_somehow():
    assert decode("café".encode("latin-1"))[0].startswith("caf")


def test_html():
    title, text = html.to_markdown(
        "<html><head><title> T </title><style>x{}</style></head><body><h1>One</h1><p>a <b>b</b> <a href='u'>c</a> &amp; d<script>no</script></p><ul><li>x<li>y</ul><pre>k  v</pre>"
        "<table><tr><th>h<th>i</tr><tr><td>1<td>2|3</table><p>unclosed <b>end"
    )
    assert title == "T" and "no" not in text and "x{}" not in text
    for part in ("# One", "a **b** [c](u) & d", "- x\n- y", "```\nk  v\n```", "| h | i |\n| --- | --- |\n| 1 | 2\\|3 |", "unclosed **end"):
        assert part in text
    assert html.to_markdown("just text") == (None, "just text") and html.to_markdown("") == (None, "")


def test_pdf():
    from pagewright.plans import samples
    from pagewright.sources import pdf

    for packed in (True, False):
        title, pages = pdf.read_pages(samples.pdf("A (title)", [["one", "two (2) \\\\ é"], []], packed))
        assert title == "A (title)" and pages == [("one\ntwo (2) \\\\ é\n", 0, None), ("", 0, None)]
    assert pdf.read_pages(samples.pdf("t", [["x"]], jpeg=b"JPEG"))[1] == [("x\n", 1, b"JPEG")]
    for bad in (b"", b"no", b"%PDF-1.4\n", b"%PDF-1.4\ntrailer << /Encrypt 1 0 R >>"):
        with pytest.raises(errors.ExtractionError):
            pdf.read_pages(bad)


def test_pdf_positions_and_fonts():
    from pagewright.sources import pdf

    class Nothing:
        def get(self, x):
            return x

        def dict(self, x):
            return x or {}

    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0004> <0061> <0005> <0006> [<0078> <0079007A>] endbfrange"
    font = pdf.Font(Nothing(), {"Subtype": "Type0", "ToUnicode": pdf.Stream({}, cmap)})
    assert font.read(bytes([0, 1, 0, 2, 0, 4, 0, 6]))[0] == "éacyz" and pdf.Font(Nothing(), {"Subtype": "Type0"}).read(b"ab")[0] == ""
    named = pdf.Font(Nothing(), {"Encoding": {"Differences": [65, pdf.Name("eacute"), pdf.Name("seven"), pdf.Name("uni2022"), pdf.Name("comma")]}})
    assert named.read(b"ABCDE")[0] == "é7•,E"
    text = b"BT /F 10 Tf 0 100 Td [(wor) -20 (d) -600 (next)] TJ 100 0 Td (far) Tj 0 -12 Td (line) Tj ET BI /W 1 ID xx EI BT 1 0 0 1 0 50 Tm (<) Tj (\\101\\\n\\(b\\)) Tj ET"
    page = pdf.Page(Nothing(), {"Contents": pdf.Stream({}, text), "Resources": {"Font": {"F": {"Subtype": "Type1"}}}})
    assert page.text == "word next far\nline\n<A(b)\n"


def test_pdf_objects_in_streams():
    import zlib

    from pagewright.sources import pdf

    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] /Resources << /Font << /F << /Subtype /Type1 >> >> >> >>", b"<< /Type /Page /Contents [4 0 R] >>"]
    places = [sum(len(x) + 1 for x in inner[:k]) for k in range(3)]
    head = " ".join(f"{k + 1} {p}" for k, p in enumerate(places)).encode() + b" "
    packed = zlib.compress(head + b" ".join(inner))
    content = b"BT /F 9 Tf (in a stream) Tj ET"
    data = b"%PDF-1.5\n5 0 obj << /Type /ObjStm /N 3 /First " + str(len(head)).encode() + b" /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >> stream\r\n" + packed + b"\r\nendstream endobj\n"
    data += b"4 0 obj << /Length 6 0 R >> stream\n" + content + b"\nendstream endobj 6 0 obj " + str(len(content)).encode() + b" endobj\n7 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj"
    assert pdf.read_pages(data)[1] == [("in a stream\n", 0, None)]


def test_rtf():
    number = "\\" + "u8217?"
    given = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 @s\par two\tab x\{y\}}".replace("@", number)
    assert rtf.to_text(given) == "Café ’s\ntwo\tx{y}"
    assert rtf.to_text("plain") == "plain" and rtf.to_text("") == ""


def test_unknown_and_broken_files_become_rows(spark, tmp_path):
    for name, data in {"a.TXT": b"A", "b.docx": b"no zip", "c.md": b"# c", "d.bin": b"x", "e.pdf": b"%PDF", "sub/f.html": b"<p>f"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path), recursive=True)
    got = {r.source: r for r in files.extract(found).collect()}
    assert set(got) == {"a.TXT", "b.docx", "c.md", "e.pdf", "f.html"}
    assert got["a.TXT"].sections[0].content == "A" and got["c.md"].source_type == "markdown" and got["f.html"].sections[0].content == "f"
    assert got["b.docx"].error_type == "ExtractionError" and got["e.pdf"].error_type == "ExtractionError"
    named = files.extract(files.read_files(spark, [str(tmp_path / "d.bin")])).first()
    assert named.error_type == "UnsupportedFormatError" and issubclass(errors.UnsupportedFormatError, ValueError)


def test_dropped_paths():
    assert files.dropped_paths("{a b.pdf} c.txt {d e}") == ["a b.pdf", "c.txt", "d e"]
    assert files.dropped_paths("x {open") == ["x"] and files.dropped_paths(" ") == []


def test_whole_way(spark, tmp_path):
    from pagewright.options import Options
    from pagewright.plans.process import process_files

    (tmp_path / "a.md").write_text("# A\n\n\n\n\nexam-\nple  text", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(b"broken")
    done = {r.source: r for r in process_files(spark, str(tmp_path), extracted_at="2025-01-01T00:00:00Z").collect()}
    assert done["a.md"].output.endswith("---\n\n# A\n\nexample text\n") and done["a.md"].cleaned_chars < done["a.md"].original_chars
    assert done["b.docx"].error_type == "ExtractionError" and done["b.docx"].tokens_estimated == 0
    cut = process_files(spark, str(tmp_path / "a.md"), Options(max_chars=3), "txt").first()
    assert cut.output == "# A"


def test_command_line(tmp_path, capsys, spark):
    from pagewright.cli import main
    from pagewright.events import read_events

    (tmp_path / "a.txt").write_text("hello  world")
    out, log = tmp_path / "out", tmp_path / "log" / "x.jsonl"
    assert main([str(tmp_path / "a.txt"), "--format", "txt", "--out", str(out), "--log-file", str(log)]) == 0
    assert [p.read_text() for p in out.iterdir() if p.name.endswith(".clean.txt")] == ["hello world\n"]
    shown = capsys.readouterr()
    assert "metric" in shown.err and "12.0 B" in shown.err and "extraction" not in shown.err
    told = read_events(spark, str(log)).collect()
    assert [r.event for r in told] == ["extraction_start", "extraction_complete", "cleaning_pipeline_complete"]
    assert told[1].data["cleaned_chars"] == "11" and told[0].data["extension"] == ".txt" and told[0].exc is None
    assert main([str(tmp_path / "a.txt"), "--no-ocr", "--force-ocr"]) == 2
    assert main([str(tmp_path / "a.txt"), "--quiet", "--verbose"]) == 2


def test_command_line_failures(tmp_path, capsys):
    from pagewright.cli import main

    assert main([str(tmp_path / "none.txt")]) == 1
    (tmp_path / "b.docx").write_bytes(b"broken")
    assert main([str(tmp_path / "b.docx"), "--quiet"]) == 1
    shown = capsys.readouterr()
    assert shown.err.count("extraction_failed") == 1 and shown.out == ""
    with pytest.raises(SystemExit):
        main([str(tmp_path / "b.docx"), "--psm", "14"])


def test_profile_measures_the_sections_that_were_cleaned(tmp_path, capsys):
    from pagewright.cli import main

    (tmp_path / "a.md").write_text("a  b\n\n\n\nc", encoding="utf-8")
    assert main([str(tmp_path / "a.md"), "--profile"]) == 0
    assert "collapse_whitespace" in capsys.readouterr().err


def test_images_are_recognised_once(spark, tmp_path):
    from pagewright import events
    from pagewright.operators import ocr
    from pagewright.options import Options
    from pagewright.plans import samples
    from pagewright.plans.process import process_files

    ocr.BACKENDS.add(samples.LengthReader(), replace=True)
    options = Options(ocr_backend="length", ocr_languages="fra")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"12345")
    (tmp_path / "in" / "b.jpg").write_bytes(b"12345")
    cache = str(tmp_path / "cache")
    for hits in (0, 1):
        done = process_files(spark, str(tmp_path / "in"), options, "txt", extracted_at="", cache_folder=cache)
        got = {r.source: r for r in done.collect()}
        assert set(got) == {"a.png", "b.jpg"} and all(r.ocr_used and r.ocr_pages == [1] and r.language == "fra" and r.ocr_hits == hits for r in got.values())
        assert got["a.png"].output == "Texte extrait (OCR)\n\n5 bytes, fra, 6\n"
        assert ocr.read_cache(spark, cache).count() == 1
        told = sorted(r.event for r in events.of_documents(done, 10).where("data['path'] = 'a.png'").collect())
        assert told == sorted(["extraction_start", "extraction_complete", "cleaning_pipeline_complete", "ocr_start", "ocr_complete", "ocr_cache_hit" if hits else "ocr_cache_miss"])
    assert ocr.read_cache(spark, cache, 0).count() == 0 and ocr.read_cache(spark, str(tmp_path / "none")).count() == 0
    off = process_files(spark, str(tmp_path / "in"), Options(ocr_backend="length", no_ocr=True), "txt", extracted_at="").first()
    assert not off.ocr_used and off.output == "\n"
    assert "ocr_skipped" in [r.event for r in events.of_documents(process_files(spark, str(tmp_path / "in"), Options(no_ocr=True), extracted_at=""), 10).collect()]


def test_pages_of_pdf_files(spark, tmp_path):
    from pagewright.operators import ocr
    from pagewright.options import Options
    from pagewright.plans import samples
    from pagewright.plans.process import process_files

    ocr.BACKENDS.add(samples.LengthReader(), replace=True)
    (tmp_path / "scan.pdf").write_bytes(samples.pdf("Scan", [[], ["native text that is long enough to be left alone, as it is"]], jpeg=b"1234567"))
    row = process_files(spark, str(tmp_path), Options(ocr_backend="length", ocr_languages="fra", empty_page_min_words=1), extracted_at="").first()
    assert [(s.header, s.content) for s in row.sections] == [("Page 1 (OCR)", "7 bytes, fra, 11"), ("Page 2", "native text that is long enough to be left alone, as it is")]
    assert (row.title, row.ocr_pages, row.ocr_used, row.ocr_wanted, row.language) == ("Scan", [1], True, 1, "fra") and "ocr_pages:\n- 1\n" in row.output


def test_pages_tell_the_front_matter(spark, tmp_path, monkeypatch):
    from pagewright.options import Options
    from pagewright.plans.process import process_files

    pages = [(0, "Sommaire\nUn ..... 1", None, 3), (1, " ".join(["mot"] * 40) + ".", None, 3), (2, "two words", None, 3), (3, "one two three four five six", None, 3)]
    (tmp_path / "a.txt").write_text("x")
    monkeypatch.setattr(files, "extract", lambda df, options: spark.createDataFrame([{"path": "a.txt", "source": "a.txt", "source_type": "pdf", "original_size_bytes": 9, "ocr_used": False, "ocr_pages": [], "sections": [], "images": [], "pages": [dict(zip(("page_idx", "text", "ocr_text", "n_images"), p)) for p in pages]}], files.SCHEMA))
    row = process_files(spark, str(tmp_path / "a.txt"), Options(smart_filter=True, empty_page_min_words=3), extracted_at="").first()
    assert "filtered_pages:\n  toc:\n  - 1\n  sparse:\n  - 4\nimage_based: true\nimage_based_metrics:\n  page_count: 4\n  total_native_chars: " in row.output
    assert row.image_based_reason == "the backend is not available" and [s.header for s in row.sections] == ["Page 2"]


def test_stream(spark, tmp_path):
    from pagewright.streaming import clean as stream

    (tmp_path / "in").mkdir()
    spark.range(20).select(F.concat(F.lit("a  b "), F.col("id") % 5).alias("text"), F.timestamp_seconds(F.col("id")).alias("loaded_at"), F.lit("s").alias("source")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("text string, loaded_at timestamp, source string").parquet(str(tmp_path / "in"))
    seen = []
    stream.start(stream.cleaned(stream.without_repeats(source)), lambda df, i: seen.extend(r.text for r in df.collect()), f"clean_{tmp_path.parent.name}_{tmp_path.stat().st_ino}").awaitTermination(60)
    assert sorted(seen) == [f"a b {i}" for i in range(5)]
