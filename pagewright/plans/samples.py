"""Small files made of table rows, so that readers can be held against SQL over the same rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from html import escape

_OFFICE = "http://schemas.openxmlformats.org"
_REL = f"{_OFFICE}/officeDocument/2006/relationships"
_WORD, _SLIDE, _DRAW, _SHEET = (f"{_OFFICE}/{x}/2006/main" for x in ("wordprocessingml", "presentationml", "drawingml", "spreadsheetml"))


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _relations(items: list[tuple[str, str, str]]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


def docx(title: str, items: list[str], rows: list[list[str]]) -> bytes:
    """A title as heading 1, items as a list, and a table."""

    def p(text: str, style: str = "") -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = p(title, "H1") + "".join(p(x, "LB") for x in items) + f"<w:tbl>{table}</w:tbl>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("LB", "List Bullet")))
    return package({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{styles}</w:styles>'})


def pptx(slides: list[tuple[str, str]]) -> bytes:
    """Slides of a title and a text."""

    def shape(text: str, kind: str) -> str:
        return f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'

    space = f'xmlns:p="{_SLIDE}" xmlns:a="{_DRAW}" xmlns:r="{_REL}"'
    parts = {
        "ppt/presentation.xml": f"<p:presentation {space}><p:sldIdLst>" + "".join(f'<p:sldId r:id="r{i}"/>' for i in range(len(slides))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _relations([(f"r{i}", "slide", f"slides/slide{i}.xml") for i in range(len(slides))]),
    }
    for i, (title, text) in enumerate(slides):
        tree = shape(title, '<p:ph type="title"/>') + shape(text, "")
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {space}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
    return package(parts)


def xlsx(name: str, rows: list[tuple[str, int]]) -> bytes:
    """A sheet of a text and a number in each row, and an empty sheet."""
    cells = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{escape(t)}</t></is></c><c r="B{k}"><v>{n}</v></c></row>' for k, (t, n) in enumerate(rows, 1))
    space = f'xmlns="{_SHEET}" xmlns:r="{_REL}"'
    return package({
        "xl/workbook.xml": f'<workbook {space}><sheets><sheet name="{escape(name)}" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations([("a", "worksheet", "worksheets/s1.xml"), ("b", "worksheet", "worksheets/s2.xml")]),
        "xl/worksheets/s1.xml": f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>",
        "xl/worksheets/s2.xml": f"<worksheet {space}><sheetData/></worksheet>",
    })


def pdf(title: str, pages: list[list[str]], packed: bool = True, jpeg: bytes | None = None) -> bytes:
    """A page for each list of lines, Latin-1 text in Helvetica; jpeg is a picture on every page."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, head: str = "") -> bytes:
        if packed and not head:
            data, head = zlib.compress(data), "/Filter /FlateDecode"
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    def string(text: str) -> bytes:
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1")) + b")"

    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    picture = add(stream(jpeg, "/Type /XObject /Subtype /Image /Filter /DCTDecode")) if jpeg else 0
    tree, kids = len(objects) + 2 * len(pages) + 1, []
    for lines in pages:
        text = b"BT /F1 12 Tf 14 TL 72 720 Td " + b" T* ".join(string(x) + b" Tj" for x in lines) + b" ET" + (b" /P1 Do" if jpeg else b"")
        content = add(stream(text))
        used = f"/Font << /F1 {font} 0 R >>" + (f" /XObject << /P1 {picture} 0 R >>" if jpeg else "")
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /Resources << {used} >> /Contents {content} 0 R >>".encode()))
    add(f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode())
    root = add(f"<< /Type /Catalog /Pages {tree} 0 R >>".encode())
    info = add(b"<< /Title " + string(title) + b" >>")
    body = b"".join(f"{i} 0 obj\n".encode() + o + b"\nendobj\n" for i, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + f"trailer\n<< /Root {root} 0 R /Info {info} 0 R >>\n%%EOF\n".encode()


class LengthReader:
    """A backend that tells what it was given."""

    name = "length"

    def is_available(self) -> bool:
        return True

    def extract(self, image: bytes, *, languages: str, psm: int) -> str:
        return f"{len(image)} bytes, {languages}, {psm}"

    def install_hint(self) -> str:
        return ""
