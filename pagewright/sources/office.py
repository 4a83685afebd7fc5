"""Office Open XML: word-processor, slide and spreadsheet files with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from pagewright.errors import ExtractionError

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
NOTES_HEADING = "### Notes du présentateur"
# Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


class Package:
    """A file's parts and relations."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ExtractionError(f"no package: {e}") from e
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Id to (kind, part)."""
        folder, file = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                part = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], part)
        return out

    def title(self) -> str | None:
        root = self.xml("docProps/core.xml")
        found = root.find(f"{DC}title") if root is not None else None
        return (found.text or "").strip() or None if found is not None else None


def escape_cell(value: str) -> str:
    return value.replace("|", "\\|").replace("\n", " ").strip()


def table(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is the head, short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _paragraph_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out).strip()


def read_docx(data: bytes) -> tuple[str | None, list[tuple[str, str]]]:
    """(title, one section): paragraphs by style, then all tables."""
    package = Package(data)
    root = package.xml("word/document.xml")
    if root is None:
        raise ExtractionError("no word/document.xml")
    styles = package.xml("word/styles.xml")
    names = {}
    for s in styles.iter(f"{W}style") if styles is not None else ():
        name = s.find(f"{W}name")
        names[s.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
    body = root.find(f"{W}body")
    lines = []
    for p in body.findall(f"{W}p") if body is not None else ():
        text = _paragraph_text(p)
        style = p.find(f"{W}pPr/{W}pStyle")
        name = names.get(style.get(f"{W}val"), style.get(f"{W}val") or "") if style is not None else ""
        heading = re.fullmatch(r"heading (\d+)", name, re.I)
        if not text:
            lines.append("")
        elif heading:
            lines.append("#" * min(6, max(1, int(heading.group(1)))) + " " + text)
        elif "bullet" in name.lower() or name.lower() == "list paragraph":
            lines.append(f"- {text}")
        elif "number" in name.lower():
            lines.append(f"1. {text}")
        else:
            lines.append(text)
    for t in body.findall(f"{W}tbl") if body is not None else ():
        rows = [[escape_cell("\n".join(_paragraph_text(p) for p in c.findall(f"{W}p"))) for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]
        if rows and any(rows):
            lines += ["", table(rows), ""]
    return package.title(), [("", "\n".join(lines))]


def _frame_text(shape: ET.Element) -> str:
    frame = shape.find(f"{P}txBody")
    if frame is None:
        return ""
    return "\n".join("".join((e.text or "") if e.tag == f"{A}t" else "\v" if e.tag == f"{A}br" else "" for e in p.iter()) for p in frame.findall(f"{A}p")).strip()


def _kind(shape: ET.Element) -> str | None:
    ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return None if ph is None else ph.get("type", "body")


def read_pptx(data: bytes) -> tuple[str | None, list[tuple[str, str]]]:
    """(title, a section for each slide): other texts in order, then the speaker's notes."""
    package = Package(data)
    root = package.xml("ppt/presentation.xml")
    if root is None:
        raise ExtractionError("no ppt/presentation.xml")
    parts = package.relations("ppt/presentation.xml")
    sections = []
    for i, s in enumerate(root.iter(f"{P}sldId"), 1):
        name = parts[s.get(f"{R}id")][1]
        slide = package.xml(name)
        tree = slide.find(f"{P}cSld/{P}spTree") if slide is not None else None
        shapes = tree.findall(f"{P}sp") if tree is not None else []
        titles = [x for x in shapes if _kind(x) in ("title", "ctrTitle")][:1]
        title = _frame_text(titles[0]) if titles else ""
        body = [t for x in shapes if x not in titles and (t := _frame_text(x))]
        for kind, part in package.relations(name).values():
            if kind == "notesSlide":
                notes = package.xml(part)
                found = [_frame_text(x) for x in (notes.iter(f"{P}sp") if notes is not None else ()) if _kind(x) == "body"]
                if found and found[0]:
                    body.append(f"{NOTES_HEADING}\n\n{found[0]}")
        sections.append((f"Slide {i}" + (f" — {title}" if title else ""), "\n\n".join(body)))
    return package.title(), sections


def _number(text: str, is_date: bool) -> str:
    value = float(text)
    if is_date:
        when = dt.datetime(1899, 12, 30) + dt.timedelta(days=value)
        when = (when + dt.timedelta(microseconds=500)).replace(microsecond=0)
        return str(when) if value >= 1 else str(when.time())
    return str(int(value)) if value.is_integer() and "." not in text and "e" not in text.lower() else str(value)


def read_xlsx(data: bytes) -> tuple[str | None, list[tuple[str, list[list[str]]]]]:
    """(title, sheets with their rows of cells); stored results of formulas, dates and booleans as texts."""
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ExtractionError("no xl/workbook.xml")
    shared = package.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared.findall(f"{S}si")] if shared is not None else []
    styles = package.xml("xl/styles.xml")
    dates: list[bool] = []
    if styles is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{S}numFmt")}
        xfs = styles.find(f"{S}cellXfs")
        for x in xfs if xfs is not None else ():
            k = int(x.get("numFmtId", "0"))
            code = re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", own.get(k, ""))
            dates.append(k in DATE_FORMATS or bool(re.search(r"[dmyh]", code, re.I)))
    parts = package.relations("xl/workbook.xml")
    sheets = []
    for sheet in book.iter(f"{S}sheet"):
        root = package.xml(parts[sheet.get(f"{R}id")][1])
        rows: list[list[str]] = []
        for r in root.iter(f"{S}row") if root is not None else ():
            at = int(r.get("r") or len(rows) + 1)
            while len(rows) < at - 1:
                rows.append([])
            cells: list[str] = []
            for c in r.findall(f"{S}c"):
                column = len(cells)
                if ref := re.match(r"[A-Z]+", c.get("r") or ""):
                    column = 0
                    for ch in ref.group():
                        column = column * 26 + ord(ch) - 64
                    column -= 1
                cells += [""] * (column + 1 - len(cells))
                v, kind = c.find(f"{S}v"), c.get("t")
                if kind == "inlineStr":
                    cells[column] = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    cells[column] = strings[int(v.text)]
                elif kind == "b":
                    cells[column] = str(v.text == "1")
                elif kind in ("str", "e", "d"):
                    cells[column] = v.text
                else:
                    style = int(c.get("s", "0"))
                    cells[column] = _number(v.text, style < len(dates) and dates[style])
            rows.append(cells)
        sheets.append((sheet.get("name", ""), rows))
    return package.title(), sheets
