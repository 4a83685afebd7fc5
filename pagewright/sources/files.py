"""Files to documents: discovery, dispatch by extension, and extraction in the executors.

One row per document; a file that can't be read gives a row with error_type and error instead of failing the job.
PDF files are read with an optional package or a small reader of their own; their pages then pass the page operators.
"""

from __future__ import annotations

import csv
import posixpath
import re
from collections.abc import Callable, Iterable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError, ExtractionError, UnsupportedFormatError
from pagewright.functions import text as T
from pagewright.operators.ocr import BACKENDS, Backend
from pagewright.options import Options
from pagewright.sources import html, office, pdf, rtf
from pagewright.sources.decode import decode

# Extensions and the kinds of file they stand for.
KINDS = {
    ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".csv": "csv", ".html": "html", ".htm": "html", ".txt": "txt", ".md": "markdown",
    ".markdown": "markdown", ".rtf": "rtf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".tiff": "image", ".tif": "image",
    ".bmp": "image", ".heic": "image", ".heif": "image",
}
# Headers of sections.
SHEET_HEADER, IMAGE_HEADER = "Feuille : ", "Texte extrait (OCR)"
#: Documents go on to the next operator when files of so many bytes were read.
OUT_BYTES = 16 << 20
#: The page number of an image that is no page, which is read as the options say.
IMAGE_PAGE = -1
SCHEMA = (
    "path string, source string, source_type string, original_size_bytes long, title string, encoding string, language string, ocr_used boolean,"
    " ocr_pages array<int>, sections array<struct<pos:int,header:string,content:string,continuation:boolean>>, pages array<struct<page_idx:int,text:string,"
    "ocr_text:string,n_images:int>>, images array<struct<page_idx:int,payload:binary>>, error_type string, error string"
)


def kind_of(path: Column) -> Column:
    """The kind of a file by its extension, null where it is unknown; a lookup in a literal map, so no join is needed."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return table[T.extension(path)]


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the known files in the given folders; a file that is named itself is kept whatever its extension."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    named = [p for p in paths if "." in posixpath.basename(p.rstrip("/")) and PurePosixPath(p).suffix]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    keep = kind_of(F.col("path")).isNotNull()
    for p in named:
        keep = keep | F.col("path").endswith(p)
    return df.where(keep)


def in_order(df: DataFrame, column: str = "path") -> DataFrame:
    """Files in the order of their paths, for results that people look at; plans themselves need no order."""
    return df.orderBy(column)


def dropped_paths(data: str) -> list[str]:
    """Paths from a drop: those with blanks stand in braces; an open brace ends the list."""
    out, rest = [], data.strip()
    while rest:
        if rest[0] == "{":
            path, closed, rest = rest[1:].partition("}")
            if not closed:
                break
            out.append(path)
        else:
            path, *more = rest.split(None, 1)
            out.append(path)
            rest = more[0] if more else ""
        rest = rest.lstrip()
    return out


Sections = list[tuple[str, str]]


def read_text(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    text, encoding = decode(data)
    return {"encoding": encoding, "sections": [("", text)]}


def read_csv(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    """Comma-separated; lines are split first, so a line end inside quotes is lost, as downstream tables need one line a row."""
    text, encoding = decode(data)
    rows = list(csv.reader(text.splitlines()))
    return {"encoding": encoding, "sections": [(SHEET_HEADER + PurePosixPath(name).stem, rows_table(rows))] if rows else []}


def rows_table(rows: list[list[str]]) -> str:
    return office.table([[office.escape_cell(c or "") for c in r] for r in rows])


def read_xlsx(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    """A section for each sheet with a cell that isn't blank."""
    title, sheets = office.read_xlsx(data)
    return {"title": None, "sections": [(SHEET_HEADER + s, rows_table(rows)) for s, rows in sheets if any(c.strip() for r in rows for c in r)]}


def read_docx(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    title, sections = office.read_docx(data)
    return {"title": title, "sections": sections}


def read_pptx(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    title, sections = office.read_pptx(data)
    return {"title": title, "sections": sections}


def read_html(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    text, encoding = decode(data)
    title, content = html.to_markdown(text)
    return {"title": title, "encoding": encoding, "sections": [("", content)]}


def read_rtf(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    text = data.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    return {"sections": [("", rtf.to_text(text))]}


def read_pdf(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    """Pages with native text and number of images; images of the pages whose text has to be recognised come along where a
    backend is available: the page as a picture by the package for PDF, or else its largest JPEG picture."""

    def wanted(text: str) -> bool:
        return not options.no_ocr and (options.force_ocr or len(text.strip()) < options.pdf_min_native_chars_per_page) and engine.is_available()

    try:
        import pymupdf
    except ImportError:
        title, found = pdf.read_pages(data)
        pages = [(i, text, None, n) for i, (text, n, _) in enumerate(found)]
        return {"title": title, "pages": pages, "images": [(i, jpeg) for i, (text, _, jpeg) in enumerate(found) if jpeg and wanted(text)], "sections": []}
    pages, images = [], []
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        for i, page in enumerate(doc):
            text = page.get_text()
            if wanted(text):
                images.append((i, page.get_pixmap(dpi=options.pdf_ocr_dpi).tobytes("png")))
            pages.append((i, text, None, len(page.get_images(full=True))))
        title = (doc.metadata or {}).get("title") or None
    return {"title": title, "pages": pages, "images": images, "sections": []}


def read_image(data: bytes, name: str, options: Options, engine: Backend) -> dict:
    """The image itself to be recognised; nothing where recognition is switched off or its backend isn't available."""
    return {"sections": [], "images": [(IMAGE_PAGE, data)] if not options.no_ocr and engine.is_available() else []}


READERS: dict[str, Callable[[bytes, str, Options, Backend], dict]] = {
    "txt": read_text, "markdown": read_text, "csv": read_csv, "xlsx": read_xlsx, "docx": read_docx, "pptx": read_pptx, "html": read_html, "rtf": read_rtf,
    "pdf": read_pdf, "image": read_image,
}


def extract_one(path: str, data: bytes, options: Options = Options(), engine: Backend | None = None) -> dict:
    """One document; raises errors of this package. The engine is given where the registry of the caller isn't at hand, as in executors."""
    name = posixpath.basename(path)
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in KINDS:
        raise UnsupportedFormatError(f"no extractor for {suffix or 'a file without extension'}")
    try:
        got = READERS[KINDS[suffix]](data, name, options, engine or BACKENDS[options.ocr_backend])
    except EngineError:
        raise
    except Exception as e:
        raise ExtractionError(f"{type(e).__name__}: {e}") from e
    return {"source_type": KINDS[suffix], "title": None, "encoding": None, "language": None, "ocr_used": False, "ocr_pages": [], "pages": [], "images": []} | got


def extract(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Documents of the files (path, content), SCHEMA, given out as soon as OUT_BYTES were read.

    A task gets files of spark.sql.files.maxPartitionBytes in all, or one larger file, which bounds what it holds.
    """
    engine = BACKENDS[options.ocr_backend]
    names = [x.split(" ")[0] for x in re.sub(r"<.*?>+", "", SCHEMA).split(", ")]
    nothing = {"source_type": None, "title": None, "encoding": None, "language": None, "ocr_used": False, "ocr_pages": [], "sections": [], "pages": [], "images": []}

    def read(path: str, data: bytes) -> dict:
        row = {"path": path, "source": posixpath.basename(path), "original_size_bytes": len(data), "error_type": None, "error": None}
        try:
            got = extract_one(path, data, options, engine)
        except EngineError as e:
            return row | nothing | {"error_type": type(e).__name__, "error": str(e)}
        got["sections"] = [{"pos": i, "header": h, "content": c, "continuation": False} for i, (h, c) in enumerate(got["sections"])]
        got["pages"] = [dict(zip(("page_idx", "text", "ocr_text", "n_images"), p)) for p in got["pages"]]
        got["images"] = [dict(zip(("page_idx", "payload"), p)) for p in got["images"]]
        return row | got

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        out, size = [], 0
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                out.append(read(path, bytes(data)))
                size += len(data)
                if size >= OUT_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
