"""Bytes to text."""

from __future__ import annotations

import codecs


def detect_encoding(data: bytes) -> str:
    """By mark, then strict UTF-8, then a detector where one is installed, then Latin-1."""
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        import chardet

        found = chardet.detect(data).get("encoding")
        if found:
            codecs.lookup(found)
            return found.lower()
    except (ImportError, LookupError):
        pass
    return "latin-1"


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding); bytes that don't fit become U+FFFD."""
    encoding = detect_encoding(data)
    return data.decode(encoding, errors="replace"), encoding
