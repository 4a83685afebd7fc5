"""RTF to text: a small reader of control words."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
# Groups that hold no text, and characters that control words stand for.
SILENT = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata listtable listoverridetable generator".split())
SIGNS = {
    "par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "|", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘",
    "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•",
}


def to_text(data: str) -> str:
    """The text of an RTF document; what isn't RTF comes back as it is."""
    if not data.lstrip().startswith("{\\rtf"):
        return data
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip, left, codepage = False, 1, 0, "cp1252"
    fresh = False  # at the start of a group
    pending = bytearray()

    def flush() -> None:
        if pending:
            out.append(pending.decode(codepage, errors="replace"))
            pending.clear()

    for m in _TOKEN.finditer(data):
        byte, word, number, sign, brace, text = m.groups()
        if byte is None:
            flush()
        if brace == "{":
            stack.append((silent, skip))
            fresh = True
            left = 0
            continue
        if brace == "}":
            silent, skip = stack.pop() if stack else (False, 1)
            left = 0
        elif byte is not None:
            if left:
                left -= 1
            elif not silent:
                pending.append(int(byte, 16))
        elif word is not None:
            if fresh and word in SILENT:
                silent = True
            elif word == "ansicpg" and number:
                try:
                    b"".decode(f"cp{number}")
                    codepage = f"cp{number}"
                except LookupError:
                    pass
            elif word == "uc":
                skip = int(number or 1)
            elif word == "u" and number and not silent:
                out.append(chr(int(number) % 65536))
                left = skip
            elif word == "bin":
                silent = silent or bool(number)
            elif not silent:
                out.append(SIGNS.get(word, ""))
        elif sign is not None:
            if sign == "*" and fresh:
                silent = True
            elif not silent:
                out.append({"~": "\xa0", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign if sign in "\\{}" else ""))
        elif text and not silent:
            t = text.replace("\r", "").replace("\n", "")
            if left:
                t, left = t[left:], max(0, left - len(t))
            out.append(t)
        fresh = False
    flush()
    joined = "".join(out)
    try:
        return joined.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return joined.encode("utf-8", "replace").decode()
