"""Lines of a section sorted into sentences, headings, list items, table rows and junk.

Pure Python over one text at a time, shared by language segments (p1), quality statistics (p5)
and markup conversion (p7). Empty and null texts give no blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from typing import NamedTuple

# Frequent function words of the five languages, as in the table common_words.
FUNCTION_WORDS = frozenset(
    """
    der die das den dem des ein eine einer und oder aber nicht noch ist sind war wird werden wurde zu zur zum im in am
    an auf aus bei mit nach von vor für über wie was weil wenn da sich es auch
    the a an of to in on at by for with from and or but not no is are was were be been has had have it its this that
    these which who so as if while when since than then their they will must
    el la los las de del un una y o pero no ya es son está se que en por para con sin sobre al a lo su sus este esta
    como más cuando donde mientras aunque porque desde hasta según cada ha
    le la les de du des un une et à au aux en dans par pour sur avec sans ce cette ces qui que dont où ne pas plus est
    sont a été il elle on se sa son ses leur même si mais ou car comme
    il lo la i gli le di del della dei delle un una e o ma non più è sono si che in nel per con su da dal al alla come
    anche se quando dove mentre perché ogni questo questa suo ha resta dopo prima
    """.split()
)

WORD = re.compile(r"[^\W\d_]+")
BULLET = re.compile(r"\s*(?:[•*\-–—·▪◦#:;+]+\s|\(?[0-9a-zA-Z]{1,3}[.)]\s|\\item\b|<li\b|&bull;)")
LEADERS = re.compile(r"(?:\.{3,}|\s\.\s\.|…|\s{3,}|\t)\s*\d{1,4}\s*$")
REFERENCE = re.compile(r"\s*(?:\[?\d{1,3}[\].)]\s*)?\W?[^\W\d_][\w'’\-. ]{1,40}[.,:(].*\b(?:1[89]|20)\d\d\W*(?:$|[a-z]?[).;,])")
PAGE_LINE = re.compile(r"\W*(?:(?:page|p|pag|seite|página|pagina|s)\b\.?)?\s*\d{1,4}\s*(?:(?:/|of|sur|von|de|di|-)\s*\d{1,4})?\W*$", re.I)
END = re.compile(r"[.!?][\"'»”“’)\]*_}]*\s*(?:<[^>]*>|\{\{[^}]*\}\}|~?\\cite\{[^}]*\}|\(\S{2,15}\)|\[\d+\])*\s*$")
BREAK = re.compile(r"(?<=[.!?])[\"'»”’)\]*_}]*(?:<[^>\n]{1,60}>|~?\\cite\{[^}]*\})*\s+(?=[\"'«“„(\[*_\\{<¿¡ÂÃâ]*[A-ZÀ-ÞŒ])")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
SPACE_BREAK = re.compile(r" (?:(?<=[.!?] )|(?<=[.!?][\"'»”’)\]*_}] ))(?=\s*[\"'«“„(\[*_{<¿¡ÂÃâ]*[A-ZÀ-ÞŒ])")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|<!--.*?-->", re.S)
CELLS = re.compile(r"\||;|\t| {3,}|,(?=\S)|,$")
PLAIN = re.compile(r"[A-Za-zÀ-ɏ][^|;\t\d{}<>\\=+/@^~*_%:•]*$")
CODE = re.compile(r"[A-Za-z]{1,12}-?\d[\w.,/:-]*|\d[\w.,/:-]*|n/a")


BLOCK_TAG = re.compile(r"<(/?)(p|div|h[1-6]|ul|ol|table|pre|blockquote|section|article|li|tr|td|th|br)\b[^<>\n]{0,200}>", re.I)


def _line_mark(m: re.Match) -> str:
    """What an element that stands on a line of its own leaves behind."""
    closing, name = m.group(1), m.group(2).lower()
    if name in ("td", "th"):
        return " | "
    if name == "br":
        return "\n"
    return "\n" if closing else "\n- " if name == "li" else "\n| " if name == "tr" else "\n\n"


class Block(NamedTuple):
    """kind: prose, title, item, cells, toc, reference, page or junk; text in one line."""

    kind: str
    text: str


def words(text: str) -> list[str]:
    return WORD.findall(text)


def stop_share(ws: list[str]) -> float:
    """Share of function words; 0 for no words."""
    return sum(map(FUNCTION_WORDS.__contains__, map(str.lower, ws))) / len(ws) if ws else 0.0


def line_kind(line: str) -> str:
    """The kind that a line shows by itself; 'text' leaves it to its neighbours."""
    s = line.strip()
    if s[0].isalpha() and "   " not in s and s.count(" ") > 2 and (len(s) > 160 and s[-1] in ".!?»”" and "|" not in s or PLAIN.match(s)):
        return "text"
    ws = WORD.findall(s)
    if PAGE_LINE.match(s):
        return "page"
    letters = sum(map(len, ws))
    if s.startswith("|") or s.startswith("{|") or s.startswith("|-"):
        return "cells"
    n_cells = len(CELLS.findall(s))
    if n_cells >= 2 and (len(s) - letters) * 10 > len(s) * 3 and stop_share(ws) < 0.15:
        return "cells"
    if n_cells >= 1 and len(CODE.findall(s)) >= 2 and stop_share(ws) < 0.1:
        return "cells"
    if LEADERS.search(s):
        return "toc"
    if letters * 2 < len(s.replace(" ", "")):
        return "junk"
    if len(s) <= 160 and REFERENCE.match(s) and stop_share(ws) < 0.5:
        return "reference"
    if BULLET.match(line):
        return "sentence item" if END.search(s) and len(ws) >= 6 else "item"
    if len(s) > 30 and not ws or (ws and max(map(len, ws)) > 34):
        return "junk"
    return "text"


def split_sentences(text: str) -> list[str]:
    """Splits running text after . ! ? where a capital follows; the longer expression is for citations and doubled signs."""
    parts = BREAK.split(text) if "\\" in text else SPACE_BREAK.split(text)
    return [x for x in parts if x and not x.isspace()]


def sentence_words(s: str) -> list[str] | None:
    """The words, in small letters, of a sentence in its own right: a capital, an end and words that hold it together; None for others."""
    if s[-1:] not in (".", "!", "?") and not END.search(s, max(0, len(s) - 80)):
        return None
    ws = WORD.findall(s.lower())
    if len(ws) < 4 or sum(map(FUNCTION_WORDS.__contains__, ws)) < 0.12 * len(ws) or not WORD.search(s).group()[0].isupper():
        return None
    return ws


def is_sentence(s: str) -> bool:
    return sentence_words(s) is not None


def join_lines(lines: list[str]) -> str:
    """Joins lines, healing words broken by a hyphen."""
    out = lines[0].strip()
    for line in lines[1:]:
        line = line.strip()
        if out and out[-1] in "-¬=\xad" and line[:1].islower() and out[-2:-1].isalpha():
            out = out[:-1] + line
        else:
            out += " " + line
    return out


def parse(content: str | None) -> list[Block]:
    """The blocks of a text in order. Text lines in a row form one block, which is prose if it holds sentences."""
    if not content or content.isspace():
        return []
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", BLOCK_TAG.sub(_line_mark, text))
    blocks: list[Block] = []
    run: list[str] = []

    def flush() -> None:
        if not run:
            return
        joined = join_lines(run)
        ws = WORD.findall(joined)
        ended = len(re.findall(r"[.!?](?:\W|$)", joined))
        share = stop_share(ws)
        wide = len(run) == 1 or sum(len(x) for x in run[:-1]) / (len(run) - 1) > 38
        if ended and len(ws) >= 5 and share >= 0.12 and len(ws) / ended <= 60:
            blocks.append(Block("prose", joined))
        elif not ended and len(ws) >= 8 and share >= 0.2 and wide:
            blocks.append(Block("prose", joined))
        elif len(run) == 1 and len(ws) <= 12 and joined[:1].isupper():
            blocks.append(Block("title", joined))
        elif len(ws) >= 2 and share >= 0.12 and len(run) == 1:
            blocks.append(Block("prose" if len(ws) >= 3 and not joined[:1].isupper() else "title", joined))
        else:
            blocks.append(Block("junk", joined))
        run.clear()

    for line in text.split("\n"):
        if not line.strip():
            flush()
            continue
        kind = line_kind(line)
        if kind == "text":
            run.append(line)
        elif run and kind in ("item", "reference", "sentence item", "toc") and (line[0] in "—–-" or kind == "reference") and not END.search(run[-1]) and len(run[-1]) > 30:
            run.append(line)
        elif kind == "sentence item":
            flush()
            blocks.append(Block("prose", line.strip()))
        elif kind == "page" and run and not END.search(run[-1]):
            continue
        else:
            flush()
            blocks.append(Block(kind, line.strip()))
    flush()
    return blocks


def prose_share(blocks: list[Block]) -> float:
    """Characters in sentences against all characters but page numbers; 1 where there are none."""
    of = {True: 0, False: 0}
    for b in blocks:
        if b.kind != "page":
            of[b.kind == "prose"] += len(b.text)
    total = of[True] + of[False]
    return of[True] / total if total else 1.0
