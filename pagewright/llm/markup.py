"""Problem 7: markup residue turned into clean text that keeps its structure.

HTML, Markdown, wiki and LaTeX marks become plain Markdown-like text: headings (#), list items (-), table rows (|),
fenced code and formulas ($) stay, everything else is unwrapped. Blocks are classified in two passes: marks that nothing
else looks like, stop-word density, length and link density decide good blocks, link lists and junk; short ones that stay
open inherit the label of the nearest decided neighbours, a bad one only if all of these agree. Weak marks (single signs)
in junk are chance and don't count; link lists and navigation are left out of the clean text.

Defined results: null gives null; empty and blank texts come out empty; a text without marks comes out as it is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import blocks
from pagewright.tables import table

# HTML element names that count as marks.
ELEMENTS = (
    "a|abbr|article|aside|b|big|blockquote|body|br|button|center|cite|code|col|colgroup|dd|div|dl|dt|em|figure|figcaption|font|footer|form"
    "|h[1-6]|head|header|hr|html|i|iframe|img|input|kbd|label|li|link|main|mark|math|meta|nav|nowiki|noscript|ol|option|p|pre|q|ref|references|s"
    "|samp|script|section|select|small|source|span|strike|strong|style|sub|sup|svg|table|tbody|td|template|textarea|tfoot|th|thead|title|tr|tt|u"
    "|ul|var|video"
)
TAG = rf"</?(?:{ELEMENTS})(?:\s[^<>]*)?/?>|<!--|<!doctype\b"
ENTITY = r"&(?:#\d{2,6}|#x[0-9a-f]{2,5}|[a-z]{2,8}\d{0,2});"
MARKDOWN = (
    r"^ {0,3}#{1,6} +\S|\*\*[^\s*][^*]*\*\*|(?<![\w*])\*[^\s*][^*\n]*[^\s*]\*(?![\w*])|(?<![\w_])_[^\W_][^_\n]*_(?![\w_])|__[^\W_][^_\n]*__|~~[^~\n]+~~"
    r"|`[^`\n]+`|^ {0,3}```|^ {0,3}> ?[^\W\d]|^ {0,3}> ?[\"'«“„*_\[(]|!?\[[^\]\n]*\]\([^)\s]+\)|^ {0,3}\|(?: ?:?-{2,}:? ?\|)+|^ {0,3}\|[^\n|]+\|(?:[^\n|]*\|)+ *$"
)
WIKI = r"'''?[^\s'][^'\n]*'''?|\[\[[^\]\n]+\]\]|\{\{[^}\n]+\}\}|^ *={2,6} *[^=\n]+? *={2,6} *$|^\{\||^\|[-}]"
LATEX = (
    r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:begin|end|item|par|noindent|maketitle|frac|left|right|leq|geq|times|cdot|alpha|beta|sum|int|sqrt|infty|ldots|dots|newline|hline)\b"
    r"|\\[\[\]()]|\\[\"'`^~=.]\{?[a-zA-Z]|\\[cuvHk]\{|\$[^$\n]*[\\^_{][^$\n]*\$|\$\$|~\\"
)
#: Any mark; what looks like plain typing (bullets, numbers in brackets, prices, comparisons) isn't among them.
MARK = re.compile(f"{TAG}|{ENTITY}|{MARKDOWN}|{WIKI}|{LATEX}", re.I | re.M)
#: Marks that nothing else looks like; the others are weak.
STRONG = re.compile(rf"{TAG}|{ENTITY}|!?\[[^\]\n]*\]\([^)\s]+\)|^ {{0,3}}\|(?: ?:?-{{2,}}:? ?\|)+|\[\[[^\]\n]+\]\]|\{{\{{[^}}\n]+\}}\}}|^ *={{2,6}} *[^=\n]+? *={{2,6}} *$|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{{", re.I | re.M)
_QUICK = re.compile(r"[<&*_~`\[{\\$|]|''|==|^ {0,3}[#>]", re.M)

_NAMED = re.compile(ENTITY, re.I)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_LINKED = re.compile(r"\x02(.*?)\x03|<a\b[^>]*>(.*?)</a\s*>|\[([^\]\n]+)\]\([^)\s]+\)|\[\[(?:[^\]|\n]*\|)?([^\]|\n]+)\]\]", re.I | re.S)
_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.I | re.S)
_DROP = re.compile(r"<(script|style|noscript|template|head|nav)\b.*?</\1\s*>|<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref\s*>", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.I | re.S)
_ANY_TAG = re.compile(rf"</?(?:{ELEMENTS})(?:\s[^<>]*)?/?>|<!doctype[^>]*>", re.I)
# LaTeX accents and the combining marks that they stand for.
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "c": "̧", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "k": "̨"}


class Cleaned(NamedTuple):
    text: str
    n_marks: int
    n_dropped: int


def count_marks(text: str | None) -> int:
    """The marks of a text but weak ones in junk; entities must be named in HTML."""
    if not text or not _QUICK.search(text):
        return 0
    places = [m.start() for m in MARK.finditer(text) if m.group()[0] != "&" or html.unescape(m.group()) != m.group()]
    if not places:
        return 0
    cuts = [m.end() for m in _BLANK_LINE.finditer(text)]
    labels = label_blocks([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
    return sum(labels[bisect_right(cuts, p)] != "junk" for p in places)


def has_marks(text: str | None) -> bool:
    return count_marks(text) > 0


def _accent(m: re.Match) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", m.group(2) + ACCENTS[m.group(1)])


def _from_html(t: str) -> str:
    t = _DROP.sub("", t)
    t = _HEADING.sub(lambda m: f"\n\n{'#' * int(m.group(1))} {' '.join(m.group(2).split())}\n\n", t)
    t = _LINK.sub(lambda m: f"\x02{m.group(1)}\x03", t)
    t = re.sub(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", lambda m: f"\n\n```\n{m.group(1).strip()}\n```\n\n", t, flags=re.I | re.S)
    t = re.sub(r"<li\b[^>]*>\s*", "\n- ", t, flags=re.I)
    t = re.sub(r"<tr\b[^>]*>\s*", "\n| ", t, flags=re.I)
    t = re.sub(r"\s*</t[dh]\s*>\s*", " | ", t, flags=re.I)
    t = re.sub(r"<(?:p|div|blockquote|article|section|ul|ol|table|dl|main|header|footer)\b[^>]*>|</(?:p|div|blockquote|article|section|ul|ol|table|dl|main|header|footer)\s*>", "\n\n", t, flags=re.I)
    t = re.sub(r"<(?:br|hr)\b[^>]*>", "\n", t, flags=re.I)
    return _ANY_TAG.sub("", t)


def _from_latex(t: str) -> str:
    levels = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
    t = re.sub(r"\\([\"'`^~=.])\{?([a-zA-Z])\}?|\\([cuvHk])\{([a-zA-Z])\}", lambda m: _accent(re.match(r"(.)(.)", (m.group(1) or m.group(3)) + (m.group(2) or m.group(4)))), t)
    t = re.sub(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{([^{}]*)\}", lambda m: f"\n\n{'#' * levels[m.group(1)]} {m.group(2)}\n\n", t)
    t = re.sub(r"\\\[\s*(.*?)\s*\\\]", lambda m: f"\n$${m.group(1)}$$\n", t, flags=re.S)
    t = re.sub(r"\\\(\s*(.*?)\s*\\\)", r"$\1$", t, flags=re.S)
    t = re.sub(r"~?\\(?:cite|label|ref|footnote|index|citep|citet)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:begin|end)\{(?:verbatim|lstlisting)\}", "\n```\n", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?\s*", lambda m: "\n- " + (m.group(1) or ""), t)
    for _ in range(3):
        t = re.sub(r"\\(?:emph|text[a-z]*|underline|mbox|hbox|url|href|small|large|uline)\*?\{([^{}]*)\}", r"\1", t)
    return t


def _from_wiki(t: str) -> str:
    t = re.sub(r"(?m)^ *(={2,6}) *([^=\n]+?) *={2,6} *$", lambda m: f"\n{'#' * len(m.group(1))} {m.group(2)}\n", t)
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]+)\]\]", "\x02\\1\x03", t)
    t = re.sub(r"'''?([^'\n]+)'''?", r"\1", t)
    if "{|" in t:
        t = re.sub(r"(?m)^\{\|.*$|^\|\}.*$|^\|-.*$", "", t)
        t = re.sub(r"(?m)^[|!] ?(.*(?:\|\||!!).*)$", lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)) + " |", t)
    return t


def _from_markdown(t: str) -> str:
    t = re.sub(r"!\[([^\]\n]*)\]\([^)\s]+\)", r"\1", t)
    t = re.sub(r"\[([^\]\n]+)\]\([^)\s]+\)", "\x02\\1\x03", t)
    t = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", t, flags=re.S)
    t = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])", r"\1", t)
    t = re.sub(r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", r"\1", t)
    t = re.sub(r"~~([^~\n]+)~~", r"\1", t)
    t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", t)
    return re.sub(r"(?m)^ {0,3}> ?(?=[^\W\d]|[\"'«“„(])", "", t)


def first_label(block: str) -> str:
    """good, bad (links), junk or short, by the block alone. Links are HTML, Markdown or wiki ones, or stand between \\x02 and \\x03."""
    linked = sum(len(next(filter(None, x))) for x in _LINKED.findall(block))
    plain = MARK.sub(" ", block).replace("\x02", "").replace("\x03", "").strip()
    words = blocks.WORD.findall(plain)
    share = blocks.stop_share(words)
    letters = sum(map(len, words))
    if linked > 0.5 * max(1, len(plain)):
        return "bad"
    if STRONG.search(block) or re.match(r"\s*(?:#{1,6} \w|```|\| |\$\S|- \w)", block):
        return "good"
    if letters * 2 < len("".join(plain.split())) or words and max(map(len, words)) > 34:
        return "junk"
    if len(plain) >= 70 and share >= 0.15:
        return "good"
    if len(plain) >= 200:
        return "good" if share >= 0.05 or linked == 0 else "bad"
    return "short"


def label_blocks(parts: list[str]) -> list[str]:
    """good, bad or junk for each block: short ones take what all of their nearest decided neighbours are, good where these differ or are none."""
    kinds = [first_label(p) for p in parts]
    out = []
    for i, k in enumerate(kinds):
        if k == "short":
            near = {next((x for x in side if x != "short"), None) for side in (reversed(kinds[:i]), kinds[i + 1 :])} - {None}
            k = near.pop() if len(near) == 1 else "good"
        out.append(k)
    return out


def clean(text: str | None) -> Cleaned | None:
    """The text without its marks."""
    if text is None:
        return None
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    n = count_marks(t)
    if not n:
        return Cleaned("" if t.isspace() else text, 0, 0)
    if "&" in t:
        t = _NAMED.sub(lambda m: html.unescape(m.group()), t)
    fences = re.split(r"(?ms)(^ {0,3}```.*?^ {0,3}```[^\n]*$)", t)
    for i in range(0, len(fences), 2):
        fences[i] = _from_markdown(_from_wiki(_from_latex(_from_html(fences[i])))) if fences[i] else ""
    t = "".join(fences)
    parts = [p.strip("\n") for p in re.split(r"\n[ \t]*\n\s*", t) if p.strip()]
    keep = [k != "bad" for k in label_blocks(parts)]
    out = "\n\n".join(re.sub(r"[ \t]+(?=\n|$)", "", p) for p, k in zip(parts, keep) if k)
    return Cleaned(out.replace("\x02", "").replace("\x03", ""), n, keep.count(False))


def marked_rows(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """keys, clean text, number of marks and of left-out blocks for the rows that hold markup.

    No shuffle; null, empty and blank texts give no row; a row given twice comes out twice.
    """
    kept = df.select(*keys, F.col(text).alias("text")).where("text is not null")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", clean string, n_marks int, n_dropped int"

    def run(batches):
        for b in batches:
            got = [(k, c) for k, c in enumerate(map(clean, b["text"])) if c.n_marks]
            if got:
                out = b[list(keys)].iloc[[k for k, _ in got]].reset_index(drop=True)
                yield pd.concat([out, pd.DataFrame([c for _, c in got], columns=["clean", "n_marks", "n_dropped"])], axis=1)

    return kept.mapInPandas(run, schema)


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, clean, n_marks, n_dropped) of the sections whose content holds markup, once each."""
    return marked_rows(table(spark, folder, "sections")).dropDuplicates(["doc_id", "pos"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos) of the sections whose content holds markup."""
    return marked_rows(table(spark, folder, "sections")).select("doc_id", "pos").distinct()
