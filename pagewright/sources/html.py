"""HTML to Markdown with the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without text of the page, and elements that stand on lines of their own.
DROPPED = frozenset("script style noscript iframe template head".split())
BLOCKS = frozenset("p div section article header footer main nav aside ul ol table blockquote pre h1 h2 h3 h4 h5 h6 figure form dl dt dd hr address fieldset".split())
VOID = frozenset("br hr img input meta link col area base embed source track wbr".split())


class _Converter(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.dropped = 0
        self.in_title = False
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.pre = 0
        self.quote = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def _write(self, t: str) -> None:
        (self.cell if self.cell is not None else self.out).append(t)

    def _break(self, n: int = 2) -> None:
        if self.cell is None:
            self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = not self.title
        elif tag == "body":
            self.dropped = 0
        elif tag in DROPPED:
            self.dropped += tag not in VOID
        if self.dropped or self.in_title:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._break()
            self._write("#" * int(tag[1]) + " ")
        elif tag == "br":
            self._write("\n" if self.cell is None else " ")
        elif tag == "hr":
            self._write("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self._write("**")
        elif tag in ("i", "em"):
            self._write("*")
        elif tag == "code" and not self.pre:
            self._write("`")
        elif tag == "pre":
            self.pre += 1
            self._write("\n\n```\n")
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._break(1)
            self._write("  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.links.append(a.get("href"))
            if a.get("href"):
                self._write("[")
        elif tag == "img":
            self._write(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "blockquote":
            self._break()
            self._write("> ")
        elif tag == "table":
            self._end_table()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self._end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self._end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag in BLOCKS:
            self._break()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
            return
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        if tag in ("b", "strong"):
            self._write("**")
        elif tag in ("i", "em"):
            self._write("*")
        elif tag == "code" and not self.pre:
            self._write("`")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self._write("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag == "a" and self.links:
            if href := self.links.pop():
                self._write(f"]({href})")
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "table":
            self._end_table()
        elif tag in BLOCKS:
            self._break()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.dropped:
            self._write(data if self.pre else re.sub(r"\s+", " ", data))

    def _end_cell(self) -> None:
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
        self.cell = None

    def _end_table(self) -> None:
        self._end_cell()
        rows = [r for r in self.rows or [] if r]
        self.rows = None
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            self.out.append("\n\n" + "\n".join(lines) + "\n\n")


def to_markdown(text: str) -> tuple[str | None, str]:
    """(title, Markdown); unclosed elements end with the text."""
    p = _Converter()
    p.feed(text)
    p.close()
    p._end_table()
    title = "".join(p.title).strip() if p.title else None
    parts = re.split(r"(\n```\n.*?\n```\n)", "".join(p.out), flags=re.S)
    for i in range(0, len(parts), 2):
        t = re.sub(r"[ \t]*\n[ \t]*(?![ \t]*(?:- |\d+\. ))", "\n", parts[i])
        parts[i] = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S) {2,}", " ", t))
    return title, "".join(parts).strip()
