"""Problem 3: noise in text from scanned pages.

Words are decoded over the character stream without line ends. A lexicon of the corpus's own words gives each
reading its cost; the decoder may join the halves of a word over a hyphen and line end, drop a space inside a word, set one
between two words, and replace confused characters. Paragraph boundaries between the decoded lines are chosen by
dynamic programming. Running titles are lines that recur as first or last line of three or more sections of a
document, apart from wording, case, page number and misread letters, however long the document is, if the three stand
within SPAN sections; so a document is read in windows, none of which grows with it. Page numbers are lines of their own.

Defined results: null gives null; empty and blank texts come out empty and are no case; each (doc_id, pos) counts
once; a document of fewer than three sections has no running title.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import blocks, encoding, forms
from pagewright.tables import table

#: A word belongs to the lexicon from this share of all words on, which bounds the lexicon by 1 / SHARE words. As a share it
#: asks of a word to be as frequent in a large corpus as in a small one, so that misreadings, which grow with it, stay out.
SHARE, LEAST = 2e-6, 3
CONFUSED, NO_LETTER, UNKNOWN, HYPHEN, MERGE, SPLIT = 4.0, 6.0, 2.0, 1.0, 3.0, 3.0
# What scanners read for what stood there.
CONFUSIONS = {
    "0": ("o",), "1": ("l", "i"), "5": ("s",), "6": ("é", "b"), "8": ("b",), "9": ("g",), "@": ("a",), "!": ("i", "l"), "|": ("l", "i"), "$": ("s",),
    "rn": ("m",), "ri": ("n",), "ii": ("u",), "cl": ("d",), "li": ("h",), "vv": ("w",), "c": ("e",), "f": ("t",), "i": ("l",), "l": ("i",),
    "m": ("rn",), "h": ("b",), "e": ("c",), "t": ("f",),
}
DIGITS = "015689@!|$"
WORD = re.compile(r"[^\W\d_]+")
_SIGN = f"[{re.escape(DIGITS)}]"
#: A sign between letters, or before three small ones at the start of a word.
SIGNED = re.compile(rf"{_SIGN}(?<=[^\W\d_].)(?=[^\W\d_])|{_SIGN}(?<![\w.,/@-].)(?=[a-zß-ÿ]{{3}})")
#: A word between blanks or usual punctuation, with signs that may stand for letters inside; not the rest of a broken word.
TOKEN = re.compile(r"(?:(?<=[\s(«“„\"'’/—*>])(?<![-¬=�]\n)(?<![-¬=�][ \r]\n)|\A)[^\W_@!|$][^\W_@!|$]*(?:[@!|$][^\W\d_]+)*(?=[\s.,;:?)»”\"'’*<]|\Z)")
BREAK = re.compile(r"[-¬=\xad‐�](?:(?<=[^\W\d_].)|(?<=[^\W\d_]┬.))¨? ?\r?\n\s*(?=[a-zß-ÿœ])")
PAGE = re.compile(
    r"[-—–\s|*\[(]*(?:(?:page|pag|pág|p|seite|s|página|pagina|blatt)\b\.?\s*)?(?:(\d{1,4})|([ivxl]{1,6}))(?:\s*(?:/|of|sur|von|de|di)\s*(\d{1,4}))?[-—–\s|*\])]*$", re.I
)
#: A page number's line has no more plain letters than its words have.
_FEW_LETTERS = re.compile(r"[^A-Za-z]*+(?:[A-Za-z][^A-Za-z]*+){0,20}+\Z")
_PAGE_ENDS = frozenset("0123456789ivxlIVXL-—–|*]) \t")
_TAIL = re.compile(r"[\s|·—–-]*(?:(?:page|pag|pág|p|seite|s)\b\.?)?[\s|·/—–-]*\d{1,4}\s*(?:/\s*\d{1,4})?\s*$", re.I)
_HEAD = re.compile(r"^\s*(?:(?:page|p|seite)\b\.?)?\s*\d{1,4}\s*[|·—–-]\s*|^\s*\d{1,4}\s{2,}", re.I)


class Lexicon:
    """Words with counts, compounds that are written with a hyphen, and the number of all words."""

    def __init__(self, counts: dict[str, int], compounds: frozenset[str], total: int):
        self.counts, self.compounds, self.total = counts, compounds, max(1, total)
        self.unknown = math.log(2 * self.total) + UNKNOWN
        #: Words so frequent that no other can stand behind them.
        self.usual = frozenset(w for w, n in counts.items() if n > self.total * 1e-4)
        #: A reading is at most so much shorter than its token, so longer tokens stand for no word of the lexicon.
        self.longest = max(map(len, counts), default=0) + 2
        self._memo: dict[str, tuple[str, float, bool]] = {}

    def cost(self, word: str) -> float | None:
        n = self.counts.get(word)
        return None if n is None else math.log(self.total / n)

    def readings(self, token: str, most: int = 2) -> dict[str, int]:
        """What may have stood there: the token with up to that many confusions undone."""
        found = {token: 0}
        edge = [token]
        for k in range(1, most + 1):
            new = []
            for t in edge:
                for i in range(len(t)):
                    for size in (1, 2):
                        for true in CONFUSIONS.get(t[i : i + size], ()):
                            r = t[:i] + true + t[i + size :]
                            if len(t[i : i + size]) == size and r not in found:
                                found[r] = k
                                new.append(r)
            edge = new
        return found

    def read(self, token: str) -> tuple[str, float, bool]:
        """Best reading of one token in small letters, its cost, and whether characters were replaced; the memo is bounded."""
        got = self._memo.get(token)
        if got is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            got = self._memo[token] = self._read(token)
        return got

    def _read(self, token: str) -> tuple[str, float, bool]:
        signed = not token.isalpha()
        own = self.cost(token)
        best = (token, (self.unknown if own is None else own) + NO_LETTER * signed, False)
        if len(token) < 4 or len(token) > self.longest or own is not None and own < 9:
            return best
        for r, k in self.readings(token, 2 if signed or len(token) > 6 else 1).items():
            if k and r.isalpha():
                c = self.cost(r)
                c = (self.unknown + 1 if c is None else c) + CONFUSED * k
                if (c < best[1] if signed else c < best[1] and r in self.counts):
                    best = (r, c, True)
        return best

    def decode(self, pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Segments a stream of (characters, separator) pieces into words: Viterbi over the pieces.

        A word spans one piece, or two over a hyphen and line end ('-'), a blank (' ') or a line end ('\n'); a piece may also be two words. Gives
        (word, operations), operations out of h (hyphen), m (merge), s (split), c (confusion).
        """
        n = len(pieces)
        best: list[tuple[float, list[tuple[str, str]]]] = [(0.0, [])] + [(math.inf, [])] * n
        for i in range(n):
            base, so_far = best[i]
            if base == math.inf:
                continue
            text, sep = pieces[i]
            w, c, changed = self.read(text)
            options = [(c, [(w, "c" if changed else "")], i + 1)]
            if len(text) >= 6 and self.cost(text) is None:
                for k in range(2, len(text) - 1):
                    a, b = self.cost(text[:k]), self.cost(text[k:])
                    if a is not None and b is not None:
                        options.append((a + b + SPLIT, [(text[:k], "s"), (text[k:], "")], i + 1))
            if i + 1 < n and sep and sep in "- \n":
                w, c, changed = self.read(text + pieces[i + 1][0])
                known = w in self.counts
                if sep == "-":
                    # Halves that no lexicon knows stay together too, unless they are a compound of their own.
                    if f"{text}-{pieces[i + 1][0]}" not in self.compounds:
                        options.append((c + HYPHEN - (0 if known else 4), [(w, "hc" if changed else "h")], i + 2))
                elif known and (self.cost(text) is None or self.cost(pieces[i + 1][0]) is None):
                    options.append((c + MERGE, [(w, "mc" if changed else "m")], i + 2))
            for cost, words, j in options:
                if base + cost < best[j][0]:
                    best[j] = (base + cost, so_far + words)
        return best[n][1]


def plain(text: str) -> str:
    """The text with garbled characters repaired (p2) and odd forms made consistent (p4), as those aren't matters of scanning."""
    if not text.isascii():
        text = encoding.repair(text)[0]
        if forms.may_change(text):
            text = text.replace("\xad\n", "¬\n")
            text = forms.consistent(text)
    return text


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\r", "\n").split("\n") if x.strip()]


def page_line(line: str) -> bool:
    m = PAGE.match(line) if line[-1:] in _PAGE_ENDS else None
    if not m:
        return False
    return not (m.group(1) and m.group(3) and int(m.group(1)) > int(m.group(3)))


def has_page_line(lines: list[str]) -> bool:
    """Whether a page number stands on a line of its own in a text that has others: among the two first or two last lines, or
    further in between lines that belong to no list, table or junk."""
    if len(lines) < 2:
        return False
    for i, x in enumerate(lines):
        if page_line(x) if x.isascii() else _FEW_LETTERS.match(x) and page_line(plain(x)):
            if i < 2 or i >= len(lines) - 2 or all(blocks.line_kind(lines[k]) in ("text", "page") for k in (i - 1, i + 1)):
                return True
    return False


def halves(text: str, m: re.Match) -> tuple[str, str]:
    """The letters before and after a break."""
    end = m.start() - (text[m.start() - 1] == "┬")
    i = end
    while i and text[i - 1].isalpha():
        i -= 1
    return text[i:end], WORD.match(text, m.end()).group()


_GAP = r"(?:(?P<hyphen>┬?[-¬=\xad‐]¨? ?\r?\n\s*(?=[a-zß-ÿœ]))|(?P<blank> +)|(?P<line>[ \t]*\r?\n[ \t]*))"
_RIGHT = re.compile(_GAP + r"(?P<word>[^\W\d_]+)(?![\w@!|$])")
_LEFT = re.compile(r"(?<![\w@!|$'’])(?P<word>[^\W\d_]+)" + _GAP + r"\Z")
_SEPARATORS = {"hyphen": "-", "blank": " ", "line": "\n"}


def lowered(text: str) -> str:
    """The text in small letters, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def stream_operations(text: str, lexicon: Lexicon, words: set[str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, words, operations) where decoding the stream of a text joins, splits or changes pieces.

    Between two words of the lexicon without a hyphen nothing is joined, so the stream falls apart there: decoding each
    run of other pieces with one known neighbour on either side gives what decoding the whole text gives. A line end in
    a joined word is told by n among the operations. words are those of the text in small letters, if they are known.
    """
    low = lowered(text)
    counts = lexicon.counts
    out, at = [], {}
    for w in (set(WORD.findall(low)) if words is None else words).difference(counts):
        i = low.find(w)
        while i >= 0:
            j = i + len(w)
            if not (i and (low[i - 1].isalnum() or low[i - 1] in "_@!|$")) and not (j < len(low) and (low[j].isalnum() or low[j] in "_@!|$")):
                at[i] = j
            i = low.find(w, j)
    done = -1
    for i in sorted(at):
        if i < done:
            continue
        spans, seps = [(i, at[i])], []
        m = _LEFT.search(low, max(0, i - lexicon.longest - 4), i)
        if m and m.start() >= done:
            spans.insert(0, m.span("word"))
            seps.append(_SEPARATORS[m.lastgroup])
        while spans[-1][0] in at:
            m = _RIGHT.match(low, spans[-1][1])
            if not m:
                break
            seps.append(next(_SEPARATORS[k] for k in _SEPARATORS if m.group(k) is not None))
            spans.append(m.span("word"))
        done = spans[-1][1] if spans[-1][0] in at else spans[-1][0]
        k = 0
        for word, ops in lexicon.decode([(low[a:b], sep) for (a, b), sep in zip(spans, [*seps, ""])]):
            if "s" in ops:
                out.append((*spans[k], word, "s"))
                continue
            if out and out[-1][3] == "s" and out[-1][:2] == spans[k]:
                out[-1] = (*spans[k], f"{out[-1][2]} {word}", "split")
            elif ops and ops != "c":
                out.append((spans[k][0], spans[k + 1][1], word, ops + "n" * (seps[k] == "\n")))
                k += 1
            k += 1
    return out


def has_break(text: str, lexicon: Lexicon) -> bool:
    """Whether decoding joins the halves of a word over a line end; a word may also be broken at the end of the text."""
    end = text.rstrip()
    if end[-1:] in ("-", "¬", "=") and end[-3:-1].isalpha() and end[-3:-1].islower():
        return True
    for m in BREAK.finditer(text):
        a, b = halves(text, m)
        if m.group()[0] == "�" and f"{a}{b}".lower() not in lexicon.counts:
            continue  # a letter may have been lost instead of the hyphen
        if any("h" in ops for _, ops in lexicon.decode([(a.lower(), "-"), (b.lower(), "")])):
            return True
    return False


def has_misread(text: str, lexicon: Lexicon, words: set[str] | None = None) -> bool:
    """Whether decoding replaces characters of a word; words as in stream_operations."""
    for m in SIGNED.finditer(text):
        i, j = m.start(), m.end()
        while i and not text[i - 1].isspace() and text[i - 1] not in "(«“„\"'’/—*>":
            i -= 1
        while j < len(text) and not text[j].isspace() and text[j] not in ".,;:?)»”\"'’*<":
            j += 1
        token = text[i:j]
        w = token.lower()
        if TOKEN.fullmatch(token) and len(w) >= 4 and not token[1:].isupper():
            got = lexicon.read(w)
            if got[2] and (got[0] in lexicon.counts or token == w or token.istitle()):
                return True
    for w in (set(WORD.findall(lowered(text))) if words is None else words) - lexicon.usual:
        if len(w) >= 4 and lexicon.read(w)[2]:
            for m in re.finditer(re.escape(w), text, re.I):
                if TOKEN.match(text, m.start()) and TOKEN.match(text, m.start()).end() == m.end():
                    return True
    return False


def outer_lines(text: str) -> list[tuple[int, str, str]]:
    """(0 first or 1 last, title key, the line beside it) of a text's outer lines that may be running titles."""
    lines = [x for x in lines_of(text) if not page_line(x)]
    out = []
    if len(lines) < 2:
        return out
    for place, line, beside in ((0, lines[0], lines[1]), (1, lines[-1], lines[-2])):
        if line[-1] in ".!?;" and not line[:-1].rstrip().isupper() and not re.search(r"\d\.$", line):
            continue
        if blocks.line_kind(line) not in ("text", "toc") or line[:1].islower() and not line[:2].isupper():
            continue
        key = title_key(line)
        if len(key) >= 8:
            out.append((place, key, beside))
    return out


def title_key(line: str) -> str:
    """A line in small letters without page number, codes and signs, confused characters mapped to one of each pair."""
    t = _HEAD.sub("", _TAIL.sub("", line)).lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w")):
        t = t.replace(a, b)
    t = t.translate(str.maketrans("015689@!|$cfiéèê", "olsegga1lsetleee".replace("1", "l")))
    return " ".join(WORD.findall(t))


def similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs."""
    x, y = _pairs(a), _pairs(b)
    return 2 * len(x & y) / max(1, len(x) + len(y))


@lru_cache(maxsize=20_000)
def _pairs(t: str) -> frozenset[tuple[str, int]]:
    """The letter pairs of a text, the second of a kind apart from the first."""
    seen: Counter = Counter()
    out = []
    for i in range(len(t) - 1):
        pair = t[i : i + 2]
        out.append((pair, seen[pair]))
        seen[pair] += 1
    return frozenset(out)


#: So many keys are few.
FEW = 64


class Alike:
    """Finds the keys of a document that are alike, without comparing all with all.

    Two keys of similarity ALIKE share so many pairs that each has one of them among its rarest, in numbers that follow from
    ALIKE (prefix filtering); only keys that share one there are compared, and none is missed. Few keys are compared at once,
    which gives the same and costs less than the lists.
    """

    def __init__(self, keys: list[str], few: int = FEW):
        self.all = len(keys) <= few
        if self.all:
            return
        often = Counter(p for k in keys for p in _pairs(k))
        self.prefix = {k: sorted(_pairs(k), key=lambda p: (often[p], p))[: len(_pairs(k)) - math.ceil(LEAST_SHARED * len(_pairs(k)) - 1e-9) + 1] for k in keys}
        self.holders: dict[tuple[str, int], list[str]] = {}
        for k in keys:
            for p in self.prefix[k]:
                self.holders.setdefault(p, []).append(k)

    def near(self, key: str, left: dict[str, int]) -> set[str]:
        candidates = left if self.all else {x for p in self.prefix[key] for x in self.holders[p] if x in left}
        return {x for x in candidates if similarity(key, x) >= ALIKE} | {key}


SEPARATOR = "\x1f"
ALIKE, RECURS = 0.72, 3
#: Windows of twice as many sections, each beginning so many after the one before, hold any sections that stand so near.
SPAN = 5000
#: The share of a key's pairs that any key alike has: ALIKE / 2 of both, of which the other has at least ALIKE / (2 - ALIKE) as many.
LEAST_SHARED = ALIKE / 2 * (1 + ALIKE / (2 - ALIKE))


def running_titles(rows: list[tuple[int, int, str, str]]) -> set[tuple[int, int]]:
    """(pos, place) of the running titles, given (pos, place, key, line beside it) of one document.

    Keys are grouped around the most frequent ones; a group whose neighbours recur as well is repeated text (p6).
    """
    found: set[tuple[int, int]] = set()
    if len({p for p, *_ in rows}) < RECURS:
        return found
    keys = Counter(k for _, _, k, _ in rows)
    by_key: dict[str, list[tuple[int, int, str, str]]] = {}
    for r in rows:
        by_key.setdefault(r[2], []).append(r)
    left, alike = dict(keys), Alike(list(keys))
    for k, _ in sorted(keys.items(), key=lambda x: (-x[1], x[0])):
        if k not in left:
            continue
        near = alike.near(k, left)
        own = [r for x in near for r in by_key[x]]
        if len({r[0] for r in own}) >= RECURS:
            beside = Counter(r[3] for r in own)
            if len(beside) * 2 > len(own):
                found |= {(r[0], r[1]) for r in own}
                for x in near:
                    left.pop(x, None)
                continue
        left.pop(k, None)
    return found


HYPHEN_INSIDE = re.compile(r"-(?<=[^\W\d_].)(?=[^\W\d_])")


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, n, hyphens): counts over every row; hyphens tells compounds. Counted in the workers first, then by shuffle."""

    def run(batches):
        for b in batches:
            words, compounds = Counter(), Counter()
            for t in b["text"]:
                t = t.lower()
                words.update(WORD.findall(t))
                if "-" in t:
                    for m in HYPHEN_INSIDE.finditer(t):
                        x, y = halves(t, m)
                        compounds[f"{x}-{y}"] += 1
            if words:
                yield pd.DataFrame({"word": [*words, *compounds], "n": [*words.values(), *compounds.values()]})

    part = df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text: str = "content", share: float = SHARE) -> Lexicon:
    """The words of all rows of df from a share of all words on: at most 1 / share words reach the driver."""
    counted = count_words(df, text).persist()
    total = counted.where("not contains(word, '-')").agg(F.sum("n")).first()[0] or 0
    kept = counted.where(F.col("n") >= max(LEAST, total * share)).collect()
    counted.unpersist()
    return Lexicon({r.word: r.n for r in kept if "-" not in r.word}, frozenset(r.word for r in kept if "-" in r.word), total)


def repair(text: str | None, lexicon: Lexicon, titles: frozenset[str] = frozenset()) -> str | None:
    """Continuous paragraphs: page numbers and running titles (by key) dropped, words decoded, lines joined."""
    if text is None:
        return None
    lines = [x.rstrip() for x in plain(text).replace("\r\n", "\n").split("\n")]
    kept = [x for x in lines if not page_line(x.strip()) or not x.strip()]
    kept = [x for x in kept if not x.strip() or title_key(x) not in titles]
    return "\n\n".join(paragraphs(kept, lexicon))


#: Costs: a paragraph's begin; a missing one at a blank line, within a sentence or not, at a short line that ends a sentence, before
#: a line of another kind; a paragraph that is nothing but a piece of a sentence.
BEGIN, AT_BLANK, WITHIN, AT_END, AT_KIND, PIECE = 3.0, 8.0, 5.0, 4.0, 6.0, 2.5


def begin_paragraphs(lines: list[str]) -> tuple[list[str], list[bool], float]:
    """(filled lines, which of them begin a paragraph, the cost) at least cost, by dynamic programming over the lines: each
    begins a paragraph or goes on, and what that costs hangs on what the line before does, as a piece of a sentence is hardly
    a paragraph of its own."""
    texts, blank_before, blank = [], [], True
    for x in map(str.strip, lines):
        if x:
            texts.append(x)
            blank_before.append(blank)
        blank = not x
    if not texts:
        return [], [], 0.0
    width = max(map(len, texts))
    ended = [x[-1] in ".!?:" for x in texts]
    low = [x[:1].islower() for x in texts]
    piece = [PIECE * (a and not e and blocks.line_kind(x) == "text") for x, a, e in zip(texts, low, ended)]
    best, back = [math.inf, BEGIN], []  # of going on, of beginning
    for k in range(1, len(texts)):
        a, b = texts[k - 1], texts[k]
        missing = (WITHIN if low[k] and not ended[k - 1] else AT_BLANK) * blank_before[k]
        missing += AT_END * (ended[k - 1] and (b[:1].isupper() or not b[:1].isalnum()) and len(a) < 0.7 * width)
        missing += AT_KIND * (not low[k] and blocks.line_kind(b) != "text")
        new = [best[0], best[1] + piece[k - 1]]
        back.append((int(best[1] < best[0]), int(new[1] < new[0])))
        best = [min(best) + missing, min(new) + BEGIN]
    begins = [best[1] + piece[-1] < best[0]]
    for told in reversed(back):
        begins.append(bool(told[begins[-1]]))
    return texts, begins[::-1], min(best[1] + piece[-1], best[0])


def paragraphs(lines: list[str], lexicon: Lexicon) -> list[str]:
    """The paragraphs of lines, each as continuous text."""
    groups: list[list[str]] = []
    for x, begin in zip(*begin_paragraphs(lines)[:2]):
        if begin or not groups:
            groups.append([])
        groups[-1].append(x)
    return [_flow(g, lexicon) for g in groups]


def _flow(lines: list[str], lexicon: Lexicon) -> str:
    text = "\n".join(lines)

    def join(m: re.Match) -> str:
        a, b = halves(text, m)
        got = lexicon.decode([(a.lower(), "-"), (b.lower(), "")])
        return "" if any("h" in ops for _, ops in got) else "-"

    text = BREAK.sub(join, text)
    for i, j, w, _ in reversed(stream_operations(text, lexicon)):
        old = text[i:j]
        text = text[:i] + (w.upper() if old.isupper() and len(old) > 1 else w[:1].upper() + w[1:] if old[:1].isupper() else w) + text[j:]
    text = text.replace("\n", " ")

    def word(m: re.Match) -> str:
        t = m.group()
        w, _, changed = lexicon.read(t.lower()) if t.isalpha() or SIGNED.search(t) else (t, 0.0, False)
        if not changed:
            return t
        return w.upper() if t.isupper() else w.capitalize() if t[:1].isupper() else w

    return TOKEN.sub(word, text)


def scan_noise(df: DataFrame, lexicon: Lexicon, text: str = "content", keys: tuple[str, str] = ("doc_id", "pos"), span: int = SPAN) -> DataFrame:
    """keys, broken, misread, page_number, running_title of the rows with any of them, once each; title_places is 1 for the
    first line, 2 for the last, 3 for both.

    Texts aren't shuffled; only the outer lines that may be titles are grouped, by windows of a document. The lexicon (at
    most 1 / SHARE words) is sent to the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.compounds, lexicon.total))
    doc, pos = keys
    kinds = f"doc {df.schema[doc].dataType.simpleString()}, pos {df.schema[pos].dataType.simpleString()}"
    rows = df.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(text).alias("text")).where("text is not null")

    def run(batches):
        lex = Lexicon(*shared.value)
        for b in batches:
            out = []
            for d, p, t in zip(b["doc"], b["pos"], b["text"]):
                if t.isspace() or not t:
                    continue
                lines = lines_of(t)
                words = set(WORD.findall(lowered(t)))
                joined = any("h" in o or "n" in o for *_, o in stream_operations(t, lex, words))
                flags = 4 * (joined or has_break(t, lex)) + 2 * has_misread(t, lex, words) + has_page_line(lines)
                outer = outer_lines(t)
                if flags or outer:
                    fields = [str(p), str(flags), *(x for place, key, beside in outer for x in (str(place), key, beside.replace(SEPARATOR, " ")))]
                    at = int(p // span)
                    out += [(d, w, SEPARATOR.join(fields)) for w in ((at - 1, at) if at > 0 else (at,))]
            if out:
                yield pd.DataFrame(out, columns=["doc", "window", "told"])

    told = rows.where("pos is not null").mapInPandas(run, kinds.split(",")[0] + ", window long, told string")
    listed = told.groupBy("doc", "window").agg(F.collect_set("told").alias("told"))

    def titles(batches):
        for b in batches:
            out = []
            for d, sections in zip(b["doc"], b["told"]):
                once = {int(f[0]): f[1:] for f in (x.split(SEPARATOR) for x in sorted(sections))}
                outer = {(p, int(f[k]), f[k + 1], f[k + 2]) for p, f in once.items() for k in range(1, len(f), 3)}
                titled = running_titles(sorted(outer))
                for p, f in once.items():
                    flags, places = int(f[0]), sum(1 << k for k in (0, 1) if (p, k) in titled)
                    if flags or places:
                        out.append((d, p, flags & 4 > 0, flags & 2 > 0, flags & 1 > 0, places > 0, places))
            if out:
                yield pd.DataFrame(out, columns=["doc", "pos", "broken", "misread", "page_number", "running_title", "title_places"])

    found = listed.mapInPandas(titles, kinds + ", broken boolean, misread boolean, page_number boolean, running_title boolean, title_places int")
    flags = [F.bool_or(c).alias(c) for c in ("broken", "misread", "page_number", "running_title")]
    found = found.groupBy("doc", "pos").agg(*flags, F.bit_or("title_places").alias("title_places"))  # a section may lie in two windows
    return found.withColumnRenamed("doc", doc).withColumnRenamed("pos", pos)


def repaired_rows(df: DataFrame, lexicon: Lexicon, text: str = "content", keys: tuple[str, str] = ("doc_id", "pos")) -> DataFrame:
    """keys, the flags of scan_noise (null where none) and the repaired text of every row, once each."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.compounds, lexicon.total))
    loaded: list[Lexicon] = []

    @F.pandas_udf("string")
    def repaired(texts: pd.Series, places: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(Lexicon(*shared.value))
        out = []
        for t, p in zip(texts, places):
            titles = frozenset(key for place, key, _ in outer_lines(t) if int(p) >> place & 1) if t and p else frozenset()
            out.append(repair(t, loaded[0], titles))
        return pd.Series(out, index=texts.index, dtype=object)

    noise = scan_noise(df, lexicon, text, keys)
    rows = df.select(*keys, F.col(text).alias("given")).dropDuplicates(list(keys)).join(noise, list(keys), "left")
    return rows.withColumn("repaired", repaired("given", F.coalesce("title_places", F.lit(0)))).drop("given", "title_places")


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, broken, misread, page_number, running_title, repaired) of every section, once each."""
    sections = table(spark, folder, "sections")
    return repaired_rows(sections, build_lexicon(sections))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos) of the sections with broken or misread words, running titles or page numbers."""
    sections = table(spark, folder, "sections")
    return scan_noise(sections, build_lexicon(sections)).select("doc_id", "pos")
