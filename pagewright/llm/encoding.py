"""Problem 2: text decoded with the wrong encoding.

A hidden Markov model labels the characters of a text: one clean state and one state per encoding pair
(the encoding that the bytes were written in, the one they were read in). Only characters beyond ASCII, and
question marks inside words, tell the states apart, so Viterbi runs over those; the ASCII between them
has the same probability in every state. Each labelled span gets its state's inverse transform.

Defined results: null gives null and no case; empty and blank texts are unchanged; texts of any length are read
whole; a lost character (U+FFFD or ?) makes a case and stays as it is, since its original can't be known.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.tables import table

# The letters and signs beyond ASCII that clean text of the five languages uses.
LETTERS = "àâäáãæçéèêëíìîïñóòôöõœßúùûüÿ"
SIGNS = "“”„«»‘’‚–—…•·°€§£¿¡"
# Small letters that are words of their own.
ALONE = "àâèéóòô"
# Letters of other scripts that look like Latin ones; within a Latin word they are a matter of forms (p4).
LOOK_ALIKE = "аеорсухіѕјкмнтвАВЕЗКМНОРСТУХІЅЈαορνικτυχηΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
OTHERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯЁαβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ"
ALPHABET = LETTERS + LETTERS.upper().replace("SS", "ẞ") + SIGNS
# Encoding pairs, written in and read in; a pair twice means that it happened twice.
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"),
    ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "iso8859-15"), ("cp1252", "mac_roman"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "cp1252", "utf-8", "latin-1"),
)
LOST = len(PAIRS) + 1  # the state whose characters were replaced by ? or U+FFFD
N = len(PAIRS) + 2
START, LEAVE, SWITCH = 2e-3, 0.02, 1e-6
RARE = 1e-9
FRAIL = frozenset([*map(chr, range(0x80, 0xA1)), "\xad"])


def written(text: str, encoding: str) -> bytes:
    """Bytes of the text; bytes that the encoding leaves undefined stand for themselves."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if ord(c) > 255:
                raise
            out.append(ord(c))
    return bytes(out)


def read(data: bytes, encoding: str) -> str:
    if encoding == "utf-8":
        return data.decode("utf-8")
    return "".join(_byte(b, encoding) for b in data)


@cache
def _byte(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def garble(text: str, pair: tuple[str, ...]) -> str:
    for a, b in zip(pair[::2], pair[1::2]):
        text = read(written(text, a), b)
    return text


def restore(text: str, pair: tuple[str, ...]) -> str:
    """The inverse of garble; raises UnicodeError where the text can't have come from it."""
    for a, b in reversed(list(zip(pair[::2], pair[1::2]))):
        text = read(written(text, b), a)
    return text


class Emissions(NamedTuple):
    """Of each state, by (previous character of the same garbled one or '', character): the chance that the garbled
    character ends here, and that it ends here or goes on."""

    ends: dict[tuple[str, str], np.ndarray]
    all: dict[tuple[str, str], np.ndarray]


@cache
def model() -> tuple[Emissions, list[dict[str, str]], np.ndarray]:
    """Emissions of the garbled states, inverse maps, transitions in logs."""
    ends: dict[tuple[str, str], np.ndarray] = {}
    emit: dict[tuple[str, str], np.ndarray] = {}
    maps: list[dict[str, str]] = []
    for s, pair in enumerate(PAIRS, 1):
        inverse = {}
        for c in ALPHABET + OTHERS + "¬":
            try:
                g = garble(c, pair)
            except UnicodeError:
                continue
            forms = {g}
            if pair == ("utf-8", "cp1252") and any("\x80" <= x <= "\x9f" for x in g):
                forms.add(garble(c, ("utf-8", "latin-1")))  # readers differ in what they do with undefined bytes
            for g in forms - {c}:
                inverse[g] = c
                weight = (3 if c in LETTERS else 1 if c in ALPHABET else 0.3) / len(ALPHABET)
                before = ""
                for k, x in enumerate(g):
                    w = weight if k == 0 else 2 / len(ALPHABET)
                    emit.setdefault((before, x), np.zeros(N))[s] += w
                    # Controls, soft hyphens and hard spaces are often dropped or made plain after the wrong reading.
                    if k + 1 == len(g) or all(y in FRAIL for y in g[k + 1 :]):
                        ends.setdefault((before, x), np.zeros(N))[s] += w
                    before = x
        maps.append(inverse)
    for before in {b for b, _ in emit if b}:  # within a character, what follows depends on what came
        own = [k for k in emit if k[0] == before]
        total = np.maximum(sum(emit[k] for k in own), 1e-12)
        for k in own:
            emit[k] = 0.9 * emit[k] / total
            if k in ends:
                ends[k] = 0.9 * ends[k] / total
    for table in (ends, emit):
        table.setdefault(("", "�"), np.zeros(N))[LOST] = 0.5
        for e in table.values():
            np.maximum(e, RARE, out=e)
    move = np.full((N, N), SWITCH)
    move[0, :] = START / N
    move[:, 0] = LEAVE
    np.fill_diagonal(move, 1 - LEAVE)
    move[0, 0] = 1 - START
    return Emissions({k: np.log(e) for k, e in ends.items()}, {k: np.log(e) for k, e in emit.items()}), maps, np.log(move)


FOREIGN = {"CYRILLIC", "GREEK", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "THAI", "ARMENIAN", "GEORGIAN"}


@cache
def script(c: str) -> str:
    """'' for what is no letter, else the first word of the character's name."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


@cache
def is_form(c: str) -> bool:
    """Compatibility forms, accents, invisible characters and spaces: odd, but not from decoding."""
    o = ord(c)
    return 0xFF00 <= o <= 0xFFEF or 0xFB00 <= o <= 0xFB06 or 0x300 <= o <= 0x36F or 0x2000 <= o <= 0x200F or o in (0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0xAD, 0xA0, 0x212A, 0x180E)


def clean(before: str, c: str, after: str) -> float:
    """Probability of a character beyond ASCII, or of ?, in clean text between its neighbours."""
    inner = before.isalpha() and after.isalpha()
    if c in LETTERS or c in "åø":
        if before.isspace() and (c not in ALONE and after.isspace() or after.isascii() and after.isupper()):
            return 1e-8
        return 2e-5 if before.isalpha() and not before.isascii() and before not in LETTERS else 0.06
    if c in ALPHABET and c.isalpha() or c in "ÅØ":
        if before.isascii() and before.isupper() or after.isascii() and after.isupper():
            return 0.03  # within a word in capitals
        return 1e-9 if before.islower() else 5e-3
    if c == "’":
        return 0.06
    if c == "¬":
        return 0.05 if before.isalpha() and after in "\r\n" else 0.01 if after in "\r\n" else RARE * 10
    if c in "¼½¾²³¹°":
        return 1e-3 if not before.isalpha() else 1e-8
    if c in SIGNS:
        if before.isalpha() and (c in "‚…·°€§£¡¿" or inner):
            return 1e-7
        return 1e-5 if c == "‚" else 0.005 if before and not before.isascii() and before not in LETTERS else 0.05
    if c in LOOK_ALIKE and (before.isalpha() and before.isascii() or after.isalpha() and after.isascii()):
        return 0.02
    if c == "?":
        return 1e-8
    if c == "\xa0":
        return 1e-7 if before in "ÃÂâ" else 0.06
    if c == "\xad":
        return 1e-6 if before in "ÃÂâ" else 0.06
    if is_form(c):
        return 0.05
    kind = script(c)
    if kind in FOREIGN and (c in OTHERS or kind not in ("CYRILLIC", "GREEK")):
        if script(before) == kind:
            return 0.3
        return 1e-3 if not before.isalpha() else 1e-4
    return RARE * 10


_CLASS, _WHERE = r"[?\x80-\U0010ffff]", r"(?:(?<!\?)|(?<=[^\W\d_]\?)(?=[^\W\d_]|\s+[a-zà-ÿ])|(?<![^\s'’(\"«“]\?)(?=[a-zà-ÿ]))"
#: Characters that tell the states apart; it begins with one class, so that the search skips all others fast.
SUSPECT = re.compile(_CLASS + _WHERE)


#: (character, the one before, the one after) of what SUSPECT finds.
_AROUND = re.compile(rf"(?s)({_CLASS}){_WHERE}(?<=(.).)(?=(.))")


@lru_cache(maxsize=1 << 16)
def emissions(within: bool, before: str, c: str, after: str) -> np.ndarray:
    """Log chance of a character that tells in every state, between its neighbours; within: the one before tells as well."""
    table = model()[0].all if not after.isascii() else model()[0].ends
    e = np.full(N, np.log(RARE))
    if c == "?":
        e[LOST] = np.log(0.3)
    else:
        got = table.get((before if within else "", c))
        if got is None:
            got = table.get(("", c))
        if got is not None:
            e[:] = got
    e[0] = np.log(clean(before, c, after))
    if c in LETTERS or c == "’":  # what was left whole, as in a passage where only some characters were lost
        e[LOST] = np.log(5e-3)
    return e


@lru_cache(maxsize=1 << 16)
def _gain(c: str, before: str, after: str) -> float:
    """The most that one character can speak for any other state than the clean one."""
    return max(float((e[1:] - e[0]).max()) for e in (emissions(True, before, c, after), emissions(False, before, c, after)))


def may_be_garbled(text: str) -> bool:
    """Whether Viterbi may find a span: never false where it does.

    A span costs what it takes to enter it, and its further transitions cost more than staying clean; what it gains is at
    most the sum of its characters' gains. So there is no span unless some run of characters gains more than entering costs.
    """
    spots = _AROUND.findall(f" {text} ")
    known = {x: _gain(*x) for x in set(spots)}
    if all(x <= 0 for x in known.values()):
        return False
    move = model()[2]
    cost, run = float(move[0, 0] - move[0, 1]), 0.0
    for x in spots:
        run = max(0.0, run + known[x])
        if run >= cost:
            return True
    return False


def labels(text: str) -> list[tuple[int, int, int]]:
    """Viterbi: (start, end, state) of each span that isn't clean, in order; start and end are the first and last character that tells."""
    move = model()[2]
    spots = [m.start() for m in SUSPECT.finditer(text)]
    if not spots or not may_be_garbled(text):
        return []
    n, last = len(text), -2
    score = np.full(N, -np.inf)
    score[0] = 0.0
    back = np.empty((len(spots), N), np.int16)
    for t, i in enumerate(spots):
        step = score[:, None] + move
        back[t] = step.argmax(0)
        score = step.max(0) + emissions(last == i - 1, text[i - 1] if i else " ", text[i], text[i + 1] if i + 1 < n else " ")
        last = i
    state = int(score.argmax())
    path = [state]
    for t in range(len(spots) - 1, 0, -1):
        state = int(back[t, state])
        path.append(state)
    path.reverse()
    spans: list[tuple[int, int, int]] = []
    state = 0
    for i, s in zip(spots, path):
        if s and s == state:
            spans[-1] = (spans[-1][0], i + 1, s)
        elif s:
            spans.append((i, i + 1, s))
        state = s
    return spans


BEYOND = re.compile(r"[^\x00-\x7f]+")


def repair(text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with each labelled span put right, and the spans (start, end, name of the pair)."""
    if not text:
        return text, []
    out, at, told = [], 0, []
    for i, j, s in labels(text):
        out.append(text[at:i])
        piece = text[i:j]
        if s != LOST:
            pair, known = PAIRS[s - 1], model()[1][s - 1]

            def back(m: re.Match, pair: tuple[str, ...] = pair, known: dict[str, str] = known) -> str:
                run = m.group()
                try:
                    return restore(run, pair)
                except (UnicodeError, ValueError):
                    for g in sorted(known, key=len, reverse=True):
                        run = run.replace(g, known[g])
                    return run

            piece = BEYOND.sub(back, piece)
        told.append((i, j, "lost" if s == LOST else ">".join(PAIRS[s - 1])))
        out.append(piece)
        at = j
    out.append(text[at:])
    return "".join(out), told


def is_garbled(text: str | None) -> bool:
    return bool(text) and bool(labels(text))


def garbled_rows(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """keys, repaired text and spans of the rows of df that hold garbled characters; other columns don't matter.

    The JVM keeps the rows that aren't ASCII or hold a question mark; of those Viterbi runs over the ones where the model's
    own chances leave room for a span (may_be_garbled). No shuffle; nulls, empty and blank texts give no row; a row given twice comes out twice.
    """
    kept = df.select(*keys, F.col(text).alias("text")).where("octet_length(text) > length(text) or contains(text, '?')")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", repaired string, spans array<struct<start:int,stop:int,pair:string>>"

    def run(batches):
        for b in batches:
            b = b[[may_be_garbled(t) for t in b["text"]]]
            got = [repair(t) for t in b["text"]]
            hit = [bool(spans) for _, spans in got]
            out = b.loc[hit, list(keys)].reset_index(drop=True)
            out["repaired"] = [t for t, spans in got if spans]
            out["spans"] = [[{"start": i, "stop": j, "pair": p} for i, j, p in spans] for _, spans in got if spans]
            if len(out):  # an empty column has no kind that would become an array
                yield out

    return kept.mapInPandas(run, schema)


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, repaired, spans) of the garbled sections, once each."""
    return garbled_rows(table(spark, folder, "sections")).dropDuplicates(["doc_id", "pos"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos) of the sections with garbled or lost characters."""
    return garbled_rows(table(spark, folder, "sections")).select("doc_id", "pos").distinct()
