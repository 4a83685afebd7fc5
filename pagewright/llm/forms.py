"""Problem 4: one consistent form of characters.

Compatibility normalisation (composed), plain spaces for all other spaces, no default-ignorable characters, and
letters of another script inside a Latin word replaced by the Latin letters they look like, again and again until
nothing changes, so that a second pass changes nothing. ASCII words never leave a text; of the others each batch brings
its distinct ones into form all at once, as one string.

Defined results: null stays null; empty and blank texts give the empty or blank text with plain spaces; line ends
and tabs stay; the folded key is the consistent form in full case folding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import encoding
from pagewright.tables import table

# Letters of the Cyrillic and Greek scripts that look like Latin letters, and those letters.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіѕјһԁԛԝкмнтвгпьАВЕЗКМНОРСТУХІЅЈҺԚԜαορνικτυχεηγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxisjhdqwkmhtbrnbABE3KMHOPCTYXISJHQWaopviktuxenywABEZHIKMNOPTYX",
        strict=True,
    )
)
#: Default-ignorable characters.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
SPACES = "   -     　"
_IGNORE, _SPACE = re.compile(f"[{IGNORABLE}]"), re.compile(f"[{SPACES}]")
_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_TOKEN = re.compile(r"[^ \n\r\t]*[^\x00-\x7f][^ \n\r\t]*")


def _stable(text: str) -> str:
    """The consistent form of a text; line feeds stay where they are."""
    while True:
        new = unicodedata.normalize("NFKC", _IGNORE.sub("", _SPACE.sub(" ", text)))
        if _OTHER_SCRIPT.search(new):
            new = _WORD.sub(_one_script, new)
        if new == text:
            return new
        text = new


def consistent_values(texts: list[str | None]) -> list[str | None]:
    """The consistent forms of many texts: each distinct text and each distinct word beyond ASCII is worked out once."""
    distinct = {t for t in texts if t is not None and not t.isascii()}
    words = list({w for t in distinct for w in _TOKEN.findall(t)})
    form = dict(zip(words, _stable("\n".join(words)).split("\n")))
    done = {t: _TOKEN.sub(lambda m: form[m.group()], t) for t in distinct}
    return [done.get(t, t) for t in texts]


def consistent(text: str | None) -> str | None:
    return consistent_values([text])[0]


def folded_values(texts: list[str | None]) -> list[str | None]:
    """The consistent forms in full case folding, consistent themselves."""
    texts = consistent_values(texts)
    while True:
        new = consistent_values([t if t is None else t.casefold() for t in texts])
        if new == texts:
            return new
        texts = new


def _mixed(word: str) -> bool:
    kinds = {unicodedata.name(c, "").split(" ")[0] for c in word}
    return "LATIN" in kinds and bool(kinds & {"CYRILLIC", "GREEK"})


def _one_script(m: re.Match) -> str:
    w = m.group()
    return "".join(LOOK_ALIKE.get(c, c) for c in w) if _mixed(w) else w


def mixed_scripts(text: str) -> bool:
    """Whether a word holds letters of Latin and of Cyrillic or Greek."""
    return bool(_OTHER_SCRIPT.search(text)) and any(_mixed(m.group()) for m in _WORD.finditer(text) if not m.group().isascii())


def _in_python(text: Column, run: Callable[[list], list], plain: Column) -> Column:
    """run for texts beyond ASCII, plain for the others, which stay in the JVM."""

    @F.pandas_udf("string")
    def other(s: pd.Series) -> pd.Series:
        return pd.Series(run([None if t is None else str(t) for t in s.astype(object).where(s.notna(), None)]), index=s.index, dtype=object)

    return F.coalesce(other(F.when(F.octet_length(text) > F.length(text), text)), plain)


def consistent_form(text: Column) -> Column:
    """Column of the consistent form."""
    return _in_python(text, consistent_values, text)


def fold_key(text: Column) -> Column:
    """Column to compare texts by: the consistent form in full case folding."""
    return _in_python(text, folded_values, F.lower(text))


@cache
def _odd() -> frozenset[str]:
    """The characters that a consistent form may not have as they are: what normalisation changes or may join to the letter
    before, spaces, ignorable characters, and letters of the other scripts. None lies beyond the planes that are read here."""
    return frozenset(
        c
        for c in map(chr, [*range(0x80, 0x30000), *range(0xE0000, 0xE1000)])
        if unicodedata.normalize("NFKC", c) != c or unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) <= 0x11FF or _IGNORE.match(c) or _SPACE.match(c) or _OTHER_SCRIPT.match(c)
    )


def may_change(text: str) -> bool:
    """Whether a text holds a character that a consistent form may not have; never false where the form differs."""
    return not (text.isascii() or _odd().isdisjoint(text))


def inconsistent_rows(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos"), but_garbled: bool = True) -> DataFrame:
    """keys, consistent form and folded key of the rows whose text differs from its consistent form.

    but_garbled leaves out texts with garbled characters, which are to be repaired first (p2). No shuffle; null,
    empty and blank texts give no row; a row given twice comes out twice; other columns don't matter.
    """
    kept = df.select(*keys, F.col(text).alias("text")).where("octet_length(text) > length(text)")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", consistent string, folded string"

    def run(batches):
        for b in batches:
            b = b[[may_change(t) and not t.isspace() for t in b["text"]]]
            texts = b["text"].tolist()
            forms = consistent_values(texts)
            hit = [(f != t or mixed_scripts(t)) and not (but_garbled and encoding.is_garbled(t)) for t, f in zip(texts, forms)]
            out = b.loc[hit, list(keys)].reset_index(drop=True)
            out["consistent"] = [f for f, h in zip(forms, hit) if h]
            out["folded"] = folded_values(out["consistent"].tolist())
            if len(out):
                yield out

    return kept.mapInPandas(run, schema)


def p4_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, consistent, folded) of every section, once each."""
    rows = table(spark, folder, "sections").select("doc_id", "pos", "content").dropDuplicates(["doc_id", "pos"])
    return rows.select("doc_id", "pos", consistent_form(F.col("content")).alias("consistent"), fold_key(F.col("content")).alias("folded"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos) of the sections that differ from their consistent form."""
    return inconsistent_rows(table(spark, folder, "sections")).select("doc_id", "pos").distinct()
