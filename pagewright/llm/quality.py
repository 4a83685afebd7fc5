"""Problem 5: statistics of text quality per section, and whether it is natural prose.

Counts come from one pass over each text. Repetition statistics stand beside them: duplicate lines and paragraphs, and the
share of characters that the most frequent run of two, three or four words covers, worked out for a batch at once.
Combined rules separate prose from lists, tables, boilerplate and junk: lines are sorted into sentences and others
(see blocks), sentences must make up at least half, and a text whose statistics no prose has is none, whatever its
lines look like (see is_natural).

Defined results: null, empty and blank texts have zero counts and shares, and are no case of anything.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import blocks
from pagewright.tables import table

PROSE_SHARE = 0.5
LIST_LIMIT = 100_000
#: What no prose has: more signs than this share of the characters; in texts of some words, longer words, fewer common ones.
MOST_SYMBOLS, SOME_WORDS, LONGEST_MEAN, LEAST_COMMON = 0.5, 20, 16.0, 0.02
#: Boilerplate: so many of the characters lie in lines or paragraphs that stood before, or in one run of four words, few lines end
#: as sentences do, and sentences are not nearly all.
BOILERPLATE, SENTENCE_ENDS, MOSTLY_SENTENCES = 0.5, 0.2, 0.75
RUNS = (2, 3, 4)
STATISTICS = (
    "n_words int, mean_word_length double, symbol_ratio double, line_end_share double, common_share double,"
    " duplicate_lines double, duplicate_paragraphs double, top_pair_share double, top_run_share double, top_four_share double,"
    " prose_share double, is_prose boolean"
)
#: Texts whose runs of words are counted at once.
TEXTS = 1000
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*$")
_SYMBOL = re.compile(r"[^\w\s]")
_PARAGRAPHS = re.compile(r"\n\s*\n")


def _duplicates(parts: list[str]) -> float:
    """Characters in parts that stood before, as a share of all."""
    total = sum(map(len, parts))
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def top_shares(words: list[list[str]], most: int = RUNS[-1]) -> list[np.ndarray]:
    """For runs of two words, three, and so on: of each text the share of its letters in the run that covers most, if it occurs more than once."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.uint64) if flat else np.zeros(0, np.uint64)
    letters = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
    ends = np.cumsum(sizes)
    total = np.maximum(1, letters[ends] - letters[ends - sizes])
    owner = np.repeat(np.arange(len(words)), sizes)
    h = codes + (owner.astype(np.uint64) << np.uint64(32))
    out = []
    for n in range(2, most + 1):
        with np.errstate(over="ignore"):
            h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[n - 1 :]
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")
        first = np.flatnonzero(np.r_[True, h[at][order][1:] != h[at][order][:-1]]) if len(at) else at
        times = np.diff(np.r_[first, len(at)])
        run = at[order[first]] if len(at) else at
        again = times > 1
        share = np.zeros(len(words))
        np.maximum.at(share, owner[run[again]], times[again] * (letters[run[again] + n] - letters[run[again]]))
        out.append(np.minimum(1.0, share / total))
    return out


def is_natural(n_words: int, mean_word: float, symbols: float, line_ends: float, common: float, lines: float, paragraphs: float, runs: float, sentences: float) -> bool:
    """The combined rules. Repetition alone makes no text unnatural; repeated lines or runs that end no sentence do."""
    if symbols > MOST_SYMBOLS or n_words >= SOME_WORDS and (mean_word > LONGEST_MEAN or common < LEAST_COMMON):
        return False  # junk
    if max(lines, paragraphs, runs) >= BOILERPLATE and line_ends < SENTENCE_ENDS and sentences < MOSTLY_SENTENCES:
        return False  # boilerplate
    return sentences >= PROSE_SHARE  # lists, tables, contents and references have less


def statistics(texts: list[str | None], common: frozenset[str] = blocks.FUNCTION_WORDS) -> list[tuple]:
    """STATISTICS of each text."""
    words = [blocks.WORD.findall(t.casefold()) if t else [] for t in texts]
    pairs, threes, fours = top_shares(words)
    out = []
    for k, (text, own) in enumerate(zip(texts, words)):
        if not text or text.isspace():
            out.append((0, *[0.0] * 10, False))
            continue
        lines = [x for y in text.splitlines() if (x := y.strip())]
        n = len(own)
        mean = sum(map(len, own)) / n if n else 0.0
        symbols = len(_SYMBOL.findall(text)) / len(text)
        ends = sum(_END.search(x, max(0, len(x) - 8)) is not None for x in lines) / len(lines) if lines else 0.0
        known = sum(map(common.__contains__, own)) / n if n else 0.0
        again, paragraphs = _duplicates(lines), _duplicates([x for y in _PARAGRAPHS.split(text.replace("\r\n", "\n")) if (x := y.strip())])
        share = blocks.prose_share(blocks.parse(text))
        natural = is_natural(n, mean, symbols, ends, known, again, paragraphs, float(fours[k]), share)
        out.append((n, mean, symbols, ends, known, again, paragraphs, float(pairs[k]), float(threes[k]), float(fours[k]), share, natural))
    return out


def common_set(words: DataFrame | None, limit: int = LIST_LIMIT) -> frozenset[str]:
    """The words of a list of common words; a list over the limit is refused, as it is sent to every executor."""
    if words is None:
        return blocks.FUNCTION_WORDS
    got = words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} common words")
    return frozenset(r.word for r in got)


def text_statistics(df: DataFrame, common: DataFrame | None = None, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """keys and STATISTICS of every row; no shuffle; a row given twice comes out twice."""
    known = common_set(common)
    names = [x.split()[0] for x in STATISTICS.split(",")]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + STATISTICS

    def run(batches):
        for b in batches:
            for i in range(0, len(b), TEXTS):
                own = b.iloc[i : i + TEXTS]
                got = pd.DataFrame(statistics(own["text"].tolist(), known), columns=names, index=own.index)
                yield pd.concat([own[list(keys)], got], axis=1)

    return df.select(*keys, F.col(text).alias("text")).mapInPandas(run, schema)


def page_statistics(sections: DataFrame, pages: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Statistics of each section once, beside the word count that page analysis noted for its page (null without one)."""
    stats = text_statistics(sections, common).dropDuplicates(["doc_id", "pos"])
    page = F.regexp_extract("header", r"^Page (\d+)", 1)
    numbered = sections.select("doc_id", "pos", F.when(page != "", page.cast("int") - 1).alias("page_idx")).distinct()
    noted = pages.groupBy("doc_id", "page_idx").agg(F.max("word_count").alias("noted_words"))
    return stats.join(numbered, ["doc_id", "pos"], "left").join(noted, ["doc_id", "page_idx"], "left").drop("page_idx")


def unnatural_rows(df: DataFrame, common: DataFrame | None = None, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """keys and STATISTICS of the rows that are no natural prose; blank rows give none."""
    return text_statistics(df.where(F.col(text).rlike(r"[^\s\p{Z}]")), common, text, keys).where("not is_prose")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos) of the sections that are mostly no sentences."""
    return unnatural_rows(table(spark, folder, "sections"), table(spark, folder, "common_words")).select("doc_id", "pos").distinct()


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Those statistics of every section that SQL can state."""
    stats = text_statistics(table(spark, folder, "sections")).dropDuplicates(["doc_id", "pos"])
    return stats.select("doc_id", "pos", "n_words", "symbol_ratio", "line_end_share")


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every section beside the word count of its page."""
    return page_statistics(table(spark, folder, "sections"), table(spark, folder, "page_analysis"), table(spark, folder, "common_words"))
