"""Problem 6: repetition inside one document.

A cascade of rules over the words of a document. Each rule gives an upper bound of the repeated share, so it can
only reject; the last one is exact. Workers estimate every rule's cost and selectivity on the first documents
of each batch and order the rules by rejections per second; the order never changes a result.

Defined results: sections are read in the order of pos, each (doc_id, pos) once; null contents count as empty; a
document without words has share 0; digits, punctuation and line ends are passed over.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage
from pagewright.tables import table

WORD = re.compile(r"[^\W\d_]+")
RUN = 8
SAMPLE = 32
#: Odd multipliers of the rolling hash, one for each place in a run.
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(RUN)], np.uint64)


class Words:
    """The words of a document, as numbers where a rule needs them."""

    def __init__(self, text: str):
        self.words = WORD.findall(text.casefold())
        self._codes: np.ndarray | None = None

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            known: dict[str, int] = {}
            self._codes = np.array([known.setdefault(w, len(known)) for w in self.words], np.uint64)
        return self._codes

    def grams(self, n: int) -> np.ndarray:
        c = self.codes
        if len(c) < n:
            return c[:0]
        out = np.zeros(len(c) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                x = (c[k : len(c) - n + 1 + k] + np.uint64(0x632BE5AB)) * _MULTIPLIERS[k]
                out += x ^ (x >> np.uint64(29))
        return out


def bound_by_length(w: Words) -> float:
    """A run and its first occurrence need at least RUN + 1 words."""
    return 0.0 if len(w.words) <= RUN else 1.0


def bound_by_words(w: Words) -> float:
    """Every repeated word stood before, so it adds no distinct word."""
    n = len(w.words)
    return 1 - len(set(w.words)) / n if n else 0.0


def bound_by_pairs(w: Words) -> float:
    """A repeated run of L words repeats L - 1 pairs, at least 7/8 of L."""
    n = len(w.words)
    if n <= RUN:
        return 0.0
    pairs = len(set(zip(w.words, w.words[1:])))
    return (n - 1 - pairs) * RUN / (RUN - 1) / n


def bound_by_triples(w: Words) -> float:
    n = len(w.words)
    if n <= RUN:
        return 0.0
    g = w.grams(3)
    return (len(g) - len(np.unique(g))) * RUN / (RUN - 2) / n


def exact_share(w: Words) -> float:
    """Share of the words that lie in runs of RUN words which stand earlier."""
    n = len(w.words)
    if n <= RUN:
        return 0.0
    g = w.grams(RUN)
    _, first, inverse = np.unique(g, return_index=True, return_inverse=True)
    again = first[inverse] < np.arange(len(g))
    if not again.any():
        return 0.0
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + RUN, -1)
    return float((np.cumsum(marks)[:n] > 0).sum() / n)


RULES: tuple[Callable[[Words], float], ...] = (bound_by_length, bound_by_words, bound_by_pairs, bound_by_triples)


def order_rules(sample: list[str], least: float) -> list[Callable[[Words], float]]:
    """The rules by rejections per second: the best on the whole sample, then the best on what it leaves, and so on; rules
    that reject nothing more are left out, as the exact one follows. Finding the words is no rule's cost, as all need them."""
    if not sample:
        return [bound_by_length]
    left, rules, order = [Words(t) for t in sample], list(RULES), []
    while left and rules:
        rated = []
        for rule in rules:
            began = time.perf_counter()
            stay = [w for w in left if rule(w) >= least]
            rated.append(((len(left) - len(stay)) / (time.perf_counter() - began + 1e-9), rule, stay))
        rate, best, left = max(rated, key=lambda x: x[0])
        if not rate:
            break
        rules.remove(best)
        order.append(best)
    return order


def repeated_share(text: str, least: float = 0.0, rules: list[Callable[[Words], float]] | None = None) -> float:
    """The exact share where it may reach least, else 0."""
    w = Words(text)
    for rule in rules or ():
        if rule(w) < least:
            return 0.0
    return exact_share(w)


#: Documents of more characters than this are not gathered in one row; they take the way over blocks of words.
WHOLE = 20_000_000
BLOCK, SPAN = 4096, 1024


def repeated_documents(df: DataFrame, least: float = 0.3, key: str = "doc_id", order: str = "pos", text: str = "content", whole: int = WHOLE) -> DataFrame:
    """(key, share) of the documents whose repeated share is at least that; least=0 gives every document with a text.

    Usual documents are gathered by one shuffle and pass the cascade. Those of more than whole characters are never
    gathered: their words get places by two levels of sums, runs are made in blocks of BLOCK words and counted by shuffle.
    """
    parts = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(text).alias("text")).where("text is not null")
    sizes = parts.groupBy("key").agg(F.sum(F.length("text")).alias("size"))
    large = sizes.where(f"size > {whole} and key is not null").select("key")
    known = [r.key for r in large.limit(MOST_LARGE + 1).collect()]
    kind = df.schema[key].dataType.simpleString()
    if not known:
        found = _usual(parts, least, kind)
    else:
        if len(known) <= MOST_LARGE:
            usual, rest = parts.where(~F.col("key").isin(known) | F.col("key").isNull()), parts.where(F.col("key").isin(known))
        else:
            large = cut_lineage(large)
            usual, rest = parts.join(large, "key", "left_anti"), parts.join(large, "key", "left_semi")
        found = _usual(usual, least, kind).unionByName(_large(rest, kind).where(F.col("share") >= least))
    return found.withColumnRenamed("key", key)


#: Up to so many large documents are told apart by a list of their keys, more by a join.
MOST_LARGE = 1000


def _usual(parts: DataFrame, least: float, kind: str) -> DataFrame:
    listed = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    whole = listed.select("key", F.expr("array_join(transform(filter(parts, (x, i) -> i = 0 or not (x.at <=> parts[i - 1].at)), x -> x.text), '\n')").alias("text"))

    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            rules = order_rules(texts[:SAMPLE], least) if least else []
            share = np.array([repeated_share(t, least, rules) for t in texts])
            out = b[["key"]].copy()
            out["share"] = share
            yield out[share >= least]

    return whole.mapInPandas(run, f"key {kind}, share double")


def _large(parts: DataFrame, kind: str) -> DataFrame:
    """(key, share) without a row or task that holds a whole document."""
    once = parts.groupBy("key", "at").agg(F.min("text").alias("text"))

    def number(batches):
        import xxhash

        for b in batches:
            words = [[xxhash.xxh64_intdigest(w) - (1 << 63) for w in WORD.findall(t.casefold())] for t in b["text"]]
            out = b[["key", "at"]].copy()
            out["words"] = words
            if len(out):
                yield out

    at = parts.schema["at"].dataType.simpleString()
    words = once.mapInPandas(number, f"key {kind}, at {at}, words array<long>").where("size(words) > 0").withColumn("span", F.expr(f"coalesce(cast(at as bigint), -1) div {SPAN}"))
    words = cut_lineage(words)
    spans = words.groupBy("key", "span").agg(F.sum(F.size("words")).alias("n"))
    before = spans.select("key", "span", (F.sum("n").over(Window.partitionBy("key").orderBy("span")) - F.col("n")).alias("span_start"))
    inner = words.select("key", "span", "at", (F.sum(F.size("words")).over(Window.partitionBy("key", "span").orderBy(F.col("at").asc_nulls_first())) - F.size("words")).alias("inner_start"))
    starts = inner.join(before, ["key", "span"]).select("key", F.col("at").alias("start_at"), (F.col("span_start") + F.col("inner_start")).alias("start"))
    placed = words.withColumnRenamed("key", "k").join(starts, (F.col("k") == F.col("key")) & F.col("at").eqNullSafe(F.col("start_at")))
    each = placed.select("key", "start", F.posexplode("words").alias("i", "word")).select("key", (F.col("start") + F.col("i")).alias("place"), "word")
    # The first words of a block close the runs of the block before.
    blocks = F.when((F.col("place") % BLOCK < RUN - 1) & (F.col("place") >= BLOCK), F.array(F.expr(f"place div {BLOCK}"), F.expr(f"place div {BLOCK} - 1"))).otherwise(F.array(F.expr(f"place div {BLOCK}")))
    listed = each.select("key", "place", "word", F.explode(blocks).alias("block")).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    listed = listed.select("key", F.col("words")[0]["place"].alias("first"), F.transform("words", lambda x: x["word"]).alias("words"))

    def runs(batches):
        for b in batches:
            for k, first, w in zip(b["key"], b["first"], b["words"]):
                c = np.asarray(w, np.int64).view(np.uint64)
                if len(c) >= RUN:
                    out = np.zeros(len(c) - RUN + 1, np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(RUN):
                            x = (c[j : len(c) - RUN + 1 + j] ^ np.uint64(0x632BE5AB)) * _MULTIPLIERS[j]
                            out += x ^ (x >> np.uint64(29))
                    yield pd.DataFrame({"key": k, "run": out.view(np.int64), "place": first + np.arange(len(out))})

    found = listed.mapInPandas(runs, f"key {kind}, run long, place long")
    first = found.groupBy("key", "run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = found.join(first, ["key", "run"]).where("place > first").select("key", F.explode(F.sequence("place", F.col("place") + RUN - 1)).alias("covered")).distinct()
    covered = again.groupBy("key").agg(F.count(F.lit(1)).alias("covered"))
    total = spans.groupBy("key").agg(F.sum("n").alias("total"))
    return total.join(covered, "key", "left").select("key", (F.coalesce("covered", F.lit(0)) / F.col("total")).alias("share"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of the documents of which at least three tenths repeat what stood before."""
    return repeated_documents(table(spark, folder, "sections")).select("doc_id")
