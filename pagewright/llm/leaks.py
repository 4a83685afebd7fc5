"""Problem 9: passages of evaluation items inside documents.

Size-partitioned MinHash containment search. Queries are all passages of PASSAGE words of the items. A partition's size
bounds the Jaccard similarity that full containment implies, and with it the number of bands; so every document, short or
long, is partitioned into windows of just PASSAGE words, the size of the queries. A window that is a passage then has
similarity 1, one band of one MinHash finds it, and none is overlooked. Neighbouring windows mostly share their MinHash, so
that two in nine words bring one. Candidates are verified by the exact containment of PASSAGE words in a row.

Items up to block_chars characters are sent to the executors; more are joined by MinHash, then by passage, without
any list of items on the driver and with one scan of the corpus in either case.

Defined results: items and documents under PASSAGE words have no passage; null, empty and blank texts match
nothing; an item without a number is passed over; a document given twice comes out once; an item given twice counts once. Words and passages are compared by
64-bit numbers.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.tables import table

PASSAGE = 12
SHINGLE = 5
#: Items of at most so many characters in all are sent to the executors.
BLOCK_CHARS = 4_000_000
#: Texts that are searched at once.
TEXTS = 500
WORD = re.compile(r"[^\W_]+")
MARKS = re.compile("[̀-ͯ]")


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits without case and accents."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(text.casefold())


class Numbers(dict):
    """64-bit numbers of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolling(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the runs of n words that begin at those places."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


class Windows:
    """All windows of PASSAGE words of some texts: the text they lie in, where they begin, and their MinHash."""

    def __init__(self, texts: list[str | None], numbers: Numbers):
        words = [plain_words(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.fromiter((numbers[w] for own in words for w in own), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.arange(max(0, len(owner) - PASSAGE + 1))
        self.starts = starts[owner[starts] == owner[starts + PASSAGE - 1]]
        self.owner = owner[self.starts]
        self.minhash = self._minhash()[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def _minhash(self) -> np.ndarray:
        """The least number among the shingles of SHINGLE words of each window; windows grow by doubling."""
        v = rolling(self.words, np.arange(len(self.words) - SHINGLE + 1), SHINGLE)
        width, want = 1, PASSAGE - SHINGLE + 1
        while width < want:
            step = min(width, want - width)
            v = np.minimum(v[:-step], v[step:])
            width += step
        return v

    def passages(self, windows: np.ndarray) -> np.ndarray:
        return rolling(self.words, self.starts[windows], PASSAGE)


class Index:
    """MinHashes and passages of items."""

    def __init__(self, items: list[tuple[int, str]]):
        w = Windows([t for _, t in items], Numbers())
        self.minhashes = np.unique(w.minhash)
        exact: dict[int, set[int]] = {}
        for p, k in zip(w.passages(np.arange(len(w.starts))).tolist(), w.owner.tolist()):
            exact.setdefault(p, set()).add(items[k][0])
        self.exact = exact


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def search(index: Index, texts: list[str | None], numbers: Numbers) -> list[tuple[int, int]]:
    """(number of the text, item) of the texts that contain a passage."""
    w = Windows(texts, numbers)
    candidates = np.flatnonzero(_in(index.minhashes, w.minhash))
    found = zip(w.owner[candidates].tolist(), w.passages(candidates).tolist())
    return sorted({(k, item) for k, p in found for item in index.exact.get(p, ())})


#: The index of a worker, by the number of its search.
_BUILT: dict[str, Index] = {}


def leaked(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key), once each, of the rows of df that share PASSAGE words in a row with an item. Texts are never shuffled."""
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kinds = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    found = _by_broadcast(rows, asked, kinds) if size <= block_chars else _by_join(rows, asked, kinds)
    return found.distinct().toDF(key, item_key)


def _by_broadcast(rows: DataFrame, asked: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in asked.collect()])
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Index(shared.value)
        numbers = Numbers()
        for b in batches:
            texts = b["text"].tolist()
            got = [(i + n, item) for i in range(0, len(texts), TEXTS) for n, item in search(_BUILT[name], texts[i : i + TEXTS], numbers)]
            if got:
                yield b[["key"]].iloc[[n for n, _ in got]].reset_index(drop=True).assign(item=[item for _, item in got])

    return rows.mapInPandas(run, f"key {kinds[0]}, item {kinds[1]}")


def _by_join(rows: DataFrame, asked: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Both sides as rows of (MinHash, passages); a MinHash of the items only lets windows through, so none meets all items that have it."""

    def windows(batches):
        numbers = Numbers()
        for b in batches:
            for i in range(0, len(b), TEXTS):
                own = b.iloc[i : i + TEXTS]
                w = Windows(own["text"].tolist(), numbers)
                if not len(w.starts):
                    continue
                first = np.flatnonzero(np.r_[True, (w.minhash[1:] != w.minhash[:-1]) | (w.owner[1:] != w.owner[:-1])])
                passages = np.split(w.passages(np.arange(len(w.starts))).view(np.int64), first[1:])
                yield pd.DataFrame({"id": own.iloc[:, 0].to_numpy()[w.owner[first]], "minhash": w.minhash[first].view(np.int64), "passages": passages})

    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.mapInPandas(windows, f"id {kind}, minhash long, passages array<long>")

    told = of(asked.select("item", "text"), kinds[1])
    known = told.select("minhash").distinct()
    near = of(rows.select("key", "text"), kinds[0]).join(known, "minhash", "left_semi").select(F.col("id").alias("key"), F.explode("passages").alias("passage")).distinct()
    exact = told.select(F.col("id").alias("item"), F.explode("passages").alias("passage")).distinct()
    return near.join(exact, "passage").select("key", "item")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of documents that contain a passage of an evaluation item."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
