"""Problem 1: language of each sentence, segment and document, with a confidence.

A string kernel compares texts by the presence of n-grams of N_GRAMS characters inside their words (word ends
included): an n-gram counts once for a text, by how rare it is, and texts are normed. Nyström landmarks stand for the
training sentences, kernel ridge regression separates each language from the rest. The kernel is linear in the presence
vector of the text to be classified, so landmarks and weights fold into one matrix (n-grams x languages): each block of
sentences is scored by one product of its presence matrix with that one.

Defined results: null, empty and blank texts have no segments; a sentence without any known n-gram has confidence 0
and the first language; headings, list items and table cells are no sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import blocks
from pagewright.tables import table

LANGUAGES = ("en", "fr", "de", "es", "it")
N_GRAMS = (1, 2, 3, 4)
#: Bounds of the sample that the classifier is fitted on: documents per language, sections in all, sentences per language.
SAMPLE_DOCUMENTS, SAMPLE_SECTIONS, SAMPLE_SENTENCES = 120, 4000, 600
#: Landmarks of each language, the first of its sample; an n-gram belongs to the index if so many landmarks hold it.
LANDMARKS, LEAST_LANDMARKS = 120, 2
#: Texts of one matrix product.
BLOCK = 256
RIDGE = 1e-2
# Codes of the languages as labels spell them, in lower case and without a region.
CODES = {
    "en": "en", "eng": "en", "english": "en", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "de": "de", "deu": "de",
    "ger": "de", "german": "de", "es": "es", "spa": "es", "spanish": "es", "it": "it", "ita": "it", "italian": "it",
}


def declared(label: str | None) -> list[str]:
    """The languages that a label names, in any spelling; none for missing and unusable labels."""
    parts = re.split(r"[^a-z_\-]+", (label or "").lower())
    return sorted({CODES[c] for p in parts if (c := re.split(r"[-_]", p)[0]) in CODES})


def grams(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in N_GRAMS for i in range(len(w) - n + 1)}


def distinct_words(text: str) -> set[str]:
    return set(blocks.WORD.findall(text.lower()))


class Presence:
    """Rows of 0 and 1, texts x n-grams of an index, in blocks of BLOCK texts; the memo of words is bounded."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self._block = np.zeros((BLOCK, len(index)), np.float32)
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._starts, self._sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._columns, self._used = np.zeros(1 << 15, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        for w in words:
            own = [k for g in grams(w) if (k := self.index.get(g)) is not None]
            if self._used + len(own) > len(self._columns):
                self._columns = np.concatenate([self._columns, np.zeros(max(len(own), len(self._columns)), np.int64)])
            if len(self._slot) == len(self._starts):
                self._starts, self._sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._sizes))
            self._columns[self._used : self._used + len(own)] = own
            self._starts[len(self._slot)], self._sizes[len(self._slot)] = self._used, len(own)
            self._slot[w] = len(self._slot)
            self._used += len(own)

    def blocks(self, texts: list[set[str]]):
        """(number of the first text, presence matrix) of each block of texts, given as their distinct words; the matrix is
        only good until the next one."""
        for first in range(0, len(texts), BLOCK):
            counts = [len(own) for own in texts[first : first + BLOCK]]
            words = [w for own in texts[first : first + BLOCK] for w in own]
            if len(self._slot) > 200_000:
                self._clear()
            self._learn([w for w in dict.fromkeys(words) if w not in self._slot])
            slots = np.fromiter(map(self._slot.__getitem__, words), np.int64, len(words))
            sizes = self._sizes[slots]
            ends = np.cumsum(sizes)
            places = np.repeat(self._starts[slots] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
            rows = np.repeat(np.arange(len(counts)) * len(self.index), counts)
            cells = np.repeat(rows, sizes) + self._columns[places]
            flat = self._block.reshape(-1)
            flat[cells] = 1
            yield first, self._block[: len(counts)]
            flat[cells] = 0


@dataclass
class Model:
    """weights: n-grams x (languages and one column for the texts' norms)."""

    index: dict[str, int]
    weights: np.ndarray
    scale: float

    def score(self, sentences: list[set[str]]) -> np.ndarray:
        """sentences, given as their distinct words, x languages: one matrix product for each block of sentences."""
        if not hasattr(self, "_presence"):
            self._presence = Presence(self.index)
        out = np.zeros((len(sentences), len(LANGUAGES)), np.float32)
        for first, present in self._presence.blocks(sentences):
            got = present @ self.weights
            out[first : first + len(got)] = got[:, :-1] / np.sqrt(np.maximum(got[:, -1:], 1e-6))
        return out

    def classify(self, sentences: list[str] | list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and confidences of texts or of their distinct words, 0 where the two best scores are equal, towards 1 where they are far apart."""
        s = self.score([distinct_words(x) if isinstance(x, str) else x for x in sentences])
        order = np.sort(s, axis=1)
        return s.argmax(1), np.tanh((order[:, -1] - order[:, -2]) / self.scale).astype(float)

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "scale": self.scale}


def fit(sentences: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on landmarks, one language against the rest; sentences that a first fit calls wrong are left out of the second.

    Kernel values come block by block; nothing of the size texts x n-grams is ever held.
    """
    y = np.array([LANGUAGES.index(x) for x in labels])
    texts = [distinct_words(x) for x in sentences]
    marks = [i for k in range(len(LANGUAGES)) for i in np.flatnonzero(y == k)[:landmarks]]
    found = Counter(g for i in marks for g in {g for w in texts[i] for g in grams(w)})
    index = {g: k for k, g in enumerate(sorted(g for g, n in found.items() if n >= LEAST_LANDMARKS))}
    presence = Presence(index)
    texts_with = np.zeros(len(index))
    for _, present in presence.blocks(texts):
        texts_with += present.sum(0)
    rare = np.log(max(2, len(texts)) / np.maximum(1, texts_with)).astype(np.float32)  # n-grams that any text has tell little
    model = None
    keep = np.ones(len(texts), bool)
    for _ in range(2):
        own = [i for i in marks if keep[i]]
        basis = np.zeros((len(own), len(index)), np.float32)
        for first, present in presence.blocks([texts[i] for i in own]):
            basis[first : first + len(present)] = present * rare
        basis /= np.maximum(np.linalg.norm(basis, axis=1, keepdims=True), 1e-6)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(float))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        kept = np.flatnonzero(keep)
        gram, right = ridge * len(kept) * np.eye(root.shape[1]), np.zeros((root.shape[1], len(LANGUAGES)))
        for first, present in presence.blocks([texts[i] for i in kept]):
            rows = present * rare
            z = (rows @ basis.T / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)).astype(float) @ root
            gram += z.T @ z
            right += z.T @ np.where(y[kept[first : first + len(z)], None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        folded = basis.T @ (root @ np.linalg.solve(gram, right)).astype(np.float32)
        model = Model(index, np.concatenate([folded * rare[:, None], (rare**2)[:, None]], axis=1), 1.0)
        keep = model.score(texts).argmax(1) == y
    s = np.sort(model.score([x for x, k in zip(texts, keep) if k]), axis=1)
    model.scale = float(np.median(s[:, -1] - s[:, -2])) / 2 or 1.0
    return model


def sentences_of(content: str | None) -> list[str]:
    """The full sentences of a text in order."""
    return [s for b in blocks.parse(content) if b.kind == "prose" for s in blocks.split_sentences(b.text) if blocks.is_sentence(s)]


def labelled_sample(sections: DataFrame, documents: DataFrame) -> tuple[list[str], list[str]]:
    """Sentences and labels of sections whose document declares one language, in one job.

    Of each language SAMPLE_DOCUMENTS documents, of those SAMPLE_SECTIONS sections, of their sentences SAMPLE_SENTENCES for
    each language, each time the first in the order of a hash, so that the sample is the same whatever the partitions.
    """

    @F.pandas_udf("string")
    def only(label: pd.Series) -> pd.Series:
        known = {x: d[0] if len(d := declared(x)) == 1 else None for x in label.unique()}
        return label.map(known.get)

    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = documents.select("doc_id", only("language").alias("label")).where("label is not null").withColumn("place", F.row_number().over(first))
    chosen = chosen.where(F.col("place") <= SAMPLE_DOCUMENTS).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = sections.where("content is not null").select("doc_id", "pos", "content").join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id", "pos"), "doc_id", "pos", "content").limit(SAMPLE_SECTIONS).select("label", "content").collect()
    found: dict[str, set[str]] = {k: set() for k in LANGUAGES}
    for r in got:
        found[r.label].update(sentences_of(r.content))
    kept = {k: sorted(found[k], key=lambda s: (zlib.crc32(s.encode()), s))[:SAMPLE_SENTENCES] for k in LANGUAGES}
    return [s for k in LANGUAGES for s in kept[k]], [k for k in LANGUAGES for _ in kept[k]]


def language_segments(df: DataFrame, model: Model, text: str = "content", keys: tuple[str, ...] = ("doc_id", "pos"), prose_only: bool = False) -> DataFrame:
    """keys, segment, lang, confidence, n_sentences, n_chars: runs of full sentences in one language, in order.

    prose_only leaves out texts that are mostly no sentences (p5). No shuffle; a row given twice comes out twice. The
    model (landmarks and weights, a few MB whatever the input) is sent to the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", segment int, lang string, confidence double, n_sentences int, n_chars int"

    def run(batches):
        m = shared.value
        for b in (x.iloc[i : i + 1000] for x in batches for i in range(0, len(x), 1000)):
            sentences, owner, sizes = [], [], []
            for i, t in enumerate(b["text"]):
                parsed = blocks.parse(t)
                if prose_only and blocks.prose_share(parsed) < 0.5:
                    continue
                for x in parsed:
                    if x.kind == "prose":
                        for s in blocks.split_sentences(x.text):
                            if (own := blocks.sentence_words(s)) is not None:
                                sentences.append(set(own))
                                sizes.append(len(s))
                                owner.append(i)
            lang, confidence = m.classify(sentences)
            if not sentences:
                continue
            owner = np.array(owner)
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])])
            count = np.diff(np.r_[new, len(owner)])
            out = b[list(keys)].iloc[owner[new]].reset_index(drop=True)
            first = np.r_[True, owner[new][1:] != owner[new][:-1]]
            at = np.arange(len(new))
            out["segment"] = at - np.maximum.accumulate(np.where(first, at, 0))
            out["lang"] = np.array(LANGUAGES)[lang[new]]
            out["confidence"] = np.add.reduceat(confidence, new) / count
            out["n_sentences"] = count
            out["n_chars"] = np.add.reduceat(np.array(sizes), new)
            yield out

    kept = df.select(*keys, F.col(text).alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}]"))
    return kept.mapInPandas(run, schema)


def document_languages(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, share, confidence): each language of a document with its share of the characters."""
    by = segments.groupBy(key, "lang").agg(F.sum("n_chars").alias("chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence"))
    total = by.groupBy(key).agg(F.sum("chars").alias("total"))
    return by.join(total, key).select(key, "lang", (F.col("chars") / F.col("total")).alias("share"), "confidence")


def undeclared(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of (doc_id, pos, lang) whose language the document's label doesn't name. Only keys and labels are shuffled."""

    @F.pandas_udf("array<string>")
    def named(label: pd.Series) -> pd.Series:
        known = {x: declared(x) for x in label.unique()}
        return label.map(known.get)

    labels = documents.groupBy("doc_id").agg(F.max("language").alias("label")).where("label is not null")
    labels = labels.select("doc_id", named("label").alias("named"))
    return found.join(labels, "doc_id", "left").where("named is null or not array_contains(named, lang)").drop("named")


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, segment, lang, confidence, n_sentences, n_chars) of every section, delivered once or more, once each."""
    sections, documents = table(spark, folder, "sections"), table(spark, folder, "documents_out")
    model = fit(*labelled_sample(sections, documents))
    return language_segments(sections, model).dropDuplicates(["doc_id", "pos", "segment"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, lang) of the languages of full sentences that the label doesn't declare."""
    sections, documents = table(spark, folder, "sections"), table(spark, folder, "documents_out")
    model = fit(*labelled_sample(sections, documents))
    found = language_segments(sections, model, prose_only=True).select("doc_id", "pos", "lang").distinct()
    return undeclared(found, documents)
