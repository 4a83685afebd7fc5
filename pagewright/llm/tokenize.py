"""Problem 8: token ids of the whole corpus by a public byte-level BPE.

Texts up to LEAF characters are encoded at once. Longer ones are cut into leaves that are encoded in parallel as
rows of their own; neighbours are then joined as a tree. A join re-encodes a growing window around the cut until it
holds, on either side, a place where the pattern of the vocabulary always cuts: left of it and right of it both
encodings agree with that of the whole text. In runs without such places (letters only, digits only) the window
grows until every pair of neighbouring tokens in it is what the pair's own bytes encode to.

Defined results: null and empty texts give an empty list; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.tables import table

LEAF = 1 << 15
WINDOW = 16
#: Pattern of the vocabularies byte_bpe_*.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places where that pattern always cuts: before a single space that a letter follows, and after letters before a digit or sign.
SAFE = regex.compile(r"(?<=\S)(?= \p{L})|(?<=\p{L})(?=[^\s\p{L}'])")


def vocabulary_file(name: str = "byte_bpe_50k") -> str:
    """The place of a public vocabulary; raises where the package of vocabularies isn't installed."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Encodes text by ranks of byte strings."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines() if isinstance(data, bytes) else data)}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.piece = self.encoding._encode_single_piece

    def text(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)

    def _fits(self, ids: list[int]) -> bool:
        return all(self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b] for a, b in zip(ids, ids[1:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the two texts put together."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            whole_left, whole_right = a == 0, b == len(right)
            data = self.text(left[a:]) + self.text(right[:b])
            try:
                window = data.decode()
            except UnicodeDecodeError:  # the window cuts a character
                if whole_left and whole_right:
                    raise
                size += 1
                continue
            split = len(self.text(left[a:]).decode(errors="ignore"))
            cuts = [m.start() for m in SAFE.finditer(window) if 0 < m.start() < len(window)]
            # A cut needs a character on either side within its own half, so that the half was cut there too.
            before = [0] if whole_left else [c for c in cuts if c < split - 1]
            after = [len(window)] if whole_right else [c for c in cuts if c > split + 1]
            if before and after:
                i, j = before[-1], after[0]
                head = self._upto(left, a, window[:i]) if i else []
                tail = self._from(right, b, window[j:]) if j < len(window) else []
                if head is not None and tail is not None:
                    return (head if i else []) + self.encode(window[i:j]) + (tail if j < len(window) else [])
            elif not cuts and not (whole_left and whole_right) and regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", window):
                middle = self.piece(window.encode())
                joined = left[:a] + middle + right[b:]
                if self._fits(joined[max(0, a - 1) : a + len(middle) + 1]) and window[:1] != "'":
                    return joined
            size *= 2

    def _upto(self, left: list[int], a: int, text: str) -> list[int] | None:
        """left up to the end of text, which begins at token a."""
        need, k = len(text.encode()), a
        while need > 0:
            need -= len(self.bytes_of[left[k]])
            k += 1
        return left[:k] if need == 0 else None

    def _from(self, right: list[int], b: int, text: str) -> list[int] | None:
        need, k = len(text.encode()), b
        while need > 0:
            k -= 1
            need -= len(self.bytes_of[right[k]])
        return right[k:] if need == 0 else None

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Joins neighbours, then the results, as a tree."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


@cache
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def token_ids(df: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row of df. Rows of usual length cause no shuffle; only leaves of long texts are grouped by row.

    vocabulary is a file of ranks, read on the driver and sent to the executors (a vocabulary, under 10 MB).
    """
    data = Path(vocabulary or vocabulary_file()).read_bytes()
    if len(data) > 10 << 20:
        raise ValueError(f"the vocabulary has {len(data)} bytes")
    shared = df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encode(batches):
        e = encoder(shared.value)
        for b in batches:
            out = b.drop(columns="text")
            out["ids"] = [np.array(e.encode(t) if t else [], np.int32) for t in b["text"]]
            yield out

    short = rows.where(f"text is null or length(text) <= {leaf}").mapInPandas(encode, f"key {kind}, ids array<int>")
    # A row number of its own tells rows with the same key apart.
    cut = f"transform(sequence(0, (length(text) - 1) div {leaf}), k -> substring(text, int(k * {leaf} + 1), {leaf}))"
    leaves = rows.where(f"length(text) > {leaf}").select("key", F.xxhash64("text").alias("row"), F.posexplode(F.expr(cut)).alias("at", "text"))
    leaves = leaves.repartition("key", "row", "at").mapInPandas(encode, f"key {kind}, row long, at int, ids array<int>")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        copies = int((pdf["at"] == 0).sum())
        once = pdf.drop_duplicates("at").sort_values("at")
        ids = e.tree([list(map(int, x)) for x in once["ids"]])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]] * copies, "ids": [ids] * copies})

    long = leaves.groupBy("key", "row").applyInPandas(join, f"key {kind}, ids array<int>")
    return short.unionByName(long).withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k without special tokens."""
    return token_ids(table(spark, folder, "documents"))
