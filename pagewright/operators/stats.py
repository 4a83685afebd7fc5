"""Sizes, token estimates, savings and the recap of a batch."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.session import cut_lineage

CHARS_PER_TOKEN = 4


def estimate_tokens(t: Column) -> Column:
    """A quarter of the characters, at least 1, and 0 for an empty text."""
    return F.when(t == "", F.lit(0)).when(t.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(t) / CHARS_PER_TOKEN))).cast("bigint")


def document_text(sections: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, text): filled contents in order, two line feeds between them."""
    parts = F.array_sort(F.collect_list(F.when(F.col(content) != "", F.struct("pos", F.col(content).alias("content")))))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))


def with_statistics(df: DataFrame, cleaned: str = "cleaned", original: str = "original", size: str = "original_size_bytes") -> DataFrame:
    """Adds the figures of each document from its two texts and its size in bytes."""
    c, o = F.col(cleaned), F.col(original)
    d = df.select(
        "*",
        F.octet_length(c).cast("bigint").alias("cleaned_size_bytes"),
        T.n_chars(o).alias("original_chars"),
        T.n_chars(c).alias("cleaned_chars"),
        estimate_tokens(c).alias("tokens_estimated"),
        estimate_tokens(o).alias("tokens_original_estimated"),
        F.floor(F.col(size) / CHARS_PER_TOKEN).cast("bigint").alias("tokens_input_estimated"),
    )
    return d.select(
        "*",
        T.percent_less(F.col("cleaned_size_bytes"), F.col(size)).alias("reduction_percent"),
        T.percent_less(F.col("tokens_estimated"), F.col("tokens_original_estimated")).alias("tokens_reduction_percent"),
        T.percent_less(F.col("tokens_estimated"), F.col("tokens_input_estimated")).alias("tokens_input_reduction_percent"),
    )


def savings(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, metric, before, after, gain: four rows of texts for people from the figures of each document."""

    def row(metric: str, before: str, after: str, shown: Callable[[Column], Column]) -> Column:
        gain = T.percent_less(F.col(after), F.col(before))
        return F.struct(F.lit(metric).alias("metric"), shown(F.col(before)).alias("before"), shown(F.col(after)).alias("after"), gain.alias("gain"))

    rows = F.array(
        row("size", "original_size_bytes", "cleaned_size_bytes", T.size_text),
        row("characters", "original_chars", "cleaned_chars", T.count_text),
        row("tokens of the file", "tokens_input_estimated", "tokens_estimated", T.count_text),
        row("tokens of the text", "tokens_original_estimated", "tokens_estimated", T.count_text),
    )
    return df.select(*keys, F.inline(rows))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with number, from 1 in that order, and total, as a batch reports its progress.

    No task ever sees all rows: sorted partitions are numbered by themselves, and the sizes of the partitions before, one
    row each, are added.
    """
    ordered = cut_lineage(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")))
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("__part", "n"))).alias("all"))  # as many as there are partitions
    before = F.aggregate(F.filter("all", lambda x: x["__part"] < F.col("__part")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    starts = sizes.crossJoin(F.broadcast(listed)).select("__part", "__first", before.alias("__before"), total.alias("total"))
    numbers = ordered.join(F.broadcast(starts), "__part")
    return numbers.select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("number"), "total")


def count_tokens(t: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of a text by a vocabulary of byte ranks, one base64 string and rank a line; special tokens' strings are ordinary text.

    The file is read on the driver and sent to the executors, where each worker builds its encoder once.
    """
    data = Path(vocabulary).read_bytes()

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        encode = _encoder(data, pattern).encode_ordinary
        return s.map(lambda x: len(encode(x)), na_action="ignore").astype("Int64")

    return run(t)


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def recap(results: DataFrame) -> DataFrame:
    """One row: files, successes, sums before and after and gains to one decimal; failed files (error not null) count as zeros."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c)).otherwise(0)), F.lit(0)).cast("bigint")

    d = results.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("error").isNull()).alias("successes"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        total("original_size_bytes").alias("bytes_before"),
        total("cleaned_size_bytes").alias("bytes_after"),
        total("tokens_input_estimated").alias("tokens_before"),
        total("tokens_estimated").alias("tokens_after"),
    )

    def gain(after: str, before: str) -> Column:
        return F.when(F.col(before) > 0, F.bround((1 - F.col(after) / F.col(before)) * 100, 1)).otherwise(F.lit(0.0))

    return d.select("*", gain("bytes_after", "bytes_before").alias("size_gain"), gain("tokens_after", "tokens_before").alias("token_gain"))
