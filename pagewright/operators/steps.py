"""The cleaning steps, pipelines of them, and their metrics.

A step is a name and a function from column to column; a pipeline composes them into one projection, so that the
only exchange with Python is the normalisation of texts beyond ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

# Ligatures and the letters that stand for them.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def _only(condition: Column, changed: Column, t: Column) -> Column:
    return F.when(condition, changed).otherwise(t)


def normalize_unicode(t: Column) -> Column:
    """Compatibility normalisation, composed; ASCII texts stay in the JVM."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.coalesce(nfkc(F.when(F.octet_length(t) > F.length(t), t)), t)


def strip_invisibles(t: Column) -> Column:
    """Drops control, format, private and unassigned characters but tab and line ends."""
    return F.regexp_replace(t, r"[\p{C}&&[^\t\n\r]]", "")


def convert_ligatures(t: Column) -> Column:
    out = t
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return _only(F.octet_length(t) > F.length(t), out, t)


def rejoin_hyphenated(t: Column) -> Column:
    """Joins words broken by a hyphen at a line end; of breaks that follow each other in one word every second stays.

    A match begins at the hyphen, so words are not tried one letter after the other, and takes the next break along as it is.
    """
    return _only(F.contains(t, F.lit("-\n")), F.regexp_replace(t, rf"(?<={T.WORD})-\n({T.WORD}++(?:-\n)?)", "$1"), t)


def collapse_whitespace(t: Column) -> Column:
    """Single blanks, none around line ends."""
    needed = F.lit(False)
    for x in ("  ", "\t", "\xa0", " \n", "\n "):
        needed = needed | F.contains(t, F.lit(x))
    out = F.regexp_replace(t, r"[ \t\xa0]+", " ")
    return _only(needed, F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"), t)


def limit_newlines(t: Column, most: int = 2) -> Column:
    return _only(F.contains(t, F.lit("\n" * (most + 1))), F.regexp_replace(t, f"\n{{{most + 1},}}", "\n" * most), t)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also for expressions that use it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def dedup_paragraphs(t: Column, least: int = 3) -> Column:
    """Keeps the first of paragraphs that occur at least so often, compared without white space at the ends.

    Paragraphs lie between two line feeds in a row. Keys are sorted with their places, so that equal ones stand side by
    side; a paragraph goes if the one before has its key and a window of that many equal keys holds it. The cost is that
    of sorting; texts without any repeated paragraph only pass a hash test.
    """

    def rebuilt(paragraphs: Column) -> Column:
        keys = F.transform(paragraphs, T.strip)
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _let(ordered, lambda o: without(paragraphs, o))).otherwise(F.array_join(paragraphs, "\n\n"))

    def without(paragraphs: Column, o: Column) -> Column:
        def goes(x: Column, j: Column) -> Column:
            # Not F.get: a Python step after it would not be taken out of the plan.
            again = F.when(j > 0, o[j - 1]["k"] == x["k"]).otherwise(False)
            often = F.lit(False)
            for s in range(least):
                inside = (j >= s) & (j - s + least - 1 < F.size(o))
                often = often | F.when(inside, (o[j - s]["k"] == x["k"]) & (o[j - s + least - 1]["k"] == x["k"])).otherwise(False)
            return (x["k"] != "") & again & often

        dropped = F.transform(F.filter(o, goes), lambda x: x["i"])
        return _let(dropped, lambda d: F.array_join(F.filter(paragraphs, lambda p, i: ~F.array_contains(d, i)), "\n\n"))

    return _only(F.contains(t, F.lit("\n\n")), _let(F.split(t, "\n\n", -1), rebuilt), t)


#: Blanks within a line; a line of three or more characters, blanks at its ends apart, without a letter or digit.
_INNER = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"
_SIGN = r"[^\p{L}\p{N}\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_PUNCTUATION = rf"{_INNER}{_SIGN}[^\p{{L}}\p{{N}}\n]{{2,}}(?<={_SIGN}){_INNER}"


def strip_punctuation_lines(t: Column) -> Column:
    """Drops lines of three or more characters without a letter or digit; ends every line with one line feed.

    With a line feed before the first line every line goes with the one before it, in one pass without splitting.
    """
    feeds = _only(t.rlike(T.OTHER_LINE_END), F.regexp_replace(t, T.LINE_END, "\n"), t)
    ended = _only(F.endswith(feeds, F.lit("\n")), F.left(feeds, F.length(feeds) - 1), feeds)
    kept = F.regexp_replace(F.concat(F.lit("\n"), ended), rf"\n{_PUNCTUATION}(?=\n|\z)", "")
    return F.substr(kept, F.lit(2))


def finalize(t: Column) -> Column:
    """Line feeds only, and no white space at the ends."""
    return T.strip(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


@dataclass(frozen=True)
class Step:
    name: str
    apply: Callable[[Column], Column]
    python: bool = False


def python_step(name: str, fn: Callable[[str], str]) -> Step:
    """A step from a function on texts, run in Arrow batches; nulls stay null."""

    def apply(t: Column) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return run(t)

    return Step(name, apply, True)


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...]

    def names(self) -> list[str]:
        return [s.name for s in self.steps]

    def without(self, *names: str) -> Pipeline:
        return Pipeline(tuple(s for s in self.steps if s.name not in names))

    def insert_after(self, target: str, step: Step) -> Pipeline:
        """Puts the step after each one of that name; an unknown name changes nothing."""
        return Pipeline(tuple(x for s in self.steps for x in ((s, step) if s.name == target else (s,))))

    def apply(self, t: Column) -> Column:
        for s in self.steps:
            t = s.apply(t)
        return t

    def clean(self, df: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
        """df with the cleaned text in out. Each step is a column of its own, so that no expression is worked out twice."""
        return self._staged(df, text).select(*df.columns, F.col(f"__{len(self.steps)}").alias("__out")).transform(lambda d: _put(d, df.columns, out or text))

    def _staged(self, df: DataFrame, text: str) -> DataFrame:
        d = df.withColumn("__0", F.col(text))
        for i, s in enumerate(self.steps, 1):
            if s.python and i > 1:
                # Keeps the steps before out of the Python function's arguments, from which nested lambdas can't be taken.
                d = d.select("*", F.explode(F.array(f"__{i - 1}")).alias("__kept")).drop(f"__{i - 1}").withColumnRenamed("__kept", f"__{i - 1}")
            d = d.withColumn(f"__{i}", s.apply(F.col(f"__{i - 1}")))
        return d

    def metrics(self, df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
        """keys, step_no, name, chars_in, chars_out; blank texts have no rows."""
        d = self._staged(df.where(~T.is_blank(F.col(text))), text)
        n = len(self.steps)
        lengths = d.select(*keys, F.array(*[T.n_chars(F.col(f"__{i}")) for i in range(n + 1)]).alias("len"))
        rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s.name).alias("name"), F.col("len")[i - 1].alias("chars_in"), F.col("len")[i].alias("chars_out")) for i, s in enumerate(self.steps, 1)])
        return lengths.select(*keys, F.inline(rows))


def _put(d: DataFrame, columns: list[str], out: str) -> DataFrame:
    return d.select(*[c for c in columns if c != out], F.col("__out").alias(out))


def default_pipeline(aggressive: bool = False, least: int = 3) -> Pipeline:
    """The ten steps in order; aggressive drops paragraphs from the second occurrence on."""
    least = 2 if aggressive else least
    return Pipeline(
        (
            Step("normalize_unicode", normalize_unicode),
            Step("strip_invisibles", strip_invisibles),
            Step("convert_ligatures", convert_ligatures),
            Step("rejoin_hyphenated", rejoin_hyphenated),
            Step("collapse_whitespace", collapse_whitespace),
            Step("limit_consecutive_newlines", limit_newlines),
            Step("dedup_paragraphs", lambda t: dedup_paragraphs(t, least)),
            Step("strip_punctuation_only_lines", strip_punctuation_lines),
            Step("limit_consecutive_newlines", limit_newlines),
            Step("finalize", finalize),
        )
    )


def rollup(metrics: DataFrame) -> DataFrame:
    """Sums by step name in the order of first appearance, with what was removed."""
    by = metrics.groupBy("name").agg(F.min("step_no").alias("first_step"), F.sum("chars_in").alias("chars_in"), F.sum("chars_out").alias("chars_out"))
    return by.select(
        "first_step",
        "name",
        "chars_in",
        "chars_out",
        (F.col("chars_in") - F.col("chars_out")).alias("chars_removed"),
        T.percent_less(F.col("chars_out"), F.col("chars_in")).alias("reduction_percent"),
    )


def shares(rolled: DataFrame) -> DataFrame:
    """Adds to a rollup (a row for each step) the share of all removed characters, in percent to one decimal."""
    total = F.sum("chars_removed").over(Window.partitionBy(F.lit(0)))  # over the few rows of a rollup
    return rolled.withColumn("share_percent", F.when(total != 0, F.bround(F.col("chars_removed") / total * 100, 1)).otherwise(F.lit(0.0)))
