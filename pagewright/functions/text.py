"""Text primitives as column expressions, with the semantics of Unicode strings.

Java's regular expressions take more characters for line ends and fewer for letters, digits and blanks, so every
class is spelled out here once. Where a cheap test shows that a text can't match, the expression isn't run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and line ends.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Line ends but the line feed.
OTHER_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"


#: The blanks one by one.
_EACH_BLANK = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(t: Column) -> Column:
    """Without white space at either end; texts without any there stay as they are."""
    outer = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return F.when(outer.rlike(f"[{BLANKS}]"), F.trim(t, F.lit(_EACH_BLANK))).otherwise(t)


def rstrip(t: Column) -> Column:
    return F.when(F.right(t, F.lit(1)).rlike(f"[{BLANKS}]"), F.rtrim(t, F.lit(_EACH_BLANK))).otherwise(t)


def is_blank(t: Column) -> Column:
    return ~t.rlike(rf"[^{BLANKS}]")


def lines(t: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further line, and an empty text has none."""
    def but_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return F.transform(F.array(F.split(t, LINE_END, -1)), but_last)[0]  # the text is split once


def word_count(t: Column) -> Column:
    """Number of runs of characters that aren't white space."""
    return F.regexp_count(t, F.lit(rf"[^{BLANKS}]+")).cast("bigint")


def n_chars(t: Column) -> Column:
    return F.length(t).cast("bigint")


def percent_less(after: Column, before: Column) -> Column:
    """By how many percent after is less than before, to two decimals; 0 for nothing before, negative for growth."""
    return F.when(before > 0, F.bround((1 - after / before) * 100, 2)).otherwise(F.lit(0.0))


def size_text(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """Bytes by steps of 1024 with one decimal."""
    value = n.cast("double")
    out = F.concat(F.format_string("%.1f", F.bround(value / 1024.0 ** (len(units) - 1), 1)), F.lit(f" {units[-1]}"))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(value < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(value / 1024.0**k, 1)), F.lit(f" {units[k]}"))).otherwise(out)
    return out


def count_text(n: Column) -> Column:
    """A number with blanks between thousands."""
    return F.regexp_replace(F.format_number(n, 0), ",", " ")


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def extension(path: Column) -> Column:
    """Last extension in small letters with its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
