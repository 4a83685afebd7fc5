"""SQL of the queries, for an engine with RE2 expressions, lambdas and list functions."""

from __future__ import annotations

import unicodedata

from pagewright.operators.render import NEEDS_QUOTES as YAML_QUOTED

# The same patterns and thresholds as in operators/pages.py, in the syntax of RE2.
BLANKS = "\t-\r\x1c-\x20\x85\xa0  -     　"
LF, CR = "chr(10)", "chr(13)"


def quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^[{BLANKS}]+|[{BLANKS}]+$')}, '', 'g')"


def blank(x: str) -> str:
    return f"NOT regexp_matches({x}, {quoted(f'[^{BLANKS}]')})"


def lines(x: str) -> str:
    pattern = quoted("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    parts = f"string_split_regex({x}, {pattern})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {quoted(f'[^{BLANKS}]+')})) AS BIGINT)"


def percent(after: str, before: str, digits: int = 2) -> str:
    """Half to even by the shortest digits of the double, as a double scaled up before rounding may be another one."""
    return f"CASE WHEN {before} > 0 THEN round_even(CAST(CAST((1 - CAST({after} AS DOUBLE) / {before}) * 100 AS VARCHAR) AS DECIMAL(38, 18)), {digits})::DOUBLE ELSE 0.0::DOUBLE END"


def tokens(x: str) -> str:
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, length({x}) // 4) END AS BIGINT)"


def normalize(x: str) -> str:
    """Compatibility forms of the blocks that the tables use, then canonical composition."""
    single, longer = {}, {}
    for first, last in ((0xA0, 0xFF), (0x132, 0x17F), (0x2000, 0x206F), (0x2070, 0x209F), (0x2100, 0x2188), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF01, 0xFFEE)):
        for c in map(chr, range(first, last + 1)):
            n = unicodedata.normalize("NFKC", c)
            if n != unicodedata.normalize("NFC", c):
                (single if len(n) == 1 else longer)[c] = n
    out = f"translate({x}, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    for a, b in longer.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"nfc_normalize({out})"


def invisible(x: str) -> str:
    return f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}\\p{{Co}}]', '', 'g')"


def ligatures(x: str) -> str:
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"


def whitespace(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\x{{a0}}]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g')"


def newlines(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def dedup(x: str, least: int = 3) -> str:
    paragraphs = f"string_split({x}, chr(10) || chr(10))"
    keys = f"list_transform({paragraphs}, lambda q: {strip('q')})"
    key = strip("p")
    return (
        f"array_to_string(list_filter({paragraphs}, lambda p, i: {key} = '' OR len(list_filter({keys}, lambda k: k = {key})) < {least}"
        f" OR list_position({keys}, {key}) = i), chr(10) || chr(10))"
    )


def punctuation(x: str) -> str:
    return rf"coalesce(array_to_string(list_filter({lines(x)}, lambda s: length({strip('s')}) < 3 OR regexp_matches(s, '[\p{{L}}\p{{N}}]')), chr(10)), '')"


def finalize(x: str) -> str:
    return strip(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


#: Steps by name, in order.
STEPS = (
    ("normalize_unicode", normalize), ("strip_invisibles", invisible), ("convert_ligatures", ligatures), ("rejoin_hyphenated", hyphens),
    ("collapse_whitespace", whitespace), ("limit_consecutive_newlines", newlines), ("dedup_paragraphs", dedup),
    ("strip_punctuation_only_lines", punctuation), ("limit_consecutive_newlines", newlines), ("finalize", finalize),
)


def chain(source: str, keys: str, text: str = "text", steps=STEPS) -> str:
    """CTEs s0 to sN with the text after each step as c0 to cN; source is a select or table."""
    out = [f"s0 AS (SELECT {keys}, {text} AS c0 FROM {source})"]
    for i, (_, step) in enumerate(steps, 1):
        out.append(f"s{i} AS (SELECT *, {step(f'c{i - 1}')} AS c{i} FROM s{i - 1})")
    return ", ".join(out)


#: The dirt of queries.dirty in the same order.
DIRTY = (
    "d1 AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'ti', 't-' || chr(10) || 'i') ELSE text END AS t FROM documents WHERE text IS NOT NULL), "
    "d2 AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN replace(t, '. ', '.  ' || chr(9) || ' ') ELSE t END AS t FROM d1), "
    "d3 AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN replace(t, chr(10), repeat(chr(10), 4)) ELSE t END AS t FROM d2), "
    "d4 AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN t || chr(10) || chr(10) || t || chr(10) || chr(10) || t WHEN doc_id % 4 = 1 THEN t || chr(10) || chr(10) || t ELSE t END AS t FROM d3), "
    "d5 AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 1 THEN t || chr(10) || '---' || chr(10) || chr(10) || '???' || chr(10) || '!!' || chr(10) || '| --- | --- |' || chr(10) ELSE t END AS t FROM d4), "
    "d6 AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS t FROM d5), "
    "dirty AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 1 THEN replace(replace(t, 'e ', 'e​ '), 'fi', 'ﬁ') ELSE t END AS text FROM d6)"
)
PAGES = "pages AS (SELECT doc_id, pos AS page_idx, max(coalesce(content, '')) AS text FROM sections WHERE header LIKE 'Page %' GROUP BY 1, 2)"
PAGE_NUMBER = rf"(?i)^(?:page|p\.?)[{BLANKS}]*\p{{Nd}}+(?:[{BLANKS}]*[/-][{BLANKS}]*\p{{Nd}}+)?$"
RECURRING = (
    PAGES
    + f", filled AS (SELECT doc_id, page_idx, list_filter(list_transform({lines('text')}, lambda x: {strip('x')}), lambda x: x <> '') AS f FROM pages), "
    "outerl AS (SELECT DISTINCT doc_id, page_idx, unnest(list_concat(f[:3], f[-3:])) AS line FROM filled), "
    "sizes AS (SELECT doc_id, count(*) AS total FROM pages GROUP BY 1), "
    "rec AS (SELECT o.doc_id, o.line, count(*) AS n_pages FROM outerl o JOIN sizes s USING (doc_id) WHERE s.total >= 3 GROUP BY o.doc_id, o.line, s.total"
    " HAVING count(*) >= greatest(2, floor(s.total * 0.30::DOUBLE)))"
)
STRIPPED = (
    RECURRING
    + f", ln AS (SELECT p.doc_id, p.page_idx, u.x, u.i FROM pages p, unnest({lines('p.text')}) WITH ORDINALITY AS u(x, i)), "
    f"kept AS (SELECT l.doc_id, l.page_idx, string_agg(l.x, chr(10) ORDER BY l.i) AS text FROM ln l LEFT JOIN rec r ON r.doc_id = l.doc_id AND r.line = {strip('l.x')}"
    f" WHERE r.line IS NULL AND NOT regexp_matches({strip('l.x')}, {quoted(PAGE_NUMBER)}) GROUP BY 1, 2), "
    "stripped AS (SELECT p.doc_id, p.page_idx, coalesce(k.text, '') AS text FROM pages p LEFT JOIN kept k USING (doc_id, page_idx))"
)
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_AFTER = r"(?:[^\p{L}\p{N}_]|$)"
TOC_TITLE = rf"(?i){_EDGE}(?:sommaire|table\s+des\s+mati[èe]res|table\s+of\s+contents|contents){_AFTER}"
BIBLIOGRAPHY_TITLE = rf"(?i){_EDGE}(?:bibliographie|r[ée]f[ée]rences(?:\s+bibliographiques)?|references|works\s+cited|sources(?:\s+cit[ée]es)?|webographie){_AFTER}"
TOC_LINE = r"(?m)^\s*\S.{1,120}?(?:\.{3,}|\s{4,}|\t+)\s*\d{1,4}\s*$"
REFS = (r"\[\d{1,4}\]", r"\([A-Z][a-zéèêA-Z]+(?:\s+(?:et\s+al\.?|&)\s*[A-Z]?[a-z]*)?,?\s+\d{4}\)", r"(?m)^\s*\d{1,3}\.\s+[A-Z]")


def found(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def classified(source: str) -> str:
    """CTE cls over source(doc_id, page_idx, text)."""
    toc = f"(regexp_matches(text, {quoted(TOC_TITLE)}) OR {found(TOC_LINE, 'text')} >= 5)"
    refs = " + ".join(found(r, "text") for r in REFS)
    bib = f"(regexp_matches(text, {quoted(BIBLIOGRAPHY_TITLE)}) OR {refs} >= 8)"
    return (
        f"c1 AS (SELECT doc_id, page_idx, text, {word_count('text')} AS word_count, {toc} AS is_toc, {bib} AS is_bibliography FROM {source}), "
        "cls AS (SELECT *, NOT is_toc AND NOT is_bibliography AND word_count < 30 AS is_sparse FROM c1)"
    )


SENTENCE_END = r"[.!?:;»\")\]]$"
GOES_ON = rf"^[{BLANKS}]*[a-zàâäçéèêëîïôöùûüÿ,;\-)\]]"
LEADING = rf"^[{BLANKS}]*\p{{Nd}}{{1,4}}[{BLANKS}]+"


def goes_on(before: str, text: str) -> str:
    end = f"regexp_replace({before}, {quoted(f'[{BLANKS}]+$')}, '')"
    rest = f"regexp_replace({text}, {quoted(LEADING)}, '')"
    return f"coalesce(NOT ({blank(before)}) AND NOT ({blank(text)}) AND NOT regexp_matches({end}, {quoted(SENTENCE_END)}) AND regexp_matches({rest}, {quoted(GOES_ON)}), false)"


def yaml_text(x: str) -> str:
    """A text as a YAML scalar, for texts without control characters."""
    return f"CASE WHEN regexp_matches({x}, {quoted(YAML_QUOTED)}) THEN chr(39) || replace({x}, chr(39), chr(39) || chr(39)) || chr(39) ELSE {x} END"


def size_text(n: str, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> str:
    arms = [f"WHEN {n} < {1024.0 ** (k + 1)} THEN printf('%.1f', round_even({n} / {1024.0**k}, 1)) || ' {u}'" for k, u in enumerate(units[:-1])]
    return f"CASE {' '.join(arms)} ELSE printf('%.1f', round_even({n} / {1024.0 ** (len(units) - 1)}, 1)) || ' {units[-1]}' END"


def count_text(n: str) -> str:
    return f"replace(format('{{:,}}', {n}), ',', ' ')"
