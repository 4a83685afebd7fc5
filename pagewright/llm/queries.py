"""Queries of this subpackage, and SQL for those that neither models, markup nor tokenizers decide."""

from pagewright.llm import encoding, forms, language, leaks, markup, quality, repetition, residue, scans, tokenize
from pagewright.plans import sql

QUERIES = {
    "p1_found": language.p1_found,
    "p1_segments": language.p1_segments,
    "p2_found": encoding.p2_found,
    "p2_restored": encoding.p2_restored,
    "p3_found": scans.p3_found,
    "p3_repaired": scans.p3_repaired,
    "p4_found": forms.p4_found,
    "p4_consistent": forms.p4_consistent,
    "p5_found": quality.p5_found,
    "p5_counts": quality.p5_counts,
    "p5_statistics": quality.p5_statistics,
    "p6_found": repetition.p6_found,
    "p7_found": markup.p7_found,
    "p7_clean": markup.p7_clean,
    "p8_ids": tokenize.p8_ids,
    "p9_found": leaks.p9_found,
    "p10_found": residue.p10_found,
    "p10_kept": residue.p10_kept,
}
_ONE = "one AS (SELECT doc_id, pos, max(content) AS t FROM sections GROUP BY 1, 2)"
_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
#: The words of each text of s(id, text), as w(id, w, i).
_WORDS = f"(SELECT s.id, u.w, u.i FROM s, unnest(regexp_extract_all(strip_accents(lower({sql.normalize('s.text')})), '[\\p{{L}}\\p{{N}}]+')) WITH ORDINALITY AS u(w, i))"
#: Its runs of twelve words.
_RUNS = f"SELECT id, run FROM (SELECT id, string_agg(w, ' ') OVER k AS run, count(*) OVER k AS n FROM {_WORDS} WINDOW k AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12"
ORACLE: dict[str, str] = {
    "p5_counts": f"WITH {_ONE}, l AS (SELECT doc_id, pos, t, NOT coalesce({sql.blank('t')}, true) AS filled, list_filter(list_transform({sql.lines('t')}, lambda x: {sql.strip('x')}), lambda x: x <> '') AS ls FROM one)"
    f" SELECT doc_id, pos, CASE WHEN filled THEN len(regexp_extract_all(t, '{_LETTERS}')) ELSE 0 END::INTEGER AS n_words,"
    f" CASE WHEN filled THEN len(regexp_extract_all(t, {sql.quoted('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + sql.BLANKS + ']')}))::DOUBLE / length(t) ELSE 0 END::DOUBLE AS symbol_ratio,"
    f" CASE WHEN filled THEN len(list_filter(ls, lambda x: regexp_matches(x, {sql.quoted('[.!?…:;][' + chr(34) + chr(39) + '»”’)' + chr(92) + ']]*$')})))::DOUBLE / len(ls) ELSE 0 END::DOUBLE AS line_end_share FROM l",
    "p6_found": "WITH one AS (SELECT doc_id, pos, max(content) AS t FROM sections WHERE content IS NOT NULL GROUP BY 1, 2), d AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) AS t FROM one GROUP BY 1),"
    f" w AS (SELECT d.doc_id, u.w, u.i FROM d, unnest(regexp_extract_all(lower(t), '{_LETTERS}')) WITH ORDINALITY AS u(w, i)),"
    " g AS (SELECT doc_id, i, string_agg(w, ' ') OVER k AS run, count(*) OVER k AS n FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),"
    " f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) AS first FROM g WHERE n = 8), c AS (SELECT DISTINCT f.doc_id, f.i + k.k AS i FROM f, range(8) AS k(k) WHERE first < f.i),"
    " s AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), x AS (SELECT doc_id, count(*) AS m FROM c GROUP BY 1) SELECT doc_id FROM s JOIN x USING (doc_id) WHERE m::DOUBLE / n >= 0.3",
    "p9_found": f"WITH q AS (WITH s AS (SELECT DISTINCT item_id AS id, text FROM eval_items WHERE text IS NOT NULL) SELECT DISTINCT id AS item_id, run FROM ({_RUNS})),"
    f" d AS (WITH s AS (SELECT DISTINCT doc_id AS id, text FROM documents WHERE text IS NOT NULL) {_RUNS}) SELECT DISTINCT d.id AS doc_id, q.item_id FROM d JOIN q USING (run)",
}
