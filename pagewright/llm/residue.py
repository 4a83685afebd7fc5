"""Problem 10: template residue, filler, error pages and notices that scripts are needed.

Texts are read as units (sentences and lines of their own). Trusted labels come from fixed forms: a unit that is a
message or filler is residue; a sentence that explains templates, variables or error codes is none. A document with
an unfilled placeholder outside such a sentence is a case by itself. Residue is then spread over near-duplicates:
two units whose five-word shingles have a Jaccard similarity of 0.8 or more always share one of the first few shingles
in the order of their hashes (prefix filtering), so a join on those misses no pair; the similarity itself verifies
them, and each round's new units are asked in the next one until none is added, which labels the connected components
that hold trusted residue. All numbers made of digits only count as one word. Units are counted once for all their
copies before tables are joined, so hot copies never meet each other.

Defined results: null, empty and blank texts are no case; a document given twice comes out once.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.forms import consistent, may_change
from pagewright.session import checkpoint_folder, cut_lineage
from pagewright.tables import table

SHINGLE, SIMILARITY = 5, 0.8
#: A unit of n shingles shares one of its first n // PREFIX + 1 with every unit at SIMILARITY: n less 0.8 n rounded up, and one.
PREFIX = 5

_NAME = r"[^\W\d][\w.]{0,40}"
# Words that fill a bracket in place of a value, in the five languages.
_FILL = (
    r"insert|enter|your|here|client|customer|name|to be completed|fill in|tbd|todo|date|address"
    r"|insérer|votre|ici|à compléter|à remplir|nom|prénom|adresse|insertar|aquí|su|por completar|rellenar|nombre|cliente|fecha"
    r"|einfügen|hier|ihr|noch ausfüllen|ausfüllen|kunden|datum|inserire|qui|vostro|da completare|compilare|nome|data"
)
PLACEHOLDER = re.compile(
    rf"%\({_NAME}\)[sd]|\{{\{{ ?{_NAME} ?\}}\}}|\$\{{ ?{_NAME} ?\}}|<%=? ?{_NAME} ?%>|%%{_NAME}%%|@@{_NAME}@@|<<{_NAME}>>|\[\[{_NAME}\]\]"
    rf"|(?<![\w#])#{_NAME}#(?![\w#])|(?<!\w)__[^\W\d_]\w{{0,38}}?__(?!\w)|(?<![\w\\{{}}])\{{{_NAME}\}}(?!\}})"
    rf"|\[(?=[^\]\n]*\b(?:{_FILL})\b)[^\[\]\n\d]{{2,40}}\]|<(?=[^>\n]*\b(?:{_FILL})\b)[^\W\d_]+(?: [^\W\d_]+){{1,5}}>"
    r"|\b(?:X{2}|D{2}|J{2}|T{2}|M{2}|G{2})([/.\-])(?:X{2}|M{2}|D{2})\1(?:X{2,4}|Y{2,4}|A{2,4}|J{2,4})\b",
    re.I,
)
# Words by which a sentence speaks of placeholders instead of holding one.
EXPLAINS = re.compile(
    r"\b(?:template|variable|placeholder|field|merge|mod[eè]le|champ|gabarit|\w*vorlage|feld|platzhalter|plantilla|campo|marcador|modello|segnaposto"
    r"|variabile)s?\b",
    re.I,
)
# Openings of sentences that tell what to do about an error.
TELLS = re.compile(r"\W*(?:when(?:ever)?|if|quand|lorsque?|si|cuando|quando|se|wenn|falls|meldet|sobald)\b", re.I)
# Messages of error pages and notices about scripts.
MESSAGE = re.compile(
    r"\b(?:error|erreur|fehler|errore)\W{0,3}[45]\d\d\b|\b[45]\d\d\W{1,4}(?:page not found|internal server error|not found|bad gateway|service unavailable|forbidden"
    r"|gateway time-?\s?out|unauthorized)|\b(?:page not found|internal server error|gateway time-?\s?out|bad gateway|service unavailable)\b"
    r"|\berreur interne du serveur|\binterner serverfehler|\berror interno del servidor|\berrore interno del server"
    r"|page demandée est introuvable|seite wurde nicht gefunden|no se (?:encuentra|ha encontrado) la página|pagina non (?:è stata )?trovata"
    r"|\b(?:access denied|accès refusé|zugriff verweigert|acceso denegado|accesso negato)\b"
    r"|\bpage (?:can(?:['’]t|not)|could not) be found|page (?:you requested |requested )?(?:was not found|does not exist)"
    r"|session (?:has )?expired|session a expiré|sitzung ist abgelaufen|sesión ha (?:caducado|expirado)|sessione è scaduta"
    r"|service (?:is )?temporarily unavailable|service est (?:momentanément|temporairement) indisponible|dienst ist vorübergehend nicht (?:erreichbar|verfügbar)"
    r"|servicio no está disponible|servizio non è (?:al momento |momentaneamente )?disponibile"
    r"|\b(?:enable|activez|activer|aktivieren sie|active|activar?|(?:switch|turn) on|attivare|attivi|attiva|abilitare) (?:\w+ )?javascript\b|javascript (?:is )?(?:required|disabled|aktivieren)"
    r"|needs? scripts? to run|not support scripts|requires? (?:scripts|javascript)|nécessite l['’]exécution de scripts|bloque les scripts|skripte im browser"
    r"|navegador (?:ejecute|bloquea|no admite) (?:los )?scripts|richiede gli script|browser (?:blocca|non supporta) gli script|browser (?:blockiert|unterstützt) (?:keine )?skripte",
    re.I,
)
# Filler texts, and words of the Latin filler.
FILLER = re.compile(
    r"\b(?:your text (?:goes )?here|votre texte ici|ihr text (?:steht )?hier|(?:su|tu) texto (?:va )?aquí|il (?:vostro|suo|tuo) testo qui|lorem ipsum|placeholder text|texte de remplissage"
    r"|blindtext|texto de relleno|testo di riempimento|dummy text|coming soon)\b",
    re.I,
)
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis
    nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur
    excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim laborum rerum porta ferox aliquam velum vitae nostra ordo
    labor eum corpora fugit quasi turba""".split()
)
WORD = re.compile(r"[^\W_]+")
_WRAPPED = re.compile(r"\n(?<=[^\s.!?:;|]\n)(?=[a-zß-ÿ])|\n(?<=[^\s.!?:;|][ \r]\n)(?=[a-zß-ÿ])")
_NEXT = re.compile(r" (?:(?<=[.!?] )|(?<=[.!?][\"'»”’)\]] ))\s*(?=[\"'«“„(\[<{]*[^\W\da-zß-ÿ])")
RESIDUE, PLAIN, OPEN = 2, 1, 0


def units(text: str) -> list[str]:
    """Sentences and lines of their own; a line that goes on in small letters is joined to the next."""
    return [u for line in _WRAPPED.sub(" ", text).split("\n") if line and not line.isspace() for u in _NEXT.split(line.strip())]


def has_placeholder(unit: str) -> bool:
    return bool(PLACEHOLDER.search(unit)) and not EXPLAINS.search(PLACEHOLDER.sub(" ", unit))


def label(unit: str, words: list[str]) -> int:
    """RESIDUE for messages, notices and filler, PLAIN for sentences about them, OPEN for the rest."""
    if MESSAGE.search(unit):
        return PLAIN if TELLS.match(unit) else RESIDUE
    if FILLER.search(unit):
        return RESIDUE
    return RESIDUE if is_latin(words) or is_one_letter(words) else OPEN


def is_latin(words: list[str]) -> bool:
    """Whether words of the Latin filler make up most of a unit."""
    return len(words) >= 5 and sum(w in LATIN for w in words) * 5 >= len(words) * 3


def is_one_letter(words: list[str]) -> bool:
    """Whether most words of a unit are one letter written again and again, as in xxx xxxxx xx."""
    return len(words) >= 4 and sum(len(w) > 1 and w.isalpha() and w == w[0] * len(w) for w in words) * 5 >= len(words) * 3


# Parts of words without which a text holds no message and no filler.
HINTS = (
    "script", "skript", "error", "erreur", "fehler", "gateway time", "bad gateway", "not found", "be found", "does not exist", "introuvable",
    "nicht gefunden", "no se encuentra", "encontrado", "trovata", "denied", "accès refus", "verweigert", "denegado", "negato", "expir", "abgelaufen",
    "caducado", "scaduta", "unavailable", "forbidden", "unauthorized", "indisponible", "erreichbar", "verfügbar", "está disponible", "disponibile",
    "your text", "votre texte", "ihr text", "texto aqu", "texto va", "testo qui", "lorem", "ipsum", "placeholder", "remplissage", "blindtext", "relleno",
    "riempimento", "dummy text", "coming soon",
)
# What every placeholder holds, a sign or the middle of a date between two equal signs.
_SIGNS = ("{", "[", "<", "%", "@", "#", "__", *(f"{x}{m}{x}" for x in "/.-" for m in ("xx", "mm", "dd")))


def prefixes(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For groups of so many word numbers in a row, the number of distinct shingles and the first of them in the order of
    their hashes, cut to 32 bits; a unit of fewer than SHINGLE words is near no other and has none."""
    n = np.maximum(sizes - SHINGLE + 1, 0)
    ends = np.cumsum(n)
    group = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k])
    order = np.lexsort((h, group))
    h, group = h[order], group[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (group[1:] == group[:-1])
    h, group = h[~again], group[~again]
    distinct = np.bincount(group, minlength=len(sizes))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    first = rank < (distinct // PREFIX + 1)[group]
    kept = np.where(distinct > 0, distinct // PREFIX + 1, 0)
    return distinct, np.split((h[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.cumsum(kept)[:-1])


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def word_codes(words: list[str]) -> np.ndarray:
    """64-bit numbers of words, worked out once per distinct word; all numbers made of digits only count as one word."""
    import xxhash

    at, distinct = pd.factorize(np.array(words, dtype=object))
    return np.array([xxhash.xxh64_intdigest("0" if w.isdigit() else w) for w in distinct], np.uint64)[at]


def jaccard(a: str, b: str) -> float:
    """Similarity of the five-word shingles of two word lists, whole lists where they are shorter; numbers count as one word."""

    def shingles(t: str) -> set[tuple[str, ...]]:
        w = ["0" if x.isdigit() else x for x in t.split(" ")]
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


#: So many words are numbered at once, which bounds the memory of a worker.
WORDS_AT_ONCE = 300_000


def labelled_units(text: str):
    """(kind, words in small letters) of each unit; 3 for a unit with a placeholder."""
    if may_change(text):
        text = consistent(text)
    low = text.lower()
    hint, sign = any(x in low for x in HINTS), any(x in low for x in _SIGNS)
    for u in units(text):
        words = WORD.findall(u.lower())
        if not words:
            continue
        if sign and has_placeholder(u):
            yield 3, words
        elif hint:
            yield label(u, words), words
        else:
            yield RESIDUE if words[0] in LATIN and is_latin(words) or is_one_letter(words) else OPEN, words


def coded(rows: list[tuple], flat: list[str]) -> pd.DataFrame:
    """Units with their number, of words with their left neighbour, so that order counts, and the shingles they are found by."""
    out = pd.DataFrame(rows, columns=["key", "kind", "size", "words"])
    codes, sizes = word_codes(flat), out["size"].to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.roll(codes, 1)
    left[starts] = 0
    with np.errstate(over="ignore"):
        pairs = mix(codes * np.uint64(0x9E3779B97F4A7C15) + left)
        out["unit"] = np.add.reduceat(mix(pairs + codes), starts).view(np.int64)
    out["shingles"], out["prefix"] = prefixes(codes, sizes)
    return out[["key", "unit", "shingles", "prefix", "kind", "words"]]


def read_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, shingles, prefix, kind, words): the distinct units of each row; kind 3 marks a row with a placeholder, without a unit."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        rows: list[tuple] = []
        flat: list[str] = []
        for b in batches:
            for k, t in zip(b["key"].tolist(), b["text"].tolist()):
                for kind, words in labelled_units(t):
                    rows.append((k, kind, len(words), " ".join(words) if kind < 3 else ""))
                    flat += words
                if len(flat) > WORDS_AT_ONCE:
                    yield coded(rows, flat)
                    rows, flat = [], []
        if rows:
            yield coded(rows, flat)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(r"text rlike '[^\\s\\p{Z}]'")
    return rows.mapInPandas(run, f"key {kind}, unit long, shingles int, prefix array<int>, kind int, words string")


def residue_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the rows that hold residue, once each.

    The units are written once to the shared folder, as are those that residue may spread to, once each; both are removed
    when the result stands or the way to it fails.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/residue-{uuid.uuid4().hex}"
    try:
        return cut_lineage(_spread(df, key, text, path))
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _spread(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    spark = df.sparkSession
    read_units(df, key, text).write.option("compression", "zstd").parquet(f"{path}/units")
    told = spark.read.parquet(f"{path}/units")
    each = told.where("kind < 3").groupBy("unit").agg(F.max("kind").alias("kind"), *(F.first(c).alias(c) for c in ("shingles", "prefix")))
    each.where(f"kind = {OPEN}").select("unit", "shingles", F.explode("prefix").alias("first")).write.option("compression", "zstd").parquet(f"{path}/sought")
    sought = spark.read.parquet(f"{path}/sought")

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], index=a.index, dtype=float)

    def once(rows: DataFrame) -> DataFrame:
        """unit, shingles, prefix, words of those units."""
        return rows.groupBy("unit").agg(*(F.first(c).alias(c) for c in ("shingles", "prefix")), F.min("words").alias("words"))

    found = asked = cut_lineage(once(told.where(f"kind = {RESIDUE}")))
    while True:  # every round but the last adds a unit, and there are only so many
        near = asked.select(F.col("unit").alias("near"), F.col("shingles").alias("near_shingles"), F.explode("prefix").alias("first"))
        pairs = sought.join(near, "first").where("5 * least(shingles, near_shingles) >= 4 * greatest(shingles, near_shingles)")
        pairs = cut_lineage(pairs.select("unit", "near").distinct().join(found.select("unit"), "unit", "left_anti"))
        if pairs.isEmpty():
            break
        texts = once(told.where("kind < 3").join(pairs.select("unit").distinct(), "unit", "left_semi"))
        by = asked.select(F.col("unit").alias("near"), F.col("words").alias("near_words"))
        new = texts.join(pairs, "unit").join(by, "near").where(similar("words", "near_words") >= SIMILARITY)
        asked = cut_lineage(new.select("unit", "shingles", "prefix", "words").dropDuplicates(["unit"]))
        if asked.isEmpty():
            break
        found = cut_lineage(found.unionByName(asked))
    direct = told.where("kind = 3").select("key")
    spread = told.where("kind < 3").select("key", "unit").join(found.select("unit"), "unit", "left_semi").select("key")
    return direct.union(spread).distinct().withColumnRenamed("key", key)


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source and lang of the documents without residue, each row as often as it stands in the table."""
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", "source", "lang").join(residue_rows(documents), "doc_id", "left_anti")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of the documents that hold residue."""
    return residue_rows(table(spark, folder, "documents"))
