import random
import re
import unicodedata

import numpy as np
import pytest

from pagewright.llm import leaks, repetition, tokenize


def brute_share(text):
    w = re.findall(r"[^\W\d_]+", text.casefold())
    seen, marked = set(), set()
    for i in range(len(w) - 7):
        k = tuple(w[i : i + 8])
        if k in seen:
            marked |= set(range(i, i + 8))
        seen.add(k)
    return len(marked) / len(w) if w else 0.0


def random_text(r, n, vocabulary=12):
    return " ".join(r.choice([f"{chr(97 + i)}x" for i in range(vocabulary)]) + r.choice(["", ".", " 7", "\r\n"]) for _ in range(n))


def test_repeated_share_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        t = random_text(r, r.randrange(60), r.choice([2, 4, 30]))
        if r.random() < 0.5:
            t += " " + t[: r.randrange(len(t) + 1)]
        exact = brute_share(t)
        assert repetition.repeated_share(t) == pytest.approx(exact)
        for rule in repetition.RULES:
            assert rule(repetition.Words(t)) >= exact - 1e-9


def test_repeated_documents(spark):
    part = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, 0, part, 9), (1, 1, part.upper() + " 3.", 9), (1, 1, part.upper() + " 3.", 9), (2, 0, part, 9), (2, 1, None, 9), (3, 0, "", 9), (None, 0, part + " " + part, 9)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, content string, share int")
    assert sorted((r.doc_id or 0, r.share) for r in repetition.repeated_documents(df).collect()) == [(0, 0.5), (1, 0.5)]
    assert {(r.doc_id, r.share) for r in repetition.repeated_documents(df, 0.0).collect()} == {(None, 0.5), (1, 0.5), (2, 0.0), (3, 0.0)}
    assert repetition.repeated_documents(df.limit(0)).count() == 0


def test_large_documents_take_another_way(spark, monkeypatch):
    monkeypatch.setattr(repetition, "BLOCK", 16)
    monkeypatch.setattr(repetition, "SPAN", 3)
    r = random.Random(4)
    rows = []
    for doc in range(8):
        part = random_text(r, 30, 200)
        rows += [(doc, i, part if r.random() < 0.4 else random_text(r, r.randrange(40), 200)) for i in range(12)]
    rows += [(8, 0, "1 2 3 " * 30), (8, 1, None), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, pos int, content string")
    usual = {x.doc_id: x.share for x in repetition.repeated_documents(df, 0.0).collect()}
    large = {x.doc_id: x.share for x in repetition.repeated_documents(df, 0.0, whole=100).collect()}
    assert any(0.1 < x < 0.9 for x in usual.values())
    assert {k: v for k, v in usual.items() if k < 8} == pytest.approx(large)
    monkeypatch.setattr(repetition, "MOST_LARGE", 3)
    assert {x.doc_id: x.share for x in repetition.repeated_documents(df, 0.0, whole=100).collect()} == pytest.approx(large)


def test_rules_are_ordered_by_what_they_reject_of_what_is_left():
    r = random.Random(2)
    texts = [random_text(r, 40, 200) for _ in range(20)] + ["a b", "c"]
    rules = repetition.order_rules(texts, 0.3)
    assert rules and len(set(rules)) == len(rules) <= len(repetition.RULES)
    assert [repetition.repeated_share(t, 0.3, rules) >= 0.3 for t in texts] == [brute_share(t) >= 0.3 for t in texts]
    assert repetition.order_rules([], 0.3) == [repetition.bound_by_length]


def test_tree_joins_are_exact(spark):
    e = tokenize.Encoder(open(tokenize.vocabulary_file(), "rb").read())
    r = random.Random(5)
    pieces = ["le réseau ", "don't ", "1234567", "    ", "\n\n", "ééé", "資料は", "👩‍🔧", "!!!???", "a" * 90, "日" * 60, "'s", " x", "9" * 80, "\t", "—"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 200))) for _ in range(150)] + ["a" * 5000, "ab" * 3000, " " * 3000, "!" * 3000, "7" * 3000, "".join(r.choices("abcdefgh", k=6000))]
    for t in texts:
        for leaf in (64, 333):
            assert e.tree([e.encode(t[i : i + leaf]) for i in range(0, len(t), leaf)]) == e.encode(t)


def test_token_ids(spark):
    long = "mot réseau 資料 " * 50
    rows = [(1, None, 0), (2, "", 0), (3, "a<|endoftext|>b", 0), (4, long, 0), (4, long, 0), (5, long + "x", 0), (4, "short", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    e = tokenize.Encoder(open(tokenize.vocabulary_file(), "rb").read())
    expected = sorted((k, e.encode(t or "")) for k, t, _ in rows)
    assert sorted((r.doc_id, r.ids) for r in tokenize.token_ids(df, leaf=100).collect()) == expected
    assert sorted((r.doc_id, r.ids) for r in tokenize.token_ids(df).collect()) == expected
    assert tokenize.token_ids(df.limit(0)).count() == 0


def test_ids_equal_those_of_another_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = tokenize.Encoder(open(tokenize.vocabulary_file(), "rb").read())
    for text in ("L'été à 12 h 30 — don't!", "  \n x\t", "<|endoftext|>", "資料 👩‍🔧"):
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def brute_leaks(docs, items):
    def words(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).casefold()
        return re.findall(r"[^\W_]+", t)

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    own = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, g in own.items() if g & grams(t)}


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice("été zoo Ñandú x y 12 b c".split()) + str(r.randrange(30)) for _ in range(r.choice([5, 12, 13, 40])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(250):
        w = [f"w{r.randrange(400)}" for _ in range(r.choice([0, 3, 10, 30, 300]))]
        if r.random() < 0.7:
            part = (items[r.randrange(30)][1]).split()
            k, n = r.randrange(len(part)), r.choice([8, 11, 12, 13, 24, 40])
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if r.random() < 0.3 else x for x in part[k : k + n]]
        docs.append((d, r.choice([" ", "\n", ", "]).join(w)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    it = spark.createDataFrame(items + items[:3], "item_id long, text string")
    expected = brute_leaks(docs, items)
    assert {(a, b) for a, b in leaks.leaked(df, it).collect()} == expected and len(expected) > 10
    assert {(a, b) for a, b in leaks.leaked(df, it, block_chars=0).collect()} == expected
    assert leaks.leaked(df, it.limit(0)).count() == 0 and leaks.leaked(df.limit(0), it).count() == 0


def test_every_passage_shares_its_minhash_with_its_window():
    r = random.Random(9)
    words = [f"w{r.randrange(300)}" for _ in range(400)]
    whole = leaks.Windows([" ".join(words), "a b c", None, " ".join(words[:12])], leaks.Numbers())
    assert len(whole.starts) == 400 - 11 + 1
    for at in range(0, 389, 17):
        own = leaks.Windows([" ".join(words[at : at + 12])], leaks.Numbers())
        assert own.minhash.tolist() == [whole.minhash[at]] and own.passages(np.array([0])) == whole.passages(np.array([at]))
    assert len(leaks.Windows([], leaks.Numbers()).starts) == len(leaks.Windows([None, "a"], leaks.Numbers()).starts) == 0
