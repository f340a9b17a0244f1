import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, mark string, place string"


def rows_of(rows):
    return [(*r, *[""] * (6 - len(r))) for r in rows]


def brute_phrases(text, train):
    at, n, lacking = 0, 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in train:
            end += 1
        n, lacking = (n + 1, lacking) if text[at] in train else (n, lacking + 1)
        at = end if text[at] in train else at + 1
    return n, lacking


def brute_predict(texts, text):
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    own = plain(text)

    def bits(train):
        n, lacking = brute_phrases(own, train)
        return (n * math.log2(max(2, len(train))) + lacking * math.log2(0x110000)) / len(own)

    entropy = {k: bits(plain(t)) for k, t in texts.items()}
    best = min(sorted(entropy), key=entropy.get)
    others = [e for k, e in entropy.items() if k != best]
    return best, 1 - entropy[best] / min(others) if others else 1.0


def test_phrases_against_brute_force():
    rng = random.Random(3)
    for train in ("abcab bca aab", "bbb cc abcc", "q", "字本 語字", ""):
        start = language.suffix_automaton(train)
        for _ in range(80):
            text = "".join(rng.choice("abc qzß字本") for _ in range(rng.randrange(0, 60)))
            assert language.phrases(text, start) == brute_phrases(text, train)


def test_a_text_of_the_training_text_is_one_phrase():
    rng = random.Random(4)
    train = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    assert language.phrases(train[777:15_000], language.suffix_automaton(train)) == (1, 0)


def test_automaton_holds_all_substrings():
    text = "abaabcab"
    start, states = language.suffix_automaton(text), set()
    for i in range(len(text)):
        state = start
        for ch in text[i:]:
            state = state[ch]
            states.add(id(state))
    assert len(states) < 2 * len(text)


def test_languages_of_disjoint_large_alphabets():
    rng = random.Random(5)
    hans = [[chr(0x4E00 + 3000 * k + i) for i in range(3000)] for k in range(2)]
    write = lambda k: "".join(hans[k][int(3000 * rng.random() ** 2)] for _ in range(5000))
    parser = language.CrossParser({"a": write(1), "b": write(0), "ru": "привет как дела хорошо", "el": "καλημέρα τι κάνεις"})
    for k, name in ((0, "b"), (1, "a")):
        lang, score = parser.predict(write(k)[:300])
        assert lang == name and score > 0.05
    assert parser.predict("хорошо привет")[0] == "ru" and parser.predict("τι κάνεις;")[0] == "el"


def test_identify_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for options in ({}, {"chars": 700, "longest": 300}):
        texts = language.labelled_text(docs, **options)
        rows = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
        own = {k: [r.text for r in rows.values() if r.lang == k and zlib.crc32(str(r.doc_id).encode()) % 3 != 1] for k in texts}
        for k, t in texts.items():
            assert len(t) <= options.get("chars", 30_000)
            held = [x for x in t.split("\n") if x][:-1]  # the last may be cut
            assert held and all(any(x in whole for whole in own[k]) for x in held)
        for r in language.identify(docs, **options).collect():
            if len(rows[r.doc_id].text or "") < 3000:
                lang, score = brute_predict(texts, rows[r.doc_id].text)
                assert (r.lang_pred, r.held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
                assert r.score == pytest.approx(score)


def test_every_language_is_learnt(spark):
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{chr(97 + k * 7 % 26)}" for k in range(300)]
    rows = rows_of([(k, f"{w} {w}z {w}", f"l{k:03d}") for k, w in enumerate(words)])
    texts = language.labelled_text(spark.createDataFrame(rows, SCHEMA))
    assert set(texts) == {f"l{k:03d}" for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    long = [r for r in got if r.n_chars >= 40]
    assert np.mean([r.lang_pred == r.lang for r in long]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(20)] + [(20 + i, "der hund und die katze gehen heim", "de") for i in range(20)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "123 !?", "de"), (53, "字字字", None), (None, "und der hund", None), (None, "und der hund", None), (54, "und die " * 30_000, None)]
    rows += [(None, "le chat dort bien", "fr"), (None, "le chat dort bien", "fr")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows_of(rows), SCHEMA)).where("lang_pred <> 'fr'").collect()}
    assert [got[i].lang_pred for i in (50, 51, 52, 54, None, 3, 23)] == ["und", "und", "und", "de", "de", "en", "de"]
    assert got[50].score == 0
    assert language.identify(spark.createDataFrame(rows_of(rows), SCHEMA)).where("lang_pred = 'fr'").count() >= 2
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame(rows_of([(1, "some text", None)]), SCHEMA)
    assert language.identify(alone).collect()[0].lang_pred == "und"
