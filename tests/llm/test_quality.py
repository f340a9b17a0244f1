import math
import random
import re
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.storage import crc_mod

SCHEMA = "doc_id long, text string, quality int, score string"


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.predicted == 1 for r in good]) >= 0.98
    assert np.mean([r.predicted == 0 for r in bad]) >= 0.75
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1


def test_column_agrees_with_the_model(spark):
    rng = np.random.default_rng(2)
    table = {"a": rng.normal(size=400), "b": rng.normal(size=400)}
    label = ((table["a"] > 0.3) & (table["b"] < 0.5)).astype(float)
    model = quality.train(table, label)
    assert 0 < len(model.weights) < 40
    want = model.score(table)
    assert np.mean((want >= 0.5) == label) > 0.97
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(table["a"], table["b"], strict=True)], "a double, b double")
    got = [r.s for r in df.select(model.column().alias("s")).collect()]
    assert got == pytest.approx(want.tolist())


def brute_statistics(text):
    text = text or ""
    space = " \t\n\x0b\f\r"
    words = [w for w in re.split(f"[{space}]+", text) if w]
    lines, n = text.split("\n"), len(words)
    per = lambda x, of: x / of if of else 0.0
    runs = [w.translate({c: c + 32 for c in range(65, 91)}) for w in regex.findall(r"[\p{L}\p{N}]+", text)]
    chunks, repeats = regex.findall(f"[^{space}]+", text), 0
    again = False
    for a, b in zip(chunks, chunks[1:], strict=False):
        repeats += a == b and not again
        again = a == b
    return {
        "log_chars": math.log1p(len(text)), "log_words": math.log1p(n), "word_length": per(len(text), n), "distinct_words": per(len(set(words)), n), "root_distinct": per(len(set(words)), math.sqrt(n)),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "line_length": len(text) / len(lines), "upper": per(sum(unicodedata.category(c) == "Lu" for c in text), len(text)),
        "digits": per(sum(c in "0123456789" for c in text), len(text)), "symbols": per(len(regex.findall(rf"[^\p{{L}}\p{{N}}{space}.,;:'\"!?()-]", text)), len(text)),
        "marks": per(text.count("!") + text.count("?"), len(text)), "stops": per(text.count(".") + text.count(","), n), "repeats": per(repeats, n), "function_words": per(sum(w in set(quality.FUNCTION_WORDS) for w in runs), n),
    }


def test_statistics_against_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [None, "", " ", "\n\n", "a a a b b a", "É é ÉCOLE der DER The-the the1", "x" * 5000, "la la la\nla la", "1,2.3!? # $ €", "a a\u00a0a a", "word\x0bword \t word"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in df.select("i", *(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).collect():
        want = brute_statistics(texts[r.i])
        assert {n: float(r[n]) for n in want} == pytest.approx(want, rel=1e-9, abs=1e-12), texts[r.i]


def test_the_first_split_is_the_best():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    g, h = rng.normal(size=300) + (x[:, 1] > 6), np.full(300, 0.25)
    bins = [np.unique(x[:, f])[:-1] for f in range(3)]
    codes = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bins)], 1)
    paths = quality._grow(x, bins, codes, g, h, 1, 1.0)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((f, t) for f in range(3) for t in bins[f] if h[x[:, f] <= t].sum() >= 1 and h[x[:, f] > t].sum() >= 1), key=lambda s: gain(x[:, s[0]] <= s[1]) + gain(x[:, s[0]] > s[1]))
    assert {(f, t) for terms, _ in paths for f, _, t in terms} == {best}
    for terms, value in paths:
        (f, above, t), = terms
        m = x[:, f] > t if above else x[:, f] <= t
        assert value == pytest.approx(-g[m].sum() / (h[m].sum() + 1))


def test_weights_are_those_of_the_lasso():
    """At the least of loss and penalty, a rule's gradient equals the penalty, against the sign of its weight."""
    rng = np.random.default_rng(6)
    table = {"a": rng.normal(size=500), "b": rng.normal(size=500)}
    label = ((table["a"] > 0.2) ^ (rng.random(500) < 0.1)).astype(float)
    penalty = 5e-3
    model = quality.train(table, label, trees=6, penalty=penalty, steps=4000)
    p = model.score(table)
    assert abs((p - label).mean()) < 1e-4
    for rule, w in model.weights.items():
        slope = rule.holds(table).astype(float) @ (p - label) / 500
        assert slope == pytest.approx(-penalty * np.sign(w), abs=2e-4)


def test_rows_that_share_an_id_give_the_same_model(spark):
    rows = [(i % 40, f"{'good words of prose that flow ' * 5 if i % 2 else 'X!! ' * 20} {i}", 0, "") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    runs = [quality.score_quality(spark.createDataFrame(rows, SCHEMA).repartition(n).orderBy(F.rand(n)), labels).collect() for n in (2, 5)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))


def test_odd_rows_and_labels(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "word", "and", "other", "thing"]) for _ in range(50)), 0, "") for i in range(60)]
    rows += [(100 + i, "BUY!!! " * 30, 0, "") for i in range(60)] + [(900, None, 0, ""), (901, "", 0, ""), (None, "x", 0, ""), (902, "word " * 40_000, 0, ""), (903, "same", 0, ""), (903, "same", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(5, 1, 1), (900, None, 0), (None, 1, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == (1 if r.doc_id < 60 else 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    none = quality.score_quality(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(df.limit(0), labels).count() == 0
    held = {r.doc_id for r in df.where(crc_mod(df.doc_id, 5) == 0).collect()}
    assert {r.doc_id for r in got if r.held_out} == held
