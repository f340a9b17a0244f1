import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarry.llm import kneser_ney

SCHEMA = "doc_id long, text string, block string, held string"


def held(i, folds=10):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0


def discounts(counts):
    """Of counts 0, 1, 2 and more, as Chen and Goodman estimate them, within bounds where an estimate fails."""
    n = [0, *(sum(1 for c in counts if c == k) for k in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2
        out.append(min(max(d, 0.05), k))
    return out


def brute(rows, order):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by plain counting; START is 0."""
    docs = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)})), None]) for r in rows]
    words, grams = Counter(), Counter()
    for i, text in docs:
        if not held(i):
            words.update(text)
            padded = [0] * (order - 1) + text
            grams.update(tuple(padded[k : k + order]) for k in range(len(text)))
    n, v = sum(words.values()), len(words)
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts(c.values()) for k, c in counts.items()}
    after = defaultdict(lambda: [0, 0, 0, 0])
    for c in counts.values():
        for g, m in c.items():
            after[g[:-1]][0] += m
            after[g[:-1]][min(m, 3)] += 1

    def p(gram):
        if not gram:
            return 1 / (v + 1)
        m, one, two, more = after[gram[:-1]] if gram[:-1] in after else (0, 0, 0, 0)
        if not m:
            return p(gram[1:])
        k, own = len(gram), counts[len(gram)][gram]
        return max(own - d[k][min(own, 3)], 0) / m + (d[k][1] * one + d[k][2] * two + d[k][3] * more) / m * p(gram[1:])

    if grams:
        for g in [*list(grams)[:4], ("nowhere",) * order]:
            assert sum(p((*g[:-1], w)) for w in words) + p((*g[:-1], "unheard of")) == pytest.approx(1)
    out = []
    for i, text in docs:
        padded = [0] * (order - 1) + text
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        score = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(text)))
        out.append((i, held(i), len(text), sum(words[w] > 0 for w in text), n, base, score))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("tokens", "order"), [(2_000_000, 3), (700, 3), (60, 3), (60, 2), (2_000_000, 2), (300, 4)])
def test_against_brute_force(spark, tokens, order):
    rng = random.Random(9)
    words = ["the"] * 30 + [f"w{k}" for k in range(60)] * 2 + [f"r{k}" for k in range(500)]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice(words) for _ in range(rng.randrange(0, 40))).replace("w1", "É W1"), "", "") for i in range(150)]
    rows += [(200, None, "", ""), (201, "", "", ""), (202, " \n ", "", ""), (None, "the end", "", ""), (None, "the end", "", ""), (203, "The THE thE " * 400, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    same(kneser_ney.score_documents(df, tokens=tokens, order=order).collect(), brute(rows, order))


def test_contexts_of_frequent_words_are_split():
    """However often a word stands, a shard gets no more than a share of what follows it."""
    words = np.arange(100_000)
    deal = kneser_ney.Deal(64, np.array([5, 9]), np.array([40, 3]))
    after = lambda *context: np.bincount(deal.shard_of([np.full(len(words), c) for c in context], words), minlength=64)
    assert (after(5) > 0).sum() == 40 and after(5).max() < 2 * 100_000 / 40
    assert (after(5, 5) > 0).sum() == 40 and (after(5, 9) > 0).sum() == 3 and (after(9, 8) > 0).sum() == 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for order in (2, 3):
        got = kneser_ney.score_documents(docs, tokens=20_000, order=order).collect()
        same(got, brute(rows, order))
        unseen = [r for r in got if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_against_sql(spark, sf_dir):
    want = duckdb.sql(kneser_ney.ORACLE.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    got = kneser_ney.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens=5000).collect()
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_a_very_long_text(spark):
    rng = random.Random(10)
    rows = [(1, " ".join(f"w{int(3000 * rng.random() ** 3)}" for _ in range(60_000)), "", ""), (2, "w1 w2 w3", "", "")]
    same(kneser_ney.score_documents(spark.createDataFrame(rows, SCHEMA), tokens=10_000).collect(), brute(rows, 3))


def test_nothing_to_learn_from(spark):
    assert kneser_ney.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    i = next(i for i in range(100) if held(i))
    got = kneser_ney.score_documents(spark.createDataFrame([(i, "a b", "", "")], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0)]
