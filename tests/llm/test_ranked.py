import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    total, length = len(tfs), sum(n for *_, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item in {i for i, _ in items}:
        own = set(terms(max((t for i, t in items if i == item and t is not None), default=None)))
        scores = []
        for i, c, n in tfs:
            m = 100 - 50 + (50 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own & c.keys())
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(400)]
    docs += [(400, None), (401, ""), (402, " ,.; "), (403, "Ünï W1, w2\x00w3"), (None, "w1 w2 w299"), (3, docs[3][1]), (3, docs[3][1]), (500, "long " * 30_000 + "w7"), *((600 + k, "tie tie w5") for k in range(30))]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "TIE ünï long"), (93, "a"), (None, "w5 tie"), (94, "w1 " * 9)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"k": 7, "block": 4, "postings": 300}, {"k": 1000, "postings": 1}])
def test_against_brute_force(spark, options):
    docs, items = corpus()
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, item_id string, `n.x` int")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked.ranked_search(df, asked, **options).collect()]
    want = brute(docs, items, options.get("k", 50))
    assert sorted(got, key=str) == want


def test_empty_tables(spark):
    docs, items = corpus()
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.ranked_search(df.limit(0), asked).count() == 0
    assert ranked.ranked_search(df, asked.limit(0)).count() == 0
    assert ranked.ranked_search(df.where("text is null"), asked).count() == 0


def test_stops_at_the_threshold():
    """Same best as scoring all, with a part of the look-ups; every tie at the kth place is seen."""
    rng = np.random.default_rng(1)
    n_docs, vocabulary = 20_000, 400
    rows = [np.unique((rng.pareto(0.8, 20) * 4).astype(int) % vocabulary) for _ in range(n_docs)]
    sizes = np.array(list(map(len, rows)))
    flat = np.concatenate(rows)
    n = rng.integers(20, 200, n_docs)
    make = lambda: ranked.Shard(rng.permutation(n_docs), n, sizes, flat, np.ones(len(flat), int), vocabulary, n_docs, int(n.sum()))
    shard, looked = make(), 0
    weights = ranked.weights_of(np.bincount(flat, minlength=vocabulary), n_docs)
    for asked in (np.array([390, 7, 311]), np.array([3]), np.array([200, 201, 202, 203])):
        own = np.zeros(vocabulary, np.int64)
        own[asked] = weights[asked]
        before = shard.looked_up
        docs, scores = shard.top(asked, own, 20)
        looked += shard.looked_up - before
        all_scores = shard.scores(np.arange(n_docs), own)
        best = np.lexsort((shard.ids, -all_scores))[:20]
        assert docs.tolist() == best.tolist() and scores.tolist() == all_scores[best].tolist()
    assert looked < n_docs
