import math

import numpy as np
import pytest

from quarry.llm import vector_dedup as V


def sound(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.9):
    good = [k for k, (_, v) in enumerate(rows) if sound(v)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, links[k], least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def groups(rng, n=240, d=16):
    centres = rng.standard_normal((12, d))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + rng.standard_normal(d) * (0.02 if k % 12 < 6 else 0.3)]) for k in range(n)]
    same = rows[5][1]
    rows += [(900 + k, same) for k in range(40)] + [(3, same), (3, rows[7][1]), (None, same), (None, [9.0] * d), (950, [-x for x in same]), (951, [2 * x for x in same])]
    return rows + [(960, None), (961, []), (962, [0.0] * d), (963, [float("nan")] + [1.0] * (d - 1)), (964, [float("inf")] * d), (965, [None] * d), (966, [1.0, 0.0]), (967, [1.0, 0.01]), (968, [1.0])]


@pytest.mark.parametrize("options", [{}, {"cell": 5, "bucket": 4, "copies": 2}, {"bucket": 1, "sample": 50, "most": 60}])
def test_against_brute_force(spark, options):
    rows = groups(np.random.default_rng(4))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, `v.h1` int")
    got = V.near_vectors(df, recall=0.99999 if options.get("most") is None else 0.98, **options).collect()
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    if "most" not in options:
        assert sorted((tuple(r) for r in got), key=str) == want
    else:  # links may be missed but never made up
        assert 0.95 * sum(w[1] for w in want) <= sum(r.n_links for r in got) <= sum(w[1] for w in want)
    assert [r.n_links for r in got if r.vec_id in (960, 961, 962, 963, 964, 965, 968)] == [0] * 7


def test_many_buckets_of_many_vectors_by_a_shuffled_join(spark):
    rows = groups(np.random.default_rng(5), 120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id is not null and size(embedding) = 16")
    tables = V.Tables(2, 3, 2.0, 1)
    classes = df.selectExpr("vec_id cls", "1L n", "embedding v")
    hashed = classes.where("forall(v, x -> x = x) and v[0] <> double('infinity') and v[1] <> 0").mapInArrow(V._hashed(tables, 0, 3), "tab int, bucket long, cls long, n long, v array<double>")
    a, b = V.cells_of(hashed, 4, held=1000), V.cells_of(hashed, 4, held=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert b.groupBy("tab", "bucket", "i", "j").count().agg({"count": "max"}).first()[0] <= 24


def test_recall_just_above_the_limit():
    """Pairs at cosines of 0.9 to 0.91 in a space of many vectors: nine in ten have to be found, 0.98 are asked for."""
    rng = np.random.default_rng(6)
    d, n = 64, 3000
    a = V.units(rng.standard_normal((n, d)))
    b = rng.standard_normal((n, d))
    b = V.units(b - (a * b).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9, 0.91, (n, 1))
    b = c * a + np.sqrt(1 - c * c) * b
    k, number = V.plan(a[:1000], 1_000_000, 0.9, 0.98, 2.0, 128, 384)
    tables = V.Tables(k, number, 2.0, 13)
    shared = (tables.keys(V.units(a), 0, number) == tables.keys(V.units(b), 0, number)).any(axis=1).mean()
    assert 4 < k and number < 384 and shared > 0.96
    far = (tables.keys(V.units(a), 0, 1) == tables.keys(V.units(a[::-1].copy()), 0, 1)).mean()
    assert far < 0.01


def test_same_bucket_whatever_the_batch():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((500, 48)).astype(np.float32)
    tables = V.Tables(9, 20, 2.0, 3)
    whole = tables.keys(V.units(v), 0, 20)
    assert all((tables.keys(V.units(v[k : k + 1]), 5, 9) == whole[k, 5:9]).all() for k in range(500))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.near_vectors(df).count() == 0
