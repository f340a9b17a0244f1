import math
import random

import pytest

from quarry.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, asked):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in ok if asked(i)}.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 3, "bins": 4, "slack": 0}, {"bins": 7, "slack": 2}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    same = [0.5, -0.25, 0.125]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)] if i % 3 else same, "", "") for i in range(300)]
    rows += [(300, None, "", ""), (301, [1.0, None, 2.0], "", ""), (302, [float("nan"), 1.0, 1.0], "", ""), (303, [float("inf"), 1.0, 1.0], "", ""), (320, [1.0, 2.0], "", ""), (340, [], "", ""), (None, same, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, lambda i: i % 20 == 0)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (100, [2.0], "", ""), (7, [-1.0], "", ""), (7, [-1.0], "", "")], SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 100, 2048 * 1024), (0, 2, 7, -1024 * 1024), (0, 3, 7, -1024 * 1024), (100, 1, 0, 2048 * 1024), (100, 2, 7, -2048 * 1024), (100, 3, 7, -2048 * 1024)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
