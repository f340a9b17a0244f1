import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import vectors as V
from quarry.operators.neighbours import VectorLists


def same(lists, vectors, queries, k, **options):
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.similarity, 12)) for r in df.collect())
    got = rows(lists.nearest_many(queries, k, **options))
    assert got == rows(V.nearest_many(vectors, queries, k))
    return got


def scored(lists, queries, k):
    return lists.hits(queries, k).agg(F.sum("scored")).first()[0]


def grouped(n, d, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    v = centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return [(k, x.tolist()) for k, x in enumerate(v)]


def test_groups_leave_a_tenth_of_the_rows(spark, tmp_path):
    vectors = spark.createDataFrame(grouped(6000, 32, 60, 0.1, 1), "id long, vector array<double>")
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    lists = VectorLists(spark, str(tmp_path / "l")).build(vectors)
    assert len(same(lists, vectors, queries, 8)) == 60 * 8
    assert scored(lists, queries, 8) < 60 * 6000 / 10
    again = VectorLists(spark, str(tmp_path / "l"))
    assert again.ready() and len(same(again.open(), vectors, queries, 8)) == 480


@pytest.mark.parametrize("k", [1, 7, 900])
def test_vectors_without_structure_ties_and_odd_ones(spark, k):
    rows = grouped(500, 8, 1, 1.0, 2)
    rows += [(1000 + j, rows[3][1]) for j in range(9)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0]), (2004, [None] * 8), (2005, [float("inf")] * 8), (2006, [-x for x in rows[3][1]])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = vectors.where("id % 50 = 3 OR id >= 2000").select(F.col("id").alias("query_id"), "vector")
    same(VectorLists(spark).build(vectors, lists=12), vectors, queries, k)
    same(VectorLists(spark).build(vectors, lists=1), vectors, queries, k, block=4)


def test_few_vectors_and_none(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(5, [1.0, 1.0])], "query_id long, vector array<double>")
    same(VectorLists(spark).build(vectors), vectors, queries, 3)
    assert VectorLists(spark).build(vectors.limit(0)).nearest_many(queries, 3).count() == 0
    assert VectorLists(spark).build(vectors).nearest_many(queries.limit(0), 3).count() == 0
