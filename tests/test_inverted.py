import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted as I
from quarry.operators import search as S
from quarry.operators.catalog import upsert
from quarry.operators.inverted import InvertedIndex

FILES = "id long, project_id string, file_path string, description string, to_be_cleaned long"
QUERIES = ["module", "w1 w2", '"w1 w2"', '"w2 w1 w2" module', "p1", "nowhere", '"w1 nowhere"', "ÉCOLE user_id", '"w1 w1"', "w1 w1", "++", "", 'x ""', "src w3", '"py w1"']


def rows(seed, n, first=0):
    rng = random.Random(seed)
    words = ["module", "école", "user_id", *(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 50)))
    return [(first + k, f"p{k % 3}", f"src/f{first + k}.py", None if k % 41 == 5 else make(), 7 if k % 10 == 3 else None) for k in range(n)]


def same(index, files, project=None, limit=20):
    for q in QUERIES:
        got = [(r.id, r.project_id, r.file_path, round(r.score, 9)) for r in index.search(q, project, limit).collect()]
        assert got == [(r.id, r.project_id, r.file_path, round(r.score, 9)) for r in S.search(files, q, project, limit).collect()], q


@pytest.mark.parametrize("first", [1, 64])
def test_same_as_a_scan(spark, tmp_path, first):
    files = spark.createDataFrame(rows(1, 300), FILES)
    index = InvertedIndex(spark, str(tmp_path / "i"), slot_files=16, first_slots=first).build(files)
    same(index, files)
    same(index, files, "p1", 5)


def test_updates_deletes_and_merge(spark, tmp_path):
    files = spark.createDataFrame(rows(2, 150), FILES)
    index = InvertedIndex(spark, str(tmp_path / "i"), slot_files=16).build(files)
    new = spark.createDataFrame([(900 + k, "p1", f"src/f{k}.py", f"w1 w2 module again {k}", None) for k in range(0, 150, 7)], FILES)
    index.upsert(new)
    files = upsert(files, new, ["project_id", "file_path"])
    same(index, files)
    index.delete(files.where("id % 5 = 1").select("id"))
    files = files.where("id % 5 <> 1").checkpoint()
    more = spark.createDataFrame(rows(3, 40, 2000), FILES)
    index.upsert(more)
    files = files.unionByName(more)
    same(index, files)
    held = {tuple(r) for r in index.terms().collect()}
    assert index.docs().count() == files.count() and len(index._totals()) == 4
    index.merge()
    assert len(index._totals()) == 1 and {tuple(r) for r in index.terms().collect()} == held
    same(index, files)
    queries = spark.createDataFrame([(1, ["w1"]), (2, ["w2", "module"]), (3, ["w1", "nowhere"])], "query_id long, terms array<string>")
    rounded = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert rounded(index.search_many(queries)) == rounded(S.search_many(files, queries))
    index.upsert(spark.createDataFrame([(5000, "p9", "only.py", "w1 zebra", None)], FILES))
    assert [r.id for r in index.search("zebra").collect()] == [5000]


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    files = spark.createDataFrame(rows(4, 30), FILES)
    index = InvertedIndex(spark, str(tmp_path / "i")).build(files)
    index._write("docs", files.limit(0), 2)  # a writer that was lost before its totals
    index.upsert(files.where("id < 3").withColumn("description", F.lit("later text")))
    assert [r["segment"] for r in index._totals()] == [1, 3]
    assert sorted(r.id for r in index.search("later").collect()) == [0, 1, 2]


def test_bounds_rule_slots_out(spark, tmp_path):
    """A few short files hold the word often; slots of long files can't reach them. Only terms' rows are read."""
    data = [(k, "p", f"a{k}", "word " * 9 if k < 40 else "filler " * (200 + k % 300) + "word", None) for k in range(600)]
    files = spark.createDataFrame(data, FILES)
    index = InvertedIndex(spark, str(tmp_path / "i"), slot_files=10, first_slots=3).build(files)
    got = [(r.id, round(r.score, 9)) for r in index.search("word", limit=10).collect()]
    assert got == [(r.id, round(r.score, 9)) for r in S.search(files, "word", limit=10).collect()]
    slots = index.docs().select("slot").distinct().count()
    assert index.scored < slots / 4
    plan = index._of("postings", "term string, slot long, segment int", [1]).where(F.col("term").isin(["word", "x"]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[.*In\(term, \[word,x\]\)", plan)


def test_empty_index(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"))
    assert not index.ready() and index.search("x").count() == 0
    index.upsert(spark.createDataFrame(rows(5, 5), FILES))
    assert index.ready() and index.docs().count() == 5
    assert InvertedIndex(spark, str(tmp_path / "j")).build(spark.createDataFrame([], FILES)).search("x").count() == 0


def test_files_of_equal_scores_go_by_id(spark):
    """Each file holds the terms as often as the others, but other ones; what a sum of doubles leaves of its order must not rank
    them."""
    rng = random.Random(6)
    times = [rng.randrange(1, 40) for _ in range(200)]
    held = [(f"t{t}", 1, i, 900, n) for i in range(30) for t, n in enumerate(rng.sample(times, 200))]
    held = spark.createDataFrame(rng.sample(held, len(held)), "term string, segment int, id long, d int, tf long")
    queries = spark.createDataFrame([(1, [f"t{t}" for t in range(200)])], "query_id long, terms array<string>")
    alive = held.select("segment", "id").distinct()
    found = S.ranked_queries(held, alive, queries, 10**9, 700.0, 30).orderBy("rank").collect()
    assert [r.id for r in found] == list(range(30))


def test_slots_hold_a_bounded_number_of_words_and_are_inverted_whole(spark):
    """No row for each word moves: texts go to their slots, and a slot of long files has fewer of them."""
    data = [(k, "p", f"a{k}", "word " * (3 if k < 200 else 900) + f"own{k}", None) for k in range(240)]
    docs = I.with_slots(S.indexed(spark.createDataFrame(data, FILES)), 100, words=10_000).checkpoint()
    slots = docs.groupBy("slot").agg(F.count("*").alias("n"), F.sum("d").alias("d")).collect()
    assert sum(r.n for r in slots) == 240 and max(r.d for r in slots) <= 10_000 and max(r.n for r in slots) > 20
    held = I.postings_of(docs)
    assert "Generate" not in held._jdf.queryExecution().executedPlan().toString()
    words = docs.select("slot", "id", "d", F.posexplode(F.split("pad", " ")).alias("at", "term")).where("term <> '' and term <> '\n'")
    want = words.groupBy("term", "slot", "id", "d").agg(F.array_sort(F.collect_list("at")).alias("at"))
    e = F.explode(F.arrays_zip("ids", "ds", "positions")).alias("e")
    got = held.select("term", "slot", e).select("term", "slot", "e.ids", "e.ds", "e.positions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sums = {(r.term, r.slot): (r.n, r.max_tf, r.min_d) for r in held.collect()}
    by = want.groupBy("term", "slot").agg(F.count("*").alias("n"), F.max(F.size("at")).alias("tf"), F.min("d").alias("d")).collect()
    assert sums == {(r.term, r.slot): (r.n, r.tf, r.d) for r in by}
