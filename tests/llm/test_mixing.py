import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb

import pytest

from quarry.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target double, u string"


def brute_targets(rows, weights=(5, 2, 1), budget=1.5, most=2.0):
    size = defaultdict(int)
    for _, text, source, *_ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = budget * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * size[s]]
        if not over:
            return size, {s: capped.get(s, level * w[s]) for s in order}
        capped |= {s: most * size[s] for s in over}


def corpus(n=3000, seed=3):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", None, "hot", "", "𝔞", "￿"]
    return [(i, " ".join("w" * (k % 5 + 1) for k in range(int(rng.paretovariate(1.1)) % 900)), rng.choice([*names, "hot", "hot", "hot"]), 1, 1.0, "") for i in range(n)]


def brute_mix(rows, tilt=0.5, seed=20, **options):
    """Copies of each row (doc_id, size): a whole order sampler, source by source."""
    size, target = brute_targets(rows, **options)
    out = Counter()
    for source in target:
        docs = [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows if r[2] == source]
        ratio = target[source] / size[source] if size[source] else 0.0
        certain, p = math.floor(ratio), ratio - math.floor(ratio)
        roots = {n: math.floor(math.sqrt(n)) for _, n in docs}
        line = []
        if size[source] and p:
            mean = sum(roots[n] * n for _, n in docs) / size[source]
            span = max(max(x for n, x in roots.items() if n) - mean, mean - min(x for n, x in roots.items() if n))
            for i, n in docs:
                own = p + (tilt * min(p, 1 - p) * (roots[n] - mean) / span if span else 0.0)
                key = f"{'' if i is None else i}:{source or ''}:{n}:{seed}"
                u = (int(hashlib.md5(key.encode()).hexdigest()[:8], 16) * 2**20 + 0.5) / 2**52
                if n:
                    line.append((u * (1 - own) / ((1 - u) * own), i, n))
        taken, room = Counter(), target[source] - certain * size[source]
        for _, i, n in sorted(line, key=lambda x: x[0]):
            if n > room:
                if n - room < room:
                    taken[i, n] += 1
                break
            taken[i, n] += 1
            room -= n
        for i, n in docs:
            out[i, n] += certain
        out += taken
    return out


def check(rows, got):
    size, target = brute_targets(rows)
    taken = defaultdict(int)
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    return {s: (taken[s], target[s]) for s in target}


def copies(got):
    found = Counter()
    for r in got:
        found[r.doc_id, r.size] += r.copies
    return +found


def test_targets_and_taken_words(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.pareto_mix(df).collect()
    assert len(got) == len(rows)
    largest = defaultdict(int)
    for r in rows:
        largest[r[2]] = max(largest[r[2]], len((r[1] or "").split()))
    for s, (taken, target) in check(rows, got).items():
        assert abs(taken - target) <= largest[s] / 2
    again = mixing.pareto_mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


@pytest.mark.parametrize("options", [{}, {"tilt": -0.9, "seed": 3}, {"tilt": 0.0, "weights": (1.0, 4.0), "budget": 1.2, "most": 3.0}])
def test_against_a_whole_order_sampler(spark, monkeypatch, options):
    rows = corpus(4000, 5)
    plain = {k: v for k, v in options.items() if k in ("weights", "budget", "most")}
    for bucket_rows in (512, 4):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
        got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA), **options).collect()
        assert copies(got) == +brute_mix(rows, options.get("tilt", 0.5), options.get("seed", 20), **plain)


def test_inclusion_differs_and_fills_the_target(spark):
    rows = corpus()
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    source_of = {r[0]: r[2] for r in rows}
    of = defaultdict(list)
    for r in got:
        of[source_of[r.doc_id]].append(r)
    for docs in of.values():
        expected = sum(r.size * (min(d.copies for d in docs if d.size) + r.inclusion) for r in docs if r.size)
        assert expected == pytest.approx(docs[0].target)
        assert all(0 <= r.inclusion < 1 for r in docs)
    assert len({r.inclusion for r in of["hot"]}) > 5


def test_inclusion_is_met_over_seeds(spark):
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 100)), "a" if i < 400 else "b", 0, 0.0, "") for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    hits, chance = Counter(), {}
    for seed in range(6):
        for r in mixing.pareto_mix(df, weights=(1.0, 5.0), budget=1.3, seed=seed).collect():
            group = (r.doc_id < 400, r.size)
            hits[group] += r.copies
            chance[group] = r.inclusion + (r.target >= r.source_size)
    for group, n in hits.items():
        assert n / (6 * (200 if group[0] else 600)) == pytest.approx(chance[group], abs=0.05)


def test_against_sql(spark, sf_dir):
    want = duckdb.sql(mixing.ORACLE.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    got = mixing.pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = ["doc_id", "size", "source_size", "target", "copies", "taken", "inclusion"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_rows_in_one_source(spark):
    df = spark.range(200_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 AS int)) AS text", "if(id % 3 = 0, 'x', 'y') AS source", "0L size", "0D target", "'' u")
    by = mixing.pareto_mix(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in by:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 19


def test_many_rows_that_are_equal(spark, monkeypatch):
    """Rows that repeat are told apart by their place: they neither meet in one bucket nor go together."""
    found = []
    kept = mixing._last_buckets

    def buckets(keyed, sources, scratch):
        of, shift = kept(keyed, sources, scratch)
        found.append(keyed.join(of, keyed["source"].eqNullSafe(of["source"])).where((keyed["rank"].bitwiseAND(-(1 << shift))) == of["bucket"] * (1 << shift)).count())
        return of, shift

    monkeypatch.setattr(mixing, "_last_buckets", buckets)
    df = spark.range(100_000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text", "if(id % 4 = 0, 'x', 'y') AS source")
    got = mixing.pareto_mix(df).groupBy("source_size").agg({"taken": "sum", "target": "max", "copies": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1.5 and r["max(copies)"] == 2 for r in got)
    assert found[0] <= 2 * mixing.BUCKET_ROWS


def test_empty_and_null(spark):
    assert mixing.pareto_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, 0, 0.0, ""), (2, "", "a", 0, 0.0, ""), (None, "x y", None, 0, 0.0, ""), (None, "x y", None, 0, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("u", "meta.u`rl")
    got = mixing.pareto_mix(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 6
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("text = 'x y'").count() == 3


def test_a_very_long_text(spark):
    rows = [(1, "w " * 3_000_000, "a", 0, 0.0, ""), *((i, "x y z", "a", 0, 0.0, "") for i in range(2, 50))]
    got = {r.doc_id: r for r in mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].size == 3_000_000 and got[1].copies in (1, 2)
