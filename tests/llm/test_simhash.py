import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.storage import Scratch

SCHEMA = "doc_id long, text string, fp string, row string, component string"


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    codes = np.array(sorted(parent), np.uint64)
    for f in codes:
        for g in codes[np.bitwise_count(codes ^ f) <= 3]:
            a, b = root(int(f)), root(int(g))
            parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in parent}


def check(df):
    rows = df.collect()
    got = simhash.near_duplicates(df).collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    of = brute_components(fp)
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r.doc_id is not None:
            least[of[f]] = min(r.doc_id, least.get(of[f], r.doc_id))
    want = sorted((str(r.doc_id), f"{f:016x}", str(least.get(of[f]))) for r, f in zip(rows, fp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    return got


def test_against_brute_force(spark, sf_dir):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(8)]
    rows = []
    for i in range(400):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "X%d" % rng.randrange(100)
        rows.append((i, " ".join(words), "", "", ""))
    rows += [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, " \n", "", "", ""), (1003, "one", "", "", ""), (1004, "ONE\x0b", "", "", ""), (None, "one", "", "", ""), (None, "alone here", "", "", ""), (1005, "é É x", "", "", ""), (1005, "é É x", "", "", "")]
    got = check(spark.createDataFrame(rows, SCHEMA))
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_links_of_random_and_close_codes(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c, a, b in zip(codes[:800], rng.integers(0, 64, 800), rng.integers(0, 64, 800), strict=True)]
    chain = [int(codes[0]) ^ ((1 << k) - 1) for k in range(40)]
    fps = sorted({*map(int, codes), *map(int, flips), *chain, *(k for k in range(0, 4000, 3))})
    signed = np.array(fps, np.uint64).view(np.int64)
    points = spark.createDataFrame([(int(f), i) for i, f in enumerate(signed)], "fp long, node long").select("node", "fp").repartition(5)
    want = brute_components(fps)
    numbers = {f: i for i, f in enumerate(fps)}
    groups = {}
    for f in fps:
        groups.setdefault(want[f], []).append(numbers[f])
    full = {n: min(g) for g in groups.values() for n in g if n != min(g)}
    for options in ({}, {"size": 300, "cell": 500, "shard": 1000}, {"size": 20, "cell": 60, "shard": 300}, {"size": 5000, "cell": 60, "shard": 300}):
        scratch = Scratch(spark, "test")
        got = {r.node: r.component for r in simhash.components(simhash.near_links(points, 3, scratch, **options), scratch).collect()}
        assert got == full


def test_copies_of_a_point(spark):
    """Four cells a point, whatever the number of points, or one cell for all of few; more only for points of cells that are
    too large."""
    rng = np.random.default_rng(2)
    for n in (2000, 20_000, 100_000):
        points = spark.createDataFrame(list(enumerate(rng.integers(-(2**63), 2**63, n).tolist())), "node long, fp long")
        cells, rows = simhash.cells_of(points, 3, Scratch(spark, "test"))
        assert cells.count() == rows == (4 * n if n > 8192 else n)
        assert n / 3 < 8192 * cells.select("mask", "value").distinct().count() / (rows / n) < 4 * max(n, 8192)
    # a third of all points agree in their first 24 bits, or in their last
    for shift in (0, 24):
        fps = np.concatenate([rng.integers(0, 2**39, 5000) << shift, rng.integers(-(2**63), 2**63, 10_000)]).tolist()
        points = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
        cells, rows = simhash.cells_of(points, 3, Scratch(spark, "test"), size=500, cell=1000)
        assert cells.count() <= rows <= 4 * 10_000 + 16 * 5500
        assert cells.groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= 1000


def test_trees_search_the_documents(spark, monkeypatch):
    """Over the documents the links come out of splits of trees, and a point has no more than four copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "doc_id row")
    points = simhash.fingerprints(docs, 3).groupBy("fp").agg(F.min("row").alias("node"))
    n = points.count()
    for size in (8192, 300):
        cells, rows = simhash.cells_of(points.select("node", "fp"), 3, Scratch(spark, "test"), size=size)
        table = cells.toPandas()
        assert len(table) == rows <= 4 * n
        splits, split = [], simhash._split
        monkeypatch.setattr(simhash, "_split", lambda codes: splits.append(len(codes)) or split(codes))
        simhash.link_cells(table["mask"].to_numpy().view(np.uint64), table["fp"].to_numpy().view(np.uint64), 3)
        monkeypatch.setattr(simhash, "_split", split)
        assert len(splits) > 3, size


def test_bands_hold_each_bit_once():
    for mask in (0, (1 << 16) - 1, 0xF0F0F0F0F0F0F0F0):
        got = simhash.bands(mask, 3)
        assert len(got) == 4 and all(m & mask == mask for m in got)
        own = [m ^ mask for m in got]
        assert sum(own) == (1 << 64) - 1 - mask and sum(m.bit_count() for m in own) == 64 - mask.bit_count()


def jaccard(a, b):
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 7)))
    common = [word() for _ in range(30)]
    rows = []
    for g in range(40):
        text = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "", "", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = {root(i) for i in range(len(rows))}
    assert 40 <= len(want) < len(rows) - 20
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want
    again = simhash.keep_one(df.repartition(5).sortWithinPartitions(F.col("doc_id").desc()))
    assert {r.doc_id for r in again.collect()} == want


def test_empty_table_and_keeping_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    text = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(3, text, "", "", ""), (2, text.upper(), "", "", ""), (2, text, "", "", ""), (9, "quite another text of six words", "", "", ""), (None, text, "", "", ""), (7, None, "", "", ""), (6, " ", "", "", "")], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 9]
    assert simhash.keep_one(none).count() == 0


def groups_kept(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def kept(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def prose(rng, n):
    return [f"w{int(20_000 * rng.random() ** 3)}" for _ in range(n)]


def test_appended_and_replaced_passages(spark):
    rng, texts = random.Random(5), []
    for n in (100, 300, 1000):
        for _ in range(6):
            text, at, few = prose(rng, n), n // 3, (n - 40) // 12
            texts += [" ".join(text), " ".join(text + prose(rng, int(0.24 * n) - 1))]
            text = prose(rng, n)
            texts += [" ".join(text), " ".join(text[:at] + prose(rng, few) + text[at + few :])]
    want = groups_kept(texts)
    assert len(want) <= len(texts) // 2 + 4
    assert kept(spark, texts) == want


def test_repeated_lines_count_once(spark):
    rng = random.Random(6)
    texts = []
    for size, few, many in ((5, 1, 100), (12, 2, 15)):
        for _ in range(4):
            text, line = prose(rng, 500), prose(rng, size)
            texts += [" ".join(text + line * few), " ".join(text + line * many)]
    want = groups_kept(texts)
    assert len(want) == 8
    assert kept(spark, texts) == want


def test_no_link_near_the_limit_is_lost(spark):
    rng, texts = random.Random(7), []
    for _ in range(30):
        text = prose(rng, 300)
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randrange(2, 6)):
                copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    text = prose(rng, 150)  # more copies than a small run holds, many of them no copies of the leaders
    for _ in range(150):
        copy = list(text)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    assert kept(spark, texts) == groups_kept(texts)


def test_a_passage_that_many_share_makes_no_pairs(spark):
    """Texts under one template that differ in a sixth of their shingles: no pair and no run, however many they are; those
    that are alike beside are still found."""
    rng = random.Random(11)
    template = prose(rng, 170)
    for n in (300, 1500):
        texts = [" ".join([*template, *(f"own{i}_{k}" for k in range(34))]) for i in range(n)]
        texts += [t + " more" for t in texts[:20]]
        sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
        rows = [(i, len(h), (t,)) for i, (t, h) in enumerate(zip(texts, sets, strict=True))]
        marked = spark.createDataFrame(rows, "node long, size int, doc struct<text:string>")
        found = simhash.candidates(marked, 5, 0.8).collect()
        assert {(r.a, r.b) for r in found if r.run is None} == {(i, n + i) for i in range(20)}
        assert not [r for r in found if r.run is not None]


def test_short_prefixes_meet():
    """Of all pairs that are alike, the smaller set's short prefix meets the other's prefix."""
    rng = np.random.default_rng(5)
    common = np.arange(0, 400, 3, dtype=np.uint64), rng.integers(3, 50, 134)
    seen = 0
    for _ in range(4000):
        a = rng.choice(400, rng.integers(1, 60), replace=False)
        b = np.concatenate([rng.choice(a, max(1, len(a) - rng.integers(0, 6)), replace=False), rng.choice(1000, rng.integers(0, 6), replace=False) + 400])
        a, b = (np.unique(x).astype(np.uint64) for x in (a, b))
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            (x, short), (y, _) = simhash.prefix(a, common, 0.8), simhash.prefix(b, common, 0.8)
            seen += 1
            assert len(np.intersect1d(x[:short], y))
    assert seen > 500


def test_signatures_bound_what_is_shared():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 40, 700, 5000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64) * np.uint64(2))
        for m in (n, int(1.25 * n)):
            a, b = np.sort(rng.choice(pool, n, replace=False)), np.sort(rng.choice(pool, min(m, len(pool)), replace=False))
            x, y = (np.frombuffer(simhash.signature(h), np.uint8) for h in (a, b))
            most = simhash.shared_at_most(x, y)
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
            assert simhash.shared_at_most(x, x) == n
            if n >= 700:
                assert most < 0.85 * n
    assert simhash.signature(np.arange(5000, dtype=np.uint64)) == b""


def test_nodes_with_partners():
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [base, base[5:], base[::2], np.sort(rng.integers(0, 2**63, 390, dtype=np.uint64)), np.sort(np.append(base[:-3], np.uint64(7)))]
    sizes = np.array([len(x) for x in sets])
    got = simhash.with_partners(np.array([1, 2, 3, 4, 1]), sizes, [simhash.signature(x) for x in sets], 0.8)
    assert got.tolist() == [True, True, False, False, True]
    assert not simhash.with_partners(np.array([1, 1, 1, 4, 1]), sizes, [simhash.signature(x) for x in sets], 0.8).any()


def test_small_cells_give_the_same_links(spark):
    rng = random.Random(9)
    base, texts = [prose(rng, 200) for _ in range(12)], []
    for _ in range(120):
        copy = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    scratch = Scratch(spark, "test")
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    docs = [(i, (t,)) for i, t in enumerate(texts)]
    marked = spark.createDataFrame([(i, i, d) for i, d in docs], "row long, node long, doc struct<text:string>")
    pairs = [(i, j, len(sets[i]) + len(sets[j])) for j in range(120) for i in range(j)]
    want = {(i, j) for i, j, _ in pairs if jaccard(texts[i], texts[j]) >= 0.8}
    for cell in (500, 5000, 2_000_000):
        got = simhash.verified(spark.createDataFrame(pairs, "a long, b long, n long"), marked, marked.select("row", "node"), 5, 0.8, scratch, cell)
        assert {(r.a, r.b) for r in got.collect()} == want and want
    for held in (10, 500_000):
        asked = spark.createDataFrame([(i, i % 3) for i in range(120)], "node long, cell long")
        for r in simhash.with_sets(marked, marked.select("row", "node"), asked, 5, scratch, held).collect():
            assert r.cell == r.node % 3
            assert sorted(r.held) == sorted(np.unique(sets[r.node].astype(np.uint32)).view(np.int32).tolist())


def test_texts_of_one_repeated_word_are_told_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(["pad"] * 20_000 + prose(rng, 15)) for _ in range(6)]
    want = groups_kept(texts)
    assert len(want) == 6
    assert kept(spark, texts) == want


def test_trees_link_near_copies_of_the_pipeline(spark, monkeypatch):
    """Fingerprints and vantage-point trees link what is close; the join of prefixes only adds to them."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10_000)}" for _ in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["more", *words]), " ".join(f"x{rng.randrange(10_000)}" for _ in range(4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "candidates", lambda marked, *_: spark.createDataFrame([], "run long, a long, b long, n long"))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 3}
