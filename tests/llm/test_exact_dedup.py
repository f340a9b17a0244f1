import hashlib
import random
from collections import defaultdict

from quarry.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept int, row string, doc string, size long"


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").encode().lower()
    for r in rows:
        groups[norm(r[1])].append(r[0])
    return sorted((r[0], max(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1])).hexdigest()) for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = ["", None, "a", "A", "é", "É", "ab" * 40, "AB" * 40, "ab" * 40 + "c", "x" * 64, "X" * 64, "x" * 65, "x" * 576, "x" * 577, "ü" * 5000, "ü" * 5000 + "!", "İ" * 70, "i̇" * 70]
    base += ["".join(rng.choice("aAbBéß") for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    rows = [(i, rng.choice(base), 1, "r", "d", 7) for i in range(400)]
    got = exact_dedup.radix_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_empty_null_and_repeated_rows(spark):
    none = exact_dedup.radix_groups(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    rows = [(5, "t", 0, "", "", 0), (5, "t", 0, "", "", 0), (5, "u", 0, "", "", 0), (None, "T", 0, "", "", 0), (None, None, 0, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.radix_groups(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 3} == {5}
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (5, "t"), (5, "u")]


def test_round_widths_do_not_matter(spark):
    rows = [(i, "ab" * (i % 7) + "z" * (i % 3), 0, "", "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = exact_dedup.radix_groups(df, first=1, growth=1).orderBy("doc_id").collect()
    assert one == exact_dedup.radix_groups(df).orderBy("doc_id").collect()
