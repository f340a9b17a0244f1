import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import batches as B
from quarry.operators import diffs as D


def fewest(a, b):
    """Edits by a table of longest common subsequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


items = st.lists(st.sampled_from("abcde"), max_size=40)


@settings(max_examples=500, deadline=None)
@given(items, items)
def test_edits_are_the_fewest_and_right(a, b):
    gone, come = D.edits(a, b)
    assert [x for x, g in zip(a, gone) if not g] == [x for x, c in zip(b, come) if not c]
    assert sum(gone) + sum(come) == fewest(a, b)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.lists(st.sampled_from(["a", "", "@@ -1 +1 @@ x", "+", "-- b", "c "]), min_size=1, max_size=30)), st.one_of(st.none(), st.lists(st.sampled_from(["a", "", "@", "+x", "c "]), min_size=1, max_size=30)), st.integers(0, 4))
def test_hunks_give_the_newer_text(a, b, context):
    old, new = (None if x is None else "\n".join(x) for x in (a, b))
    diff = D.file_diff("p", old, new, context)
    assert (diff is None) == (old == new)
    assert D.patched(old, diff) == new


def test_a_diff_by_hand():
    old, new = "\n".join("abcdefghijklmnop"), "\n".join("abXdefghijklmnoq")
    assert D.file_diff("x y.py", old, new) == "diff --git a/x y.py b/x y.py\n--- a/x y.py\n+++ b/x y.py\n@@ -1,6 +1,6 @@\n a\n b\n-c\n+X\n d\n e\n f\n@@ -13,4 +13,4 @@\n m\n n\n o\n-p\n+q"
    assert D.file_diff("n", None, "a\nb") == "diff --git a/n b/n\n--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+a\n+b"
    assert D.file_diff("n", "a", None) == "diff --git a/n b/n\n--- a/n\n+++ /dev/null\n@@ -1 +0,0 @@\n-a"
    with pytest.raises(ValueError):
        D.patched("a\nz", "@@ -1,2 +1 @@\n a\n-b")


def test_long_texts():
    rng = random.Random(1)
    old = [f"line {rng.randrange(2000)}" for _ in range(6000)]
    new = [x for k, x in enumerate(old) if k % 50] + ["end"]
    gone, come = D.edits(old, new)
    assert sum(gone) + sum(come) <= 121 and D.patched("\n".join(old), D.file_diff("p", "\n".join(old), "\n".join(new))) == "\n".join(new)


def test_commits(spark):
    rows = [("c1", "b.py", "x\ny", "x\nz"), ("c1", "a.py", None, "new"), ("c1", "same.py", "s", "s"), ("c2", "a.py", "new", None), ("c3", "same.py", None, None)]
    versions = spark.createDataFrame(rows, "commit string, file_path string, old string, new string")
    messages = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", "nothing")], "commit string, message string")
    got = {r.commit: (r.message, r.diff) for r in D.commit_diffs(versions, messages).collect()}
    assert got["c3"] == ("nothing", "") and got["c1"][1] == D.file_diff("a.py", None, "new") + "\n" + D.file_diff("b.py", "x\ny", "x\nz")
    diffs = D.commit_diffs(versions, messages)
    assert sorted(tuple(r) for r in B.changed_files(diffs.where("diff <> ''")).collect()) == [("c1", 1, "a.py"), ("c1", 2, "b.py"), ("c2", 1, "a.py")]
    back = D.apply_diffs(versions, D.file_diffs(versions)).collect()
    assert {(r.commit, r.file_path): r.text for r in back} == {(c, p): n for c, p, o, n in rows if o != n}
