"""Diffs between two versions of a text, and texts from diffs.

The shortest edit script by Myers' algorithm in linear space: the middle of an optimal path is met from both ends, and what
lies before and after it is solved in the same way. Spark deals the pairs; a pair's work is its length times its edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.folds import pieces

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """Begin and end of a run of equal items (it may be empty) in the middle of a shortest path from a to b."""
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back.get(delta - k, -1) >= n:
                return x0, x0 - k, x, y
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, n - x0, m - (x0 - k)
    raise AssertionError("two paths always meet")


def edits(old: list, new: list) -> tuple[list[bool], list[bool]]:
    """Which items of ``old`` go and which of ``new`` come, as few as can be."""
    gone, come = [False] * len(old), [False] * len(new)
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and old[a0] == new[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and old[a1 - 1] == new[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            gone[a0:a1], come[b0:b1] = [True] * (a1 - a0), [True] * (b1 - b0)
            continue
        x0, y0, x1, y1 = _middle(old[a0:a1], new[b0:b1])
        todo += [(a0, a0 + x0, b0, b0 + y0), (a0 + x1, a1, b0 + y1, b1)]
    return gone, come


def hunks(old: list[str], new: list[str], context: int = 3) -> list[str]:
    """Unified hunks: lines that go, come and stay under a head with where they stand. A count of 1 is left out; a side
    without lines stands after the line before."""
    gone, come = edits(old, new)
    steps, i, j = [], 0, 0  # (sign, line, old position, new position)
    while i < len(old) or j < len(new):
        if i < len(old) and gone[i]:
            steps.append(("-", old[i], i, j))
            i += 1
        elif j < len(new) and come[j]:
            steps.append(("+", new[j], i, j))
            j += 1
        else:
            steps.append((" ", old[i], i, j))
            i, j = i + 1, j + 1
    changed = [k for k, s in enumerate(steps) if s[0] != " "]
    out, k = [], 0
    while k < len(changed):
        end = k
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context + 1:
            end += 1
        part = steps[max(0, changed[k] - context) : changed[end] + context + 1]
        spans = []
        for sign, first in (("+", part[0][2]), ("-", part[0][3])):
            n = sum(s[0] != sign for s in part)
            spans.append(f"{first + (n > 0)}" + ("" if n == 1 else f",{n}"))
        out.append("\n".join([f"@@ -{spans[0]} +{spans[1]} @@", *(s[0] + s[1] for s in part)]))
        k = end + 1
    return out


def patched(old: str | None, diff: str | None) -> str | None:
    """The newer text; a line of the old one that isn't what a hunk says is an error. A null text is one that isn't there."""
    lines = [] if old is None else old.split("\n")
    out, at, body = [], 0, (diff or "").split("\n")
    k = next((n for n, line in enumerate(body) if line.startswith("@@")), len(body))
    while k < len(body):
        start, count = (int(x or 1) for x in HUNK.match(body[k]).groups()[:2])
        out += lines[at : start - (count > 0)]
        at, k = start - (count > 0), k + 1
        while k < len(body) and not HUNK.match(body[k]):
            sign, line = body[k][:1], body[k][1:]
            if sign != "+":
                if lines[at : at + 1] != [line]:
                    raise ValueError(f"line {at + 1} isn't {line!r}")
                at += 1
            if sign != "-":
                out.append(line)
            k += 1
    out += lines[at:]
    return "\n".join(out) if out else None


def file_diff(path: str, old: str | None, new: str | None, context: int = 3) -> str | None:
    """A section of a diff; nothing if the versions are the same. A file that isn't there is null."""
    if old == new:
        return None
    parts = hunks([] if old is None else old.split("\n"), [] if new is None else new.split("\n"), context)
    before, after = ("/dev/null" if old is None else f"a/{path}"), ("/dev/null" if new is None else f"b/{path}")
    return "\n".join([f"diff --git a/{path} b/{path}", f"--- {before}", f"+++ {after}", *parts])


def file_diffs(versions: DataFrame, context: int = 3) -> DataFrame:
    """versions: commit, file_path, old, new. commit, file_path, diff, added, removed of the files that differ."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for commit, path, old, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (diff := file_diff(path or "", old, new, context)) is not None:
                    body = diff.split("\n")[3:]
                    rows.append((commit, path, diff, sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)))
            if rows:
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["commit", "file_path", "diff", "added", "removed"])

    read = versions.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("commit").cast("string"), "file_path", "old", "new")
    return read.mapInArrow(work, "commit string, file_path string, diff string, added long, removed long")


def commit_diffs(versions: DataFrame, messages: DataFrame) -> DataFrame:
    """commit, message, diff: of each commit (messages: commit, message) its files' sections in the order of their paths, ''
    if none differs. A commit's text is one row, as what reads it is one prompt or one reader."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("file_path", "diff"))), lambda r: r["diff"])
    texts = file_diffs(versions).groupBy("commit").agg(F.array_join(in_order, "\n").alias("diff"))
    return messages.join(texts, "commit", "left").select("commit", "message", F.coalesce("diff", F.lit("")).alias("diff"))


def apply_diffs(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """files: commit, file_path, old; diffs: commit, file_path, diff. commit, file_path, text: the newer version of each file
    that has a diff; null if it goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [patched(old, diff) for old, diff in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["commit", "file_path", "text"])

    joined = files.select("commit", "file_path", "old").join(diffs.select("commit", "file_path", "diff"), ["commit", "file_path"])
    return joined.mapInArrow(work, "commit string, file_path string, text string")
