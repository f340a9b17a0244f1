import os
import random
import re
import tracemalloc
from fnmatch import fnmatch

import pytest
from pyspark.sql import functions as F

from quarry.operators import ignore as I
from quarry.sources.folders import FolderChangesReader, FolderReader, difference, slices, walk_files, watch_files, write_files
from quarry.sources.listing import list_files, read_texts


def put(root, path, text="x"):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def test_listing_in_parallel(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for k in range(600):
        path = "/".join([f"d{rng.randrange(4)}" for _ in range(rng.randrange(0, 5))] + [f"f{k}.py"])
        put(tmp_path, path, "x" * k)
        want[path] = k
    put(tmp_path, "d1/node_modules/deep/z.js")
    put(tmp_path, "d2/x.egg-info/z")
    os.makedirs(tmp_path / "empty/one")
    pruned = ("node_modules/", "*.egg-info")
    rows = walk_files(spark, str(tmp_path), pruned).collect()
    assert {r.file_path: r.size for r in rows} == want and len(rows) == 600
    assert all(r.modified == int(os.stat(tmp_path / r.file_path).st_mtime) for r in rows)
    assert [r.file_path for r in walk_files(spark, f"file://{tmp_path}", pruned, most=9).collect()] == sorted(want)[:9]
    for parallel in (1, 5, 1000):
        reader = FolderReader({"path": str(tmp_path), "pruned": ",".join(pruned), "parallel": str(parallel)})
        parts = reader.partitions()
        assert len(parts) >= min(parallel, 20)
        assert sorted(p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()) == sorted(want)
    assert walk_files(spark, str(tmp_path / "empty")).count() == 0


def test_difference():
    assert difference({"a": (1, 1), "b": (1, 1), "c": (1, 1)}, {"b": (1, 2), "c": (1, 1), "d": (3, 3)}) == [("deleted", "a", 1, 1), ("changed", "b", 1, 2), ("created", "d", 3, 3)]
    assert len(difference({}, {str(k): (k, k) for k in range(9)}, 4)) == 4


def test_stream_reports_each_change_once(spark, tmp_path):
    root, seen = tmp_path / "w", tmp_path / "seen"
    for k in range(30):
        put(root, f"a{k % 3}/f{k}.py", str(k))
    put(root, ".git/config")

    def run(most=0):
        stream = watch_files(spark, str(root), str(tmp_path / "state"), (".git",), most)
        stream.writeStream.foreachBatch(lambda df, n: df.withColumn("run", F.lit(n)).write.mode("append").parquet(str(seen))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run, r.change, r.file_path) for r in spark.read.parquet(str(seen)).collect())

    first = run()
    assert first == sorted((0, "created", f"a{k % 3}/f{k}.py") for k in range(30))
    assert run() == first  # nothing has changed
    (root / "a0/f0.py").unlink()
    put(root, "a1/f1.py", "longer text")
    put(root, "new.py")
    second = run()
    assert second[30:] == [(1, "changed", "a1/f1.py"), (1, "created", "new.py"), (1, "deleted", "a0/f0.py")]
    # a reader that made a snapshot and was lost before its batch: the next run takes it on, once
    put(root, "lost.py")
    assert FolderChangesReader({"path": str(root), "state": str(tmp_path / "state"), "pruned": ".git"}).latestOffset() == {"snapshot": 3}
    assert run()[33:] == [(2, "created", "lost.py")]
    for k in range(5):
        put(root, f"many{k}.py")
    assert [len(run(2)) for _ in range(4)] == [36, 38, 39, 39]
    assert len({p for _, c, p in run(2) if c == "created"}) == 37


def test_batches_that_run_again_give_the_same_rows(tmp_path):
    root = tmp_path / "w"
    for k in range(500):
        put(root, f"f{k}")
    reader = FolderChangesReader({"path": str(root), "state": str(tmp_path / "s"), "rowsPerTask": "100"})
    end = reader.latestOffset()
    rows = lambda: sorted(r for p in reader.partitions({"snapshot": 0}, end) for r in reader.read(p))
    before = rows()
    put(root, "later")
    (root / "f7").unlink()
    assert len(reader.partitions({"snapshot": 0}, end)) == 5 and rows() == before and len(before) == 500
    assert reader.latestOffset() == {"snapshot": 2}
    reader.commit({"snapshot": 2})
    assert reader._numbers() == [2] and reader.latestOffset() == {"snapshot": 2}


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "ü\n"), ("c.txt", None), ("a/d/e", "")], "file_path string, content string")
    write_files(rows, str(tmp_path / "o"))
    assert (tmp_path / "o/a/b.txt").read_text() == "ü\n" and {r.file_path: r.size for r in walk_files(spark, str(tmp_path / "o")).collect()} == {"a/b.txt": 3, "c.txt": 0, "a/d/e": 0}


def plain(path, lists):
    """A walk from the root: an ignored folder isn't entered."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        for folder, content in lists:
            base = folder.split("/") if folder else []
            if parts[: len(base)] != base or len(base) >= k:
                continue
            rest, verdict = "/".join(parts[len(base) : k]), False
            for line in content.split("\n"):
                line = line.rstrip(" \t")
                if not line or line[0] == "#":
                    continue
                negated, line = line[0] == "!", line.removeprefix("!")
                if line.endswith("/") and k == len(parts):
                    continue
                body = line.rstrip("/")
                if not body:
                    continue
                if "**" in body:
                    hit = re.fullmatch({"**/x": "(.*/)?x", "a/**": "a/.+", "a/**/b": "a/(.*/)?b"}[body], rest)
                elif "/" in body:
                    names = body.removeprefix("/").split("/")
                    hit = len(names) == len(rest.split("/")) and all(map(fnmatch, rest.split("/"), names))
                else:
                    hit = fnmatch(rest.split("/")[-1], body)
                if hit:
                    verdict = not negated
            if verdict:
                return True
    return False


@pytest.mark.parametrize("seed", range(3))
def test_ignore_lists_against_a_walk(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "x", "a.py", "b.md", "x+y.(z)", "ab"]
    patterns = ["a", "a/", "/a", "b/", "*.py", "!a.py", "!a", "!b/", "a/b", "/b/x", "?", "[ab]", "[!x]", "!x", "# a", "", "x+y.(z)", "**/x", "a/**", "a/**/b", "*", "!*.md", "b.md  ", "a/*", "!/a/b"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    lists = [("", "\n".join(rng.choices(patterns, k=5)))] + [(f, "\n".join(rng.choices(patterns, k=4))) for f in ("a", "a/b", "x", "nowhere")]
    rules = I.parse_lists(spark.createDataFrame([("p", f, c) for f, c in lists], "project_id string, folder string, content string"))
    got = I.ignored(spark.createDataFrame([(q, p) for p in paths for q in ("p", "other")], "project_id string, file_path string"), rules).collect()
    assert {r.file_path: r.ignored for r in got if r.project_id == "p"} == {p: plain(p, lists) for p in paths}
    assert not any(r.ignored for r in got if r.project_id == "other") and len(got) == 2 * len(paths)


def test_a_task_holds_its_part_of_a_snapshot(tmp_path):
    reader = FolderChangesReader({"path": str(tmp_path), "state": str(tmp_path / "s")})
    seen = {f"a/f{k}.py": (k, 5) for k in range(1000)}
    reader._save(1, seen)
    parts = [reader._load(1, k, 8) for k in range(8)]
    assert max(map(len, parts)) < 250 and sum(map(len, parts)) == 1000 and {p: v for part in parts for p, v in part.items()} == seen == reader._load(1)


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    from quarry.operators.folds import pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    parts = list(pieces(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == 128 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))


def test_files_are_listed_and_read_in_tasks(spark, tmp_path):
    want = {}
    for k in range(600):
        (tmp_path / "flat").mkdir(exist_ok=True)
        want[f"flat/f{k}.py"] = f"t{k} " * (k % 50)
        put(tmp_path, f"flat/f{k}.py", want[f"flat/f{k}.py"])
    odd = {"__init__.py": "a", ".env": "b", "_d/x": "c", "a b%20+#.txt": "ü\n", "d/ü.md": "﻿z", "blank": "  ", "empty": ""}
    for path, text in odd.items():
        put(tmp_path, path, text)
    (tmp_path / "bytes").write_bytes(b"a\xff\x00b")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    texts = read_texts(spark, str(tmp_path))
    assert texts.inputFiles() == []  # no list of files on the driver
    got = {r.file_path: r.content for r in texts.collect()}
    assert got == {p: t for p, t in (want | odd).items() if t.strip(" ")} | {"bytes": "a�\0b"}
    assert {r.file_path: r.content for r in read_texts(spark, f"file://{tmp_path}/").collect()} == got
    assert {r.file_path: r.size for r in list_files(spark, str(tmp_path)).collect()} == {p: len(t.encode()) for p, t in (want | odd).items()} | {"bytes": 4}


def test_patterns_of_names(spark, tmp_path):
    for name in ("a.py", "b.md", "c.txt", "d/a.py", "d/ab.py", "d/a.pyc", "a.py/x"):
        put(tmp_path / str(name == "a.py/x"), name)
    found = lambda p: sorted(r.file_path.partition("/")[2] for r in list_files(spark, str(tmp_path), p).collect())
    hadoop = lambda p: sorted(r.path.removeprefix(f"file:{tmp_path}/").partition("/")[2] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(str(tmp_path)).select("path").collect())
    for pattern in ("*", "*.py", "?.py", "*.{py,md}", "{a,c}.{py,txt}", "[ab].*", "[^a].*", "a.py", "x"):
        assert found(pattern) == hadoop(pattern), pattern


def test_driver_holds_no_listing_of_a_flat_folder(tmp_path):
    for k in range(3000):
        put(tmp_path, f"flat/file_of_a_long_name_{k:080d}")
    put(tmp_path, "flat/in/ner")
    reader = FolderReader({"path": str(tmp_path)})
    tracemalloc.start()
    parts = [p.value for p in reader.partitions()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts == [("", False), ("flat", False), ("flat/in", False)] and peak < 200_000


def test_slices_of_bytes():
    assert list(slices([], 10)) == [] and list(slices([50], 10)) == [(0, 1)]
    assert list(slices([4, 6, 1, 99, 0, 0, 10, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]


def test_files_are_made_without_a_join(spark, sf_dir):
    from quarry.sources import adapters as A

    made = A.contents(spark, sf_dir)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = A.files(spark, sf_dir).where("file_path IS NOT NULL").select("id", "file_path", "description")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
