"""Folders as data sources: ``folder`` lists one, ``folder_changes`` follows one as a stream.

A folder is anything that Arrow's file systems reach from driver and executors: a mounted path or a URI. Folders whose name
matches a pattern of ``pruned`` are never entered.

``folder`` parts the tree into subfolders, each a task's; the driver sees names of folders down to the level where there are
enough, and no files. Of a mounted path no listing is held whole, however many files a folder has. ``read_files`` reads listed
files where Spark's own reader would list them all on the driver. ``folder_changes`` polls: an offset is the number of a snapshot (path, size, time of every file) in the
folder ``state``, which has to outlive the query as its checkpoint does. The rows between two offsets are the difference of
their snapshots, so that a batch which runs again gives the same rows. ``maxFiles`` bounds what a batch takes on; what is
over waits for the next.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.operators.folds import pieces

FILES = "file_path string, size long, modified long"
CHANGES = "change string, file_path string, size long, modified long"
SNAPSHOT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("time", pa.int64())])
Seen = dict[str, tuple[int, int]]


class Folder:
    """A folder's files below it, as options name them."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.pruned = [p.strip().rstrip("/") for p in options.get("pruned", "").split(",") if p.strip()]
        self.most = int(options.get("maxfiles") or options.get("maxFiles") or 0)

    def _open(self) -> tuple[pf.FileSystem, str]:
        fs, at = pf.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pf.LocalFileSystem(), self.uri)
        return fs, at.rstrip("/")

    def _scan(self, inner: str, files: bool) -> Iterator[tuple[str, bool, int, int]]:
        """(path, whether a folder, size, time in ns) of what lies in one folder, relative to the root, files only if they are
        asked for. What has gone meanwhile isn't there."""
        fs, root = self._open()
        at = f"{root}/{inner}".rstrip("/") or "/"
        if not isinstance(fs, pf.LocalFileSystem):
            for f in fs.get_file_info(pf.FileSelector(at, allow_not_found=True)):
                if f.type == pf.FileType.Directory or files and f.type == pf.FileType.File:
                    yield f"{inner}/{f.base_name}".lstrip("/"), f.type == pf.FileType.Directory, f.size or 0, f.mtime_ns or 0
            return
        try:
            found = os.scandir(at)
        except FileNotFoundError:
            return
        with found:
            for f in found:
                if f.is_dir():
                    yield f"{inner}/{f.name}".lstrip("/"), True, 0, 0
                elif files:
                    try:
                        s = f.stat()
                    except FileNotFoundError:
                        continue
                    if stat.S_ISREG(s.st_mode):
                        yield f"{inner}/{f.name}".lstrip("/"), False, s.st_size, s.st_mtime_ns

    def entered(self, path: str) -> bool:
        return not any(fnmatch(path.rpartition("/")[2], p) for p in self.pruned)

    def folders(self, inner: str) -> list[str]:
        """Subfolders to enter."""
        return sorted(path for path, is_folder, _, _ in self._scan(inner, False) if is_folder and self.entered(path))

    def parts(self, enough: int) -> list[tuple[str, bool]]:
        """(folder, whether with all below it), disjoint, together the tree: at least so many if it has them."""
        done, level = [], [""]
        while level and len(level) + len(done) < enough:
            done += [(f, False) for f in level]
            with ThreadPoolExecutor(16) as pool:
                level = [f for folders in pool.map(self.folders, level) for f in folders]
        return done + [(f, True) for f in level]

    def walk(self, inner: str, below: bool) -> Iterator[tuple[str, int, int]]:
        todo = [inner]
        while todo:
            for path, is_folder, size, time in self._scan(todo.pop(), True):
                if not is_folder:
                    yield path, size, time
                elif below and self.entered(path):
                    todo.append(path)

    def snapshot(self) -> Seen:
        with ThreadPoolExecutor(16) as pool:
            listed = pool.map(lambda part: list(self.walk(*part)), self.parts(64))
            return {path: (size, time) for files in listed for path, size, time in files}


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.parallel = Folder(options), int(options.get("parallel", 64))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in self.folder.parts(self.parallel)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FILES.split(", ")]
        held: list[tuple[str, int, int]] = []

        def rows() -> pa.RecordBatch:
            paths, sizes, times = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array([t // 1_000_000_000 for t in times], pa.int64())], names=names)

        for file in self.folder.walk(*partition.value):
            held.append(file)
            if len(held) >= 10_000:
                yield rows()
                held = []
        if held:
            yield rows()


class FolderSource(DataSource):
    """Options: path, pruned (patterns of names, parted by commas), parallel (tasks at least, if there are folders)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def difference(before: Seen, now: Seen, most: int = 0) -> list[tuple[str, str, int, int]]:
    """(change, path, size, time) in path order, the first ``most`` of them if that isn't 0. A deleted file has its last size and time."""
    changes = [("created" if p not in before else "changed", p, *v) for p, v in now.items() if before.get(p) != v]
    changes += [("deleted", p, *v) for p, v in before.items() if p not in now]
    changes.sort(key=lambda c: c[1])
    return changes[:most] if most else changes


class FolderChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state = Folder(options), Folder({"path": options["state"]})
        self.rows = int(options.get("rowsPerTask", 50_000))

    def _numbers(self) -> list[int]:
        fs, at = self.state._open()
        names = [f.base_name for f in fs.get_file_info(pf.FileSelector(at, allow_not_found=True))]
        return sorted(int(n.removesuffix(".parquet")) for n in names if n.removesuffix(".parquet").isdigit())

    def _load(self, number: int, part: int = 0, parts: int = 1) -> Seen:
        """A snapshot, or of so many parts of it one; rows of the others are let go of as they are read."""
        if not number:
            return {}
        fs, at = self.state._open()
        seen: Seen = {}
        with fs.open_input_file(f"{at}/{number}.parquet") as file:
            for t in pq.ParquetFile(file).iter_batches(10_000):
                for path, size, time in zip(*(t.column(c).to_pylist() for c in ("path", "size", "time")), strict=True):
                    if parts == 1 or zlib.crc32(path.encode()) % parts == part:
                        seen[path] = (size, time)
        return seen

    def _save(self, number: int, seen: Seen) -> None:
        fs, at = self.state._open()
        fs.create_dir(at, recursive=True)
        paths = sorted(seen)
        table = pa.table([pa.array(paths, pa.string()), pa.array([seen[p][0] for p in paths], pa.int64()), pa.array([seen[p][1] for p in paths], pa.int64())], schema=SNAPSHOT)
        pq.write_table(table, f"{at}/{number}.part", filesystem=fs)
        fs.move(f"{at}/{number}.part", f"{at}/{number}.parquet")  # a snapshot is there whole or not at all

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The last snapshot, after another if the folder differs from it. One that was made but not read, as its query was
        lost, is simply the last."""
        last = max(self._numbers(), default=0)
        before = self._load(last)
        changes = difference(before, self.folder.snapshot(), self.folder.most)
        if not changes:
            return {"snapshot": last}
        for change, path, size, time in changes:
            if change == "deleted":
                del before[path]
            else:
                before[path] = (size, time)
        self._save(last + 1, before)
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        s, e = start["snapshot"], end["snapshot"]
        number = len(difference(self._load(s), self._load(e)))
        parts = -(-number // self.rows)
        return [InputPartition((s, e, k, parts)) for k in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        s, e, k, parts = partition.value
        for change, path, size, time in difference(self._load(s, k, parts), self._load(e, k, parts)):
            yield change, path, size, time // 1_000_000_000

    def commit(self, end: dict) -> None:
        fs, at = self.state._open()
        for n in self._numbers():
            if n < end["snapshot"]:
                fs.delete_file(f"{at}/{n}.parquet")


class FolderChanges(DataSource):
    """Options: path, pruned, state (a folder that driver and executors share), maxFiles (changes a batch), rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderChangesReader(self.options)


def walk_files(spark: SparkSession, folder: str, pruned: tuple[str, ...] = (), most: int | None = None, parallel: int = 64) -> DataFrame:
    """file_path (relative), size, modified: files below a folder, listed in tasks; with ``most``, the first in path order."""
    spark.dataSource.register(FolderSource)
    found = spark.read.format("folder").options(pruned=",".join(pruned), parallel=parallel).load(folder)
    return found if most is None else found.orderBy("file_path").limit(most)


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs that sum up to at most so much, or are one."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if sizes:
        yield first, len(sizes)


def read_files(rows: DataFrame, folder: str, most: int = 16 << 20) -> DataFrame:
    """file_path and content (bytes) of rows of file_path and size, as a listing has them. Paths are dealt to tasks anew, as a
    folder's are listed in one; a task holds the contents of ``most`` bytes, or of one file."""
    context = rows.sparkSession.sparkContext
    parts = max(4 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = Folder({"path": folder})._open()

        def read(path: str) -> bytes:
            with fs.open_input_stream(f"{root}/{path}") as file:
                return file.read()

        for batch in batches:
            for first, last in slices(batch.column(1).to_pylist(), most):
                paths = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([paths, pa.array(map(read, paths.to_pylist()), pa.binary())], names=["file_path", "content"])

    return rows.select("file_path", "size").repartition(parts, "file_path").mapInArrow(work, "file_path string, content binary")


def watch_files(spark: SparkSession, folder: str, state: str, pruned: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """A stream of change (created, changed, deleted), file_path, size, modified."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=folder, state=state, pruned=",".join(pruned), maxFiles=most).load()


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows of file_path and content as files below a folder that executors share."""
    uri = folder

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = Folder({"path": uri})._open()
        made: set[str] = set()
        for batch in pieces(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                at = f"{root}/{path}"
                if (parent := at.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(at) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("file_path", F.coalesce("content", F.lit(""))).mapInArrow(work, "n long").agg(F.sum("n")).collect()
