"""Nearest neighbours from stored lists, exact, with lists and rows ruled out by the triangle inequality.

Vectors of length 1 lie in the list of their nearest pivot, sorted by their distance from it. A query looks into its
nearest lists until these hold k rows, which bounds the distance of its kth neighbour. Another list can hold a nearer row
only if the list's distances from its pivot, and the plane halfway between that pivot and the query's own, leave room for
it; and of such a list only rows whose distance from the pivot differs from the query's by no more than the bound.

Many queries go together by list: a list is read once for all that look into it, and lists that none does aren't read.
What is ruled out depends on the vectors: those in groups leave few lists, those without any structure leave most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.shared import file_system, shared_folder

LISTED = "id long, list int, dist double, vector array<double>"
HITS = "query_id long, id long, similarity double, scored long"
#: What rounding may add to a distance.
SLACK = 1e-6


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def _usable(batch: pa.RecordBatch, vector: int, dimensions: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector has the length, is finite and isn't zero, and their vectors."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(vector)), dimensions), False))
    v = batch.column(vector).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
    fit = np.isfinite(v).all(1) & (v != 0).any(1)
    return batch.filter(pa.array(fit)), v[fit]


def make_pivots(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of so many groups of the sample, of length 1, by a few rounds of Lloyd's."""
    u = _unit(sample)
    pivots = u[np.linspace(0, len(u) - 1, min(lists, len(u))).astype(int)]
    for _ in range(rounds):
        own = (u @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, u)
        lengths = np.sqrt((sums * sums).sum(1, keepdims=True))
        pivots = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), pivots)
    return np.unique(pivots, axis=0)


class VectorLists:
    """Stored lists of the vectors of one length. ``sample`` vectors, those of the least hashes, make the pivots."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/quarry-lists-{uuid.uuid4().hex}").rstrip("/")
        self.pivots = np.zeros((0, 0))
        self.bounds: dict[int, tuple[float, float, int]] = {}

    def build(self, vectors: DataFrame, lists: int | None = None, sample: int = 20_000, most: int = 4096) -> VectorLists:
        """vectors: id, vector. Those that are null, zero, not finite or of another length than most of the sample have no
        similarity to any, and go."""
        few = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
        sizes = [len(r["vector"]) for r in few]
        self.dimensions = max(set(sizes), key=sizes.count) if sizes else 0
        shown = np.array([r["vector"] for r in few if len(r["vector"]) == self.dimensions and all(x is not None and np.isfinite(x) for x in r["vector"]) and any(r["vector"])], float)
        if not len(shown):
            shown = np.ones((1, max(self.dimensions, 1)))
        number = lists or int(min(most, max(1, vectors.count() ** 0.5)))
        self.pivots = pivots = make_pivots(shown, number)
        dimensions = pivots.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch, v = _usable(batch, 1, dimensions)
                for k in range(0, len(v), 4096):
                    d = _distances(_unit(v[k : k + 4096]), pivots)
                    own = d.argmin(1)
                    part = batch.slice(k, 4096)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), part.column(1)], names=["id", "list", "dist", "vector"])

        listed = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(work, LISTED)
        listed.repartitionByRange("list", "dist").sortWithinPartitions("list", "dist").write.parquet(f"{self.folder}/lists")
        self.spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "list int, pivot array<double>").coalesce(1).write.parquet(f"{self.folder}/pivots")
        return self.open()

    def ready(self) -> bool:
        fs, at = file_system(self.spark, f"{self.folder}/pivots/_SUCCESS")
        return fs.exists(at)

    def open(self) -> VectorLists:
        rows = self.spark.read.parquet(f"{self.folder}/pivots").orderBy("list").collect()  # as many as there are lists
        self.pivots = np.array([r["pivot"] for r in rows])
        self.dimensions = self.pivots.shape[1]
        sizes = self.rows().groupBy("list").agg(F.min("dist").alias("least"), F.max("dist").alias("most"), F.count("*").alias("n")).collect()
        self.bounds = {r["list"]: (r["least"], r["most"], r["n"]) for r in sizes}
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LISTED).parquet(f"{self.folder}/lists")

    def nearest_many(self, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
        """query_id, rank, id, similarity, as ``vectors.nearest_many`` says. queries: query_id, vector."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
        hits = self.hits(queries, k, block).where("id IS NOT NULL").select("query_id", "id", "similarity")
        return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")

    def hits(self, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
        """HITS: the k best of each query and some more, and for each task a row without an id that says how many rows it
        has compared. Queries are taken ``block`` at a time."""
        found, last = self.spark.createDataFrame([], HITS), None
        while True:
            rest = queries if last is None else queries.where(F.col("query_id") > last)
            rows = rest.orderBy("query_id").limit(block).collect()  # a block, of a size that is a parameter
            own = [r for r in rows if r["vector"] and len(r["vector"]) == self.dimensions and all(x is not None and np.isfinite(x) for x in r["vector"]) and any(r["vector"])]
            if own:
                found = found.unionByName(self._block([r["query_id"] for r in own], np.array([r["vector"] for r in own], float), k))
            if len(rows) < block:
                return found
            last = rows[-1]["query_id"]

    def _block(self, ids: list[int], q: np.ndarray, k: int) -> DataFrame:
        lists = sorted(self.bounds)
        least, most, sizes = (np.array([self.bounds[j][x] for j in lists]) for x in range(3))
        pivots = self.pivots[lists]
        d = _distances(_unit(q), pivots)
        order = d.argsort(1, kind="stable")
        before = np.take_along_axis(np.broadcast_to(sizes, d.shape), order, 1).cumsum(1) - np.take_along_axis(np.broadcast_to(sizes, d.shape), order, 1)
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, before < k, 1)  # nearest lists until they hold k rows
        near = self._look(ids, q, d, first, np.full(len(ids), np.inf), lists, k)
        path = f"{self.folder}/first-{uuid.uuid4().hex}"
        near.write.parquet(path)
        near = self.spark.read.schema(HITS).parquet(path)
        kth = Window.partitionBy("query_id").orderBy(F.col("similarity").desc())
        held = near.where("id IS NOT NULL").withColumn("k", F.row_number().over(kth)).where(F.col("k") == k).select("query_id", "similarity").collect()
        reached = {r["query_id"]: r["similarity"] for r in held}
        bound = np.array([np.sqrt(max(2 - 2 * reached[i], 0)) + SLACK if i in reached else np.inf for i in ids])
        # the triangle inequality, and the plane halfway between a list's pivot and the query's nearest one
        lower = np.maximum(d - most, least - d)
        own = order[:, 0]
        between = _distances(pivots[own], pivots)
        plane = (d**2 - d[np.arange(len(ids)), own][:, None] ** 2) / np.maximum(2 * between, 1e-9)
        lower = np.maximum(lower, np.where(between > 1e-6, plane, 0))
        rest = ~first & (lower <= bound[:, None])
        if not rest.any():
            return near
        return near.unionByName(self._look(ids, q, d, rest, bound, lists, k))

    def _look(self, ids: list[int], q: np.ndarray, d: np.ndarray, where: np.ndarray, bound: np.ndarray, lists: list[int], k: int) -> DataFrame:
        """Compares each query with the rows of its lists that its bound leaves."""
        asked = {j: np.flatnonzero(where[:, n]) for n, j in enumerate(lists) if where[:, n].any()}
        place = {j: n for n, j in enumerate(lists)}
        numbers = np.array(ids, np.int64)
        norms = np.sqrt((q * q).sum(1))
        dimensions = self.dimensions

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scored, best = 0, {}
            for batch in batches:
                at = batch.column(1).to_numpy()
                dist, own = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                v = batch.column(3).flatten().to_numpy().reshape(-1, dimensions)
                cuts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
                for s, e in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                    for n in range(s, e, 4096):
                        part = slice(n, min(n + 4096, e))
                        mine = asked.get(int(at[s]))
                        if mine is None:
                            continue
                        fits = np.abs(d[mine, place[int(at[s])]][:, None] - dist[None, part]) <= bound[mine][:, None]
                        mine, fits = mine[fits.any(1)], fits[fits.any(1)]
                        keep = fits.any(0)
                        if not len(mine):
                            continue
                        x, names, fits = v[part][keep], own[part][keep], fits[:, keep]
                        sims, squares = np.zeros(fits.shape), np.zeros(len(x))
                        for c in range(dimensions):  # summed in order, as the column expressions are
                            sims += q[mine, c : c + 1] * x[None, :, c]
                            squares += x[:, c] * x[:, c]
                        sims /= norms[mine][:, None] * np.sqrt(squares)[None, :]
                        scored += int(fits.sum())
                        for r, i in enumerate(mine.tolist()):
                            sim, name = sims[r][fits[r]], names[fits[r]]
                            if i in best:
                                sim, name = np.append(best[i][0], sim), np.append(best[i][1], name)
                            top = np.lexsort((name, -sim))[:k]
                            best[i] = sim[top], name[top]
            for i, (sim, name) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sim), numbers[i])), pa.array(name), pa.array(sim), pa.nulls(len(sim), pa.int64())], names=["query_id", "id", "similarity", "scored"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([scored], pa.int64())], names=["query_id", "id", "similarity", "scored"])

        return self.rows().where(F.col("list").isin(sorted(asked))).mapInArrow(work, HITS)
