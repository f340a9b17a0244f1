"""Near copies among embeddings by Euclidean p-stable hashing, with exact cosine checks.

Vectors are brought to length 1, where a cosine c is a distance of sqrt(2 - 2c). A table hashes a vector by k random
projections, shifted and cut into steps of a fixed width; vectors that agree in all k share a bucket. k follows the number
of vectors, the number of tables the recall that is asked for at the least cosine. Buckets are dealt out in cells of a
bounded size, two parts of a large bucket at a time, and every two vectors that meet in a cell are compared exactly.

Two vectors that share buckets of several tables count in the first of them alone, which each cell decides for itself.
A cell returns, for each vector that has links, their number and the root of its tree in a spanning forest of them: a group
of n close vectors costs n rows, not n^2. A few tables are taken at a time, so that as few copies of the vectors lie on disk.

Equal vectors are one, with a count. Projections are sums of whole numbers that doubles hold exactly, so that any task
finds the same bucket for a vector, whatever the batch it comes in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.simhash import Forest, components
from quarry.llm.storage import Scratch
from quarry.llm.topk import _matrices

#: Components of a unit vector and of a projection are whole multiples of these.
UNIT, STEP = 2.0**-22, 2.0**-18


def same_step(distance: np.ndarray | float, width: float) -> np.ndarray:
    """How likely two points at a distance fall into the same step of a random Gaussian projection."""
    r = width / np.maximum(distance, 1e-9)
    normal = np.vectorize(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))(r)
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - np.exp(-(r**2) / 2))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in doubles."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Tables:
    """The projections of a number of tables, for vectors of any number of components."""

    def __init__(self, k: int, count: int, width: float, seed: int):
        self.k, self.count, self.width, self.seed = k, count, width, seed
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _projections(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        if d not in self.made:
            rng = np.random.default_rng((self.seed, d))
            n = self.k * self.count
            self.made[d] = np.rint(rng.standard_normal((d, n)) / STEP), np.rint(rng.uniform(0, self.width, n) / (UNIT * STEP))
        return self.made[d]

    def keys(self, unit: np.ndarray, first: int, last: int) -> np.ndarray:
        """The bucket of each vector in each of the tables first..last - 1."""
        a, b = self._projections(unit.shape[1])
        own = slice(first * self.k, last * self.k)
        steps = np.floor((np.rint(unit / UNIT) @ a[:, own] + b[own]) * (UNIT * STEP / self.width)).astype(np.int64).view(np.uint64)
        steps = steps.reshape(len(unit), last - first, self.k)
        with np.errstate(over="ignore"):
            key = np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1])
            key = np.repeat(key[None, :], len(unit), axis=0)
            for j in range(self.k):
                key = (key ^ steps[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
        return key


def plan(vectors: np.ndarray, count: int, cosine: float, recall: float, width: float, bucket: int, most: int) -> tuple[int, int]:
    """(k, tables) for so many vectors, of which some are given: the least k at which a vector shares a bucket with at most
    ``bucket`` others that it isn't close to, on average, or the last that needs no more than ``most`` tables."""
    close = float(same_step(math.sqrt(2 - 2 * cosine), width))
    need = lambda k: math.ceil(math.log(1 - recall) / math.log1p(-(close**k)))
    far = np.zeros(0)
    if len(vectors) > 1:
        u = units(vectors)
        cosines = (u @ u.T)[np.triu_indices(len(u), 1)]
        far = same_step(np.sqrt(2 - 2 * cosines[cosines < cosine]), width)
    k = 1
    while len(far) and count * float((far**k).mean()) > bucket and need(k + 1) <= most:
        k += 1
    return k, need(k)


def _hashed(tables: Tables, first: int, last: int):
    """For mapInArrow over cls, n, v: a row for each table, with the bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = np.arange(batch.num_rows), batch.column(2)
            for own, v in _matrices(rows, vectors):
                keys = tables.keys(units(v), first, last).view(np.int64)
                part = batch.take(pa.array(own))
                for t in range(last - first):
                    columns = [pa.array(np.full(len(own), first + t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t])), *part.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["tab", "bucket", "cls", "n", "v"])

    return work


def cells_of(hashed: DataFrame, cell: int, held: int = 100_000) -> DataFrame:
    """hashed with i, j, side: vectors of a bucket lie in parts of about ``cell``, and a cell holds one part (i = j) or two.
    ``held`` is how many buckets of more may be sent to all executors; beyond that they are joined by a shuffle."""
    sizes = hashed.groupBy("tab", "bucket").agg(F.count("*").alias("size"))
    parts = sizes.where(F.col("size") > cell).select("tab", "bucket", F.ceil(F.col("size") / cell).cast("int").alias("parts"))
    large = parts.collect() if parts.limit(held + 1).count() <= held else None
    if large is not None and not large:
        one = F.lit(0)
        return hashed.select("*", one.alias("i"), one.alias("j"), one.alias("side"))
    if large is not None:
        parts = F.broadcast(hashed.sparkSession.createDataFrame(large, parts.schema))
    of = hashed.join(parts, ["tab", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    dealt = of.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select("tab", "bucket", "cls", "n", "v", i.alias("i"), j.alias("j"), F.when(F.col("own") == i, 0).otherwise(1).alias("side"))


def links_in(cls: np.ndarray, n: np.ndarray, side: np.ndarray, vectors: np.ndarray, table: int, across: bool, tables: Tables, cosine: float) -> tuple[np.ndarray, ...]:
    """(cls, links, root) of the vectors of a cell that have links which no earlier table shows."""
    u = units(vectors)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(u)), np.arange(len(u)))
    a, b = np.nonzero(u[left] @ u[right].T >= cosine)
    a, b = left[a], right[b]
    if not across:
        a, b = a[a < b], b[a < b]
    if len(a) and table:
        some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys, x, y = tables.keys(u[some], 0, table), at[: len(a)], at[len(a) :]
        for t in range(table):
            fresh = keys[x, t] != keys[y, t]
            a, b, x, y = a[fresh], b[fresh], x[fresh], y[fresh]
    if not len(a):
        return cls[:0], cls[:0], cls[:0]
    links = np.bincount(a, n[b], len(u)) + np.bincount(b, n[a], len(u))
    forest = Forest(len(u))
    forest.unite(a, b)
    some = np.flatnonzero(links)
    return cls[some], links[some].astype(np.int64), cls[forest.roots(some)]


def _compared(tables: Tables, cosine: float):
    """For mapInArrow over sorted cells. What is held is the rows of one cell."""
    names = ["tab", "bucket", "i", "j"]

    def links(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        if cell.num_rows > 1:
            cell = cell.combine_chunks()
            cls, n, side = (cell[c].to_numpy() for c in ("cls", "n", "side"))
            vectors = cell["v"].combine_chunks()
            t, across = cell["tab"][0].as_py(), cell["i"][0].as_py() != cell["j"][0].as_py()
            for own, v in _matrices(np.arange(len(cls)), vectors):
                found = links_in(cls[own], n[own], side[own], v, t, across, tables, cosine)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["cls", "links", "root"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in names])
            starts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), table.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                key = tuple(keys[:, s])
                if held and key != at:
                    yield from links(pa.concat_tables(held))
                    held = []
                at = key
                held.append(table.slice(s, e - s))
        if held:
            yield from links(pa.concat_tables(held))

    return work


def _takes_part(v: Column) -> Column:
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound, F.lit(False))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, width: float = 2.0, bucket: int = 128, most: int = 384,
    sample: int = 1000, copies: int = 3, cell: int = 1024, seed: int = 13,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors`` (vec_id, embedding).

    Vectors are linked if their cosine is ``cosine`` or more; n_links counts the other rows linked directly, component_id
    is the smallest vec_id that links lead to, and kept is vec_id = component_id. A link exactly at ``cosine`` is found
    with a chance of ``recall``, a closer one with more; what is found is exact. Vectors that are null, empty, zero or
    hold null or non-finite components, and vectors of different length, have no link. A row without a vec_id counts as a
    link but names no component: alone it has a null component_id and is kept. Rows that repeat are vectors each. An
    empty table gives an empty result; other columns are ignored.

    ``sample`` vectors, those of the least hashes, choose how many projections a table has; ``most`` bounds the tables.
    A task holds two parts of ``cell`` vectors. Vectors are told apart by two 64-bit hashes.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    sound = _takes_part(v)
    keyed = vectors.select("vec_id", v, F.when(sound, F.xxhash64(v)).alias("h1"), F.when(sound, F.xxhash64(F.lit(1), v)).alias("h2"))
    grouped = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("v"))
    classes = scratch.store(grouped.withColumn("cls", F.monotonically_increasing_id()))
    count = classes.count()
    few = classes.select("h1", "h2", "v").orderBy("h1", "h2").limit(sample).collect()
    lengths = [len(r["v"]) for r in few]
    usual = max(set(lengths), key=lengths.count) if lengths else 0
    shown = np.array([r["v"] for r in few if len(r["v"]) == usual], np.float64).reshape(-1, usual) if usual else np.zeros((0, 1))
    k, number = plan(shown, count, cosine, recall, width, bucket, most)
    tables = Tables(k, number, width, seed)
    found = []
    for first in range(0, number, copies):
        hashed = classes.select("cls", "n", "v").mapInArrow(_hashed(tables, first, min(first + copies, number)), "tab int, bucket long, cls long, n long, v " + dict(classes.dtypes)["v"])
        dealt = cells_of(hashed, cell)
        key = ["tab", "bucket", "i", "j"]
        found.append(scratch.store(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared(tables, cosine), "cls long, links long, root long")))
    links = spark.read.schema("cls long, links long, root long").parquet(*(t.stored_at for t in found))
    joined = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    of = classes.select("h1", "h2", "least", "n", "cls").join(joined, F.col("cls") == F.col("node"), "left").join(counts, "cls", "left")
    of = scratch.store(of.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.store(of.join(least, "component").select("h1", "h2", "n_links", "component_id"))
    scratch.keep(named)
    rows = keyed.drop("embedding").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
