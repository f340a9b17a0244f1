"""Exact top-k search by inner product, with distributed histogram selection.

Queries are taken in blocks of a fixed size. For a block, every task scores all its vectors and counts the scores in
equal bins between the bounds that each query has reached; the counts are summed over tasks, and the bin that holds a
query's kth value becomes its new bounds. A few rounds bring each query's threshold down to a handful of rows above it.
Where a score is shared by more rows than there are places, the same rounds go on over their ids. Only then are rows
collected: those at or above the thresholds, which are ranked and cut exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch

#: Sums below this are exact in double arithmetic.
EXACT = 2**53


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, each component floor(scale * x). Vectors that are null or empty, or hold a null or non-finite
    component, are left out, and so are rows without a vec_id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select("vec_id", whole.alias("v"))


def _matrices(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and components of the vectors of each length."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.flatten().to_numpy(), np.diff(ends)
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        yield ids[own], flat[(ends[own] - ends[0])[:, None] + np.arange(d)]


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as longs: by doubles where every partial sum is exact, else by longs."""
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


class _Block:
    """A block of queries and the bounds that each has reached; it travels to the workers."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ids, n = ids, len(ids)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            self.by_length[int(d)] = (own, np.stack([vectors[i] for i in own]))
        #: score range [low, high) with the kth value, places left in it
        self.low, self.high, self.left = np.full(n, -(2**62)), np.full(n, 2**62), np.full(n, k)
        #: once the score is settled: the range of ids among the rows that share it
        self.tied, self.id_low, self.id_high = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.settled = np.zeros(n, bool)

    def scored(self, batch: pa.RecordBatch, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query positions, vector ids, scores with a query's own row masked out), for blocks of vectors."""
        for ids, vectors in _matrices(batch.column(0).to_numpy(), batch.column(1)):
            if vectors.shape[1] in self.by_length:
                own, queries = self.by_length[vectors.shape[1]]
                for k in range(0, len(ids), rows):
                    part = ids[k : k + rows]
                    yield own, part, np.ma.array(_scores(queries, vectors[k : k + rows]), mask=self.ids[own][:, None] == part[None, :])


def _count(block: _Block, bins: int):
    """For mapInArrow: (query, bin, n), summed over the task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        total = np.zeros((n, bins), np.int64)
        for batch in batches:
            for own, ids, scores in block.scored(batch):
                tied = block.tied[own][:, None]
                value = np.where(tied, ids[None, :], scores.data)
                low = np.where(block.tied, block.id_low, block.low)[own][:, None]
                high = np.where(block.tied, block.id_high, block.high)[own][:, None]
                ok = ~scores.mask & (value >= low) & (value < high) & (~tied | (scores.data == block.low[own][:, None])) & ~block.settled[own][:, None]
                q, r = np.nonzero(ok)
                if len(q):
                    width = np.maximum(1, -(-(high - low) // bins))[q, 0]
                    np.add.at(total, (own[q], (value[q, r] - low[q, 0]) // width), 1)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(total[q, b], pa.int64())], names=["q", "bin", "n"])

    return work


def _hits(block: _Block):
    """For mapInArrow: the rows at or above the thresholds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, scores in block.scored(batch):
                low = block.low[own][:, None]
                same = (scores.data == low) & block.tied[own][:, None]
                ok = ~scores.mask & (scores.data >= low) & (~same | (ids[None, :] < block.id_high[own][:, None]))
                q, r = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[own[q]]), pa.array(ids[r]), pa.array(scores.data[q, r])], names=["query_id", "vec_id", "score"])

    return work


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048, bins: int = 1024, slack: int = 64, scale: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best of ``vectors`` without its own vec_id.

    Both have vec_id and embedding. Ties go to the smaller vec_id; with fewer than k candidates all are returned. Only
    vectors of a query's own length have an inner product with it. Vectors that ``whole_vectors`` leaves out take no
    part. Repeated rows are candidates each; of queries with one vec_id the largest vector asks. Scores are longs; sums beyond 2**63 are not supported. Empty tables give an empty
    result, and other columns are ignored. A task holds ``block`` queries and ``block * bins`` counts, whatever the
    tables' sizes; ``slack`` is how many rows beyond k a query may bring to the last step.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    table = scratch.store(whole_vectors(vectors, scale))
    asked = whole_vectors(queries, scale).groupBy("vec_id").agg(F.max("v").alias("v"))
    ranged = scratch.store(asked.repartitionByRange("vec_id"))
    found, last = [], None
    while True:
        rows = ranged.where(F.col("vec_id") > last) if last is not None else ranged
        own = rows.orderBy("vec_id").limit(block).collect()  # a block, of a size that is a parameter
        if not own and found:
            break
        last = own[-1]["vec_id"] if own else 0
        hits = _search_block(table, own, k, bins, slack)
        if len(own) < block:
            found.append(hits)
            break
        found.append(scratch.store(hits))  # so that the plan doesn't grow with the number of blocks
    hits = found[-1]
    if len(found) > 1:
        stored = [t.stored_at for t in found if hasattr(t, "stored_at")]
        hits = spark.read.schema(hits.schema).parquet(*stored)
        hits = hits if len(stored) == len(found) else hits.union(found[-1])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_block(table: DataFrame, own: list, k: int, bins: int, slack: int) -> DataFrame:
    block = _Block(np.array([r["vec_id"] for r in own], np.int64), [np.array(r["v"], np.int64) for r in own], k)
    if own:
        bound = table.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
        for d, (rows, queries) in block.by_length.items():
            most = np.minimum(np.abs(queries).astype(float).sum(1) * float(bound), float(2**61)).astype(np.int64)
            block.low[rows], block.high[rows] = -most, most + 1
        ids = table.agg(F.min("vec_id"), F.max("vec_id")).first()
    #: rows known to lie above the present range
    need = block.left.copy()
    while own and not block.settled.all():
        counts = table.mapInArrow(_count(block, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # from the best end: the bin where the sum reaches what is still needed
        best_first = F.when(F.element_at(F.lit(block.tied.tolist()), (F.col("q") + 1).cast("int")), F.col("bin")).otherwise(-F.col("bin"))
        order = Window.partitionBy("q").orderBy(best_first)  # at most ``bins`` rows
        upto = counts.withColumn("upto", F.sum("n").over(order))
        wanted = F.element_at(F.lit(need.tolist()), (F.col("q") + 1).cast("int"))
        reached = upto.where(F.col("upto") >= wanted).groupBy("q").agg(F.min(F.struct("upto", "n", "bin")).alias("at")).collect()
        seen = np.zeros(len(need), bool)
        for r in reached:
            q, (upto_n, n, b) = r["q"], r["at"]
            seen[q] = True
            low, high = (block.id_low[q], block.id_high[q]) if block.tied[q] else (block.low[q], block.high[q])
            width = max(1, -(-(high - low) // bins))
            new_low, new_high = low + b * width, min(high, low + (b + 1) * width)
            need[q] -= upto_n - n
            few = n - need[q] <= slack
            if block.tied[q]:
                block.id_low[q], block.id_high[q] = new_low, new_high
                block.settled[q] = few or width == 1
            else:
                block.low[q], block.high[q] = new_low, new_high
                block.settled[q] = few
                if not few and width == 1:
                    block.tied[q], block.id_low[q], block.id_high[q] = True, ids[0], ids[1] + 1
        block.settled |= ~seen  # fewer candidates than places: all of the range is taken
    return table.mapInArrow(_hits(block), "query_id long, vec_id long, score long")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
