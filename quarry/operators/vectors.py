"""Vectors: replacement by file, filtered nearest neighbours, thresholds and duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.functions.text import namespace
from quarry.operators.catalog import latest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows most similar to one query: a scan with a top k in each task. Ties go to the smaller id."""
    kept = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return kept.withColumn("similarity", cosine(F.col("vector"), q)).orderBy(F.col("similarity").desc(), "id").limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, rank, id, similarity. queries: query_id, vector.

    Queries are taken ``block`` at a time, of a bounded size; each task keeps k rows a query, and only those move."""
    schema = "query_id long, id long, similarity double"
    found, last = None, None
    while True:
        rest = queries if last is None else queries.where(F.col("query_id") > last)
        rows = rest.orderBy("query_id").limit(block).collect()
        if not rows and found is not None:
            break
        own = _neighbours([r["query_id"] for r in rows], [r["vector"] for r in rows], k)
        part = vectors.select("id", "vector").mapInArrow(own, schema)
        found = part if found is None else found.unionByName(part)
        if len(rows) < block:
            break
        last = rows[-1]["query_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _neighbours(ids: list[int], asked: list[list[float] | None], k: int):
    """Rows whose vector is null, of another length, not finite or of length zero have no similarity: they take no part."""
    dimensions = max((len(v) for v in asked if v), default=0)
    usable = [(i, v) for i, v in zip(ids, asked, strict=True) if v and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in usable]
    q = np.array([v for _, v in usable], float).reshape(len(ids), dimensions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((q * q).sum(1))
        best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            if not len(ids):
                continue
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dimensions))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dimensions)
            fit = np.isfinite(v).all(1) & (v != 0).any(1)
            own, v = own[fit], v[fit]
            # summed in order, as the column expressions are
            sims = np.zeros((len(ids), len(own)))
            squares = np.zeros(len(own))
            for d in range(dimensions):
                sims += q[:, d : d + 1] * v[None, :, d]
                squares += v[:, d] * v[:, d]
            sims /= norms[:, None] * np.sqrt(squares)[None, :]
            best, best_id = np.concatenate([best, sims], 1), np.concatenate([best_id, np.broadcast_to(own, sims.shape)], 1)
            if best.shape[1] > k:
                # all that reach the k-th similarity, then ties by id
                least = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k]
                order = np.lexsort((best_id, np.where(best >= least, -best, np.inf)), axis=1)[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
        if best.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), best.shape[1])), pa.array(best_id.ravel()), pa.array(best.ravel())], names=["query_id", "id", "similarity"])

    return work


def similar(hits: DataFrame, threshold: float | None, limit: int, default: float = 0.5) -> DataFrame:
    """hits: query_id, id, similarity, file_path, content_hash. At or above the threshold, the best of each file and
    content, the ``limit`` best in all. A threshold of 0 or none means the default. Similarities that agree in nine
    digits are ties, which go to the smaller id."""
    kept = hits.where(F.col("similarity") >= (threshold or default))
    order = [F.round("similarity", 9).desc(), F.col("id")]
    return latest(kept, ["file_path", "content_hash"], *order).orderBy(*order).limit(limit)


def replace_by_file(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with those of the files in ``new`` replaced; columns that one side lacks are null there."""
    files = new.select("project_id", "file_path").distinct()
    return stored.join(files, ["project_id", "file_path"], "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vectors(stored: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Stored rows with those of the same id replaced; of rows that ``new`` has for one id the last by ``order`` stays, or the
    largest by all columns that have an order; columns that one side lacks are null there."""
    by = order or [f.name for f in new.schema if f.dataType.typeName() not in ("map", "variant")]
    once = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), F.struct(*by)).alias("row")).select("row.*")
    return stored.join(once.select("id"), "id", "left_anti").unionByName(once, allowMissingColumns=True)


def drop_namespace(vectors: DataFrame, name: str) -> DataFrame:
    """Vectors without those of one namespace."""
    return vectors.where(namespace(F.col("project_id")) != name)


def delete_files(stored: DataFrame, files: DataFrame) -> DataFrame:
    return stored.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")


def latest_mtimes(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("project_id", "file_path").agg(F.max(F.col("file_mtime").cast("double")).alias("mtime"))


def vanished(vectors: DataFrame, listing: DataFrame) -> DataFrame:
    """Files with vectors that the listing lacks."""
    return vectors.select("project_id", "file_path").distinct().join(listing, ["project_id", "file_path"], "left_anti")


def embed(chunks: DataFrame, dimensions: int = 256) -> DataFrame:
    """chunks with ``vector``: hashed words, of length 1. A local stand-in for a remote model. A batch's words are counted at
    once."""
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            sizes = np.diff(own.offsets.to_numpy())
            at = np.repeat(np.arange(len(sizes)), sizes) * dimensions + own.flatten().to_numpy()
            counts = np.bincount(at, minlength=len(sizes) * dimensions).reshape(-1, dimensions).astype(float)
            counts /= np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-300)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dimensions, pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "vector"])

    rows = chunks.withColumn("_slots", F.coalesce(slots, F.array().cast("array<int>")))
    return rows.mapInArrow(work, StructType([*chunks.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def embedding_cost(texts: DataFrame, column: str, per_thousand: float = 0.00013) -> DataFrame:
    tokens = F.sum(F.floor(F.char_length(column) / 4)).cast("long")
    return texts.agg(tokens.alias("tokens"), F.round(tokens / 1000 * per_thousand, 6).alias("cost"))


def regroup(flat: DataFrame, boundaries: DataFrame) -> DataFrame:
    """flat: batch, vectors (all of a request, in order). boundaries: batch, file_path, start, end. The files' own."""
    return boundaries.join(flat, "batch").select("batch", "file_path", F.slice("vectors", F.col("start") + 1, F.col("end") - F.col("start")).alias("vectors"))
