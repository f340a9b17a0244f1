"""Folds over the rows of a key in order, where each row's result depends on the rows before it.

Rows of a key come together and sorted, and stream through one task: what is held is the state of one key, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.shared import shared_folder


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that only a slice's texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)



def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], schema: str) -> DataFrame:
    """rows with the columns of ``schema`` added: ``step`` takes a key's state and the next row, which it may change the state
    by, and returns their values. ``start`` makes the state of a key."""
    added = [field.split() for field in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if (at := tuple(row[k] for k in keys)) != key or state is None:
                    key, state = at, start()
                made.append(step(state, row))
            columns = zip(*made, strict=True) if made else [[] for _ in added]
            arrays = [pa.array(c, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[kind]) for c, (_, kind) in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(name for name, _ in added)])

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(work, StructType([*rows.schema.fields, *StructType.fromDDL(schema).fields]))


def placed(rows: DataFrame, keys: list[str], order: list[str], *sums: str) -> DataFrame:
    """rows with ``place`` (from 1, in the order of its key), ``n`` (rows of the key), and ``upto_x`` for each x of ``sums``.

    Rows are dealt by ranges of keys and order, numbered within each range, and moved on by what lies before it: a key that
    holds most rows is spread over many tasks. The ranges are checkpointed, as another run would draw them elsewhere."""
    shared_folder(rows.sparkSession)  # sets a folder for checkpoints where there is none
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.select("*", F.count(F.lit(1)).over(own).alias("_place"), *(F.sum(c).over(own).alias(f"_upto_{c}") for c in sums))
    parts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = Window.partitionBy(*keys)
    shifts = parts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"), *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))
    same = [numbered[k].eqNullSafe(shifts[k]) for k in [*keys, "_range"]]
    joined = numbered.join(shifts, same)
    return joined.select(*(numbered[c] for c in rows.columns), (F.col("_place") + F.col("_before")).alias("place"), "n", *((F.col(f"_upto_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in sums))
