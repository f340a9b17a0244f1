"""Tables written to the folder that driver and executors share, and the text helpers every operator uses.

A stored table cuts lineage and survives the loss of executors: its files lie in ``spark.checkpoint.dir``, never on
one machine. Each call of an operator writes under its own name, so that calls don't disturb each other.
"""

from __future__ import annotations

import gc
import string
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder is set if the session is local;
    on a cluster, whose machines wouldn't share it, that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: While it is set, the files of a query's shuffles go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one call of an operator. ``drop`` removes one that its result no longer reads. With ``tidy``, the shuffles of a
    stored table go as soon as it is written, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def store(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(CLEANUP, "false")
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
        finally:
            if self.tidy:
                self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.stored_at = path
        return table

    def drop(self, table: DataFrame) -> None:
        self._delete(table.stored_at)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables stored so far but these, once only these are read on; and asks the driver to forget finished
        plans, which is when Spark removes the files of their shuffles."""
        held = {t.stored_at for t in tables}
        for number in range(self.count):
            if (path := f"{self.root}/{number}") not in held:
                self._delete(path)
        forget_plans(self.spark)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_plans(spark: SparkSession) -> None:
    """Collects garbage, in Python and on the driver: the files of a shuffle stay on disk as long as its plan is there."""
    for _ in range(2):  # what the first round lets go of may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def row_of(docs: DataFrame) -> Column:
    """``doc``, a struct of all columns, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("doc")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. For texts of ASCII alone the fast built-in does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, by which rows are held out; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def sql_lower_ascii(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"
