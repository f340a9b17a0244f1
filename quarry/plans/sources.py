"""Folders of files as sources: listings, texts, changes, ignore lists. The files are made from the documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import functions as F

from quarry.operators import ignore as I
from quarry.plans.registry import query
from quarry.sources import adapters as A
from quarry.sources.folders import Folder, walk_files, watch_files, write_files
from quarry.sources.listing import read_texts
from quarry.sources.shared import shared_folder, snapshot


def _folder(spark, sf) -> str:
    """A folder that holds a file for each document, written once for each state of the table."""
    root = f"{shared_folder(spark)}/quarry-files-{snapshot(spark, f'{sf}/documents.parquet')}"
    fs, at = Folder({"path": root})._open()
    if fs.get_file_info(f"{at}/written").type == pf.FileType.NotFound:
        write_files(A.contents(spark, sf), f"{root}/files")
        with fs.open_output_stream(f"{at}/written"):
            pass
    return f"{root}/files"


@query(f"WITH {A.FILES} SELECT file_path, strlen(coalesce(description, '')) AS size FROM files WHERE file_path IS NOT NULL AND NOT starts_with(file_path, 'fr/')")
def sc9_folder_listing(spark, sf):
    return walk_files(spark, _folder(spark, sf), pruned=("fr/", "node_modules")).select("file_path", "size")


@query(f"WITH {A.FILES} SELECT file_path, strlen(coalesce(description, '')) AS size FROM files WHERE file_path IS NOT NULL ORDER BY file_path LIMIT 37")
def sc10_first_files(spark, sf):
    return walk_files(spark, _folder(spark, sf), most=37).select("file_path", "size")


@query(f"WITH {A.FILES} SELECT file_path, sha256(description) AS content_hash FROM files WHERE file_path IS NOT NULL AND trim(description) <> ''")
def sc12_read_files(spark, sf):
    return read_texts(spark, _folder(spark, sf)).select("file_path", F.sha2("content", 256).alias("content_hash"))


@query(f"""WITH {A.FILES}, f AS (SELECT id, file_path, strlen(coalesce(description, '')) AS size FROM files WHERE file_path IS NOT NULL)
  SELECT 0 AS run, 'created' AS change, file_path, size FROM f WHERE id % 3 <> 0 UNION ALL SELECT 1, 'created', file_path, size FROM f WHERE id % 3 = 0
  UNION ALL SELECT 1, 'deleted', file_path, size FROM f WHERE id % 6 = 1 UNION ALL SELECT 1, 'changed', file_path, size + 7 FROM f WHERE id % 6 = 2""")
def sc23_folder_changes(spark, sf):
    """Two runs of a stream that follows a folder, from one checkpoint; files come, go and change between them."""
    root, f = f"{shared_folder(spark)}/quarry-watched-{uuid.uuid4().hex}", A.contents(spark, sf)
    write_files(f.where("id % 3 <> 0"), f"{root}/files")

    def run() -> None:
        changes = watch_files(spark, f"{root}/files", f"{root}/state")
        write = lambda df, batch: df.withColumn("run", F.lit(batch).cast("int")).write.mode("append").parquet(f"{root}/seen")
        changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    _remove(f.where("id % 6 = 1"), f"{root}/files")
    write_files(f.where("id % 6 = 2").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" edited"))).unionByName(f.where("id % 3 = 0")), f"{root}/files")
    run()
    return spark.read.parquet(f"{root}/seen").select("run", "change", "file_path", "size")


def _remove(rows, folder: str) -> None:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = Folder({"path": folder})._open()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs.delete_file(f"{root}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("file_path").mapInArrow(work, "n long").agg(F.sum("n")).collect()


LISTS = (("", "# words\n*.md\n!doc_1*.md\nde/\n!de/large/\n\n"), ("fr", "/large/\nsmall/doc_?.*"), ("es/small", "doc_*\n!doc_?[05].py\n"), ("it", "*"))


@query(f"""WITH {A.FILES}, n AS (SELECT project_id, file_path, string_split(file_path, '/')[-1] AS name FROM files WHERE file_path IS NOT NULL)
  SELECT project_id, file_path, (ends_with(name, '.md') AND NOT starts_with(name, 'doc_1')) OR starts_with(file_path, 'de/') OR starts_with(file_path, 'fr/large/')
    OR (starts_with(file_path, 'fr/small/') AND regexp_full_match(name, 'doc_.\\..*')) OR (starts_with(file_path, 'es/small/') AND starts_with(name, 'doc_') AND NOT regexp_full_match(name, 'doc_.[05]\\.py'))
    OR starts_with(file_path, 'it/') AS ignored FROM n""")
def pf9_ignore_rules(spark, sf):
    """Every project has the same lists, in several folders, with rules that take files back."""
    lists = spark.createDataFrame(list(LISTS), "folder string, content string")
    paths = A.files(spark, sf).where("file_path IS NOT NULL").select("project_id", "file_path")
    projects = A.projects(spark, sf).select(F.col("id").alias("project_id"), F.explode(F.array(*(F.lit(k) for k in range(len(LISTS))))).alias("k"))
    numbered = lists.select("folder", "content", F.element_at(F.create_map(*(x for k, (f, _) in enumerate(LISTS) for x in (F.lit(f), F.lit(k)))), F.col("folder")).alias("k"))
    return I.ignored(paths, I.parse_lists(projects.join(numbered, "k")))
