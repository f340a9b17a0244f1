"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents start as one group. Each round splits every open group by the next run of bytes of its documents; a group
that shrank to one document, or whose documents ended within the run, is closed. Documents of a closed group that
ended are equal byte for byte, so no digest decides anything. The run widens with each round: the first one, over a
few bytes, already closes nearly all documents, and only the texts of still open groups are carried on.

Every round is one pre-aggregated count by (group, run) and one join with it. The count has a row per group and task
however many copies a group holds, and the join is one that adaptive execution splits where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch, lower_ascii, row_of, sql_lower_ascii


def radix_groups(docs: DataFrame, first: int = 64, growth: int = 8, widest: int = 1 << 20, carry: bool = False) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the largest doc_id is kept. A null text counts
    as empty, all empty texts are one group, and a null doc_id is smaller than any other. Of rows repeated with the
    same doc_id one is kept. An empty table gives an empty result; other columns are ignored, whatever their names.
    ``first``, ``growth`` and ``widest`` set the bytes that a round looks at; they change the work, not the result.
    ``carry`` gives ``doc``, a struct of the row's own columns, in place of the digest. ``docs`` has to read the same rows in the same order
    each time, as a scan of files does.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    text = F.coalesce(F.col("text"), F.lit(""))
    # what is carried on: the whole row, or the normalised text alone
    body = F.encode(lower_ascii(F.coalesce(F.col("doc.text"), F.lit(""))), "UTF-8") if carry else F.col("body")
    kept_columns = ["doc"] if carry else ["text_sha256"]
    own = [row_of(docs)] if carry else [F.encode(lower_ascii(text), "UTF-8").alias("body"), F.sha2(lower_ascii(text), 256).alias("text_sha256")]
    on = ["doc"] if carry else ["body", "text_sha256"]
    # A run of n bytes lies within the first n characters: counting needn't normalise whole texts.
    head = F.substring(F.encode(lower_ascii(F.substring(text, 1, first)), "UTF-8"), 1, first)
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("group"), head.alias("run"), *own)
    counted, carried = source.select("doc_id", "row", "group", "run"), source
    width, at, levels = first, first, []
    while True:
        sums = counted.groupBy("group", "run").agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"), F.min("row").alias("next")
        )
        # stored, so that the join below shuffles both its sides and can be split where a group is hot
        groups = scratch.store(sums.where("n > 1"))
        done = F.col("n").isNull() | (F.octet_length("run") < width)
        level = scratch.store(
            carried.join(groups.hint("merge"), ["group", "run"], "left").select(
                "doc_id", "row", F.coalesce("best", F.struct("doc_id", "row")).alias("keep"),
                F.coalesce("n", F.lit(1).cast("long")).alias("size"), done.alias("done"),
                F.when(~done, F.col("next")).alias("group"),
                *(["doc"] if carry else ["text_sha256", F.when(~done, F.col("body")).alias("body")]),
            )
        )
        levels.append(level)
        still = level.where("not done")
        if still.isEmpty():
            break
        width = min(width * growth, widest)
        run = F.substring(body, at + 1, width)
        at += width
        counted = still.select("doc_id", "row", "group", run.alias("run"))
        carried = still.select("doc_id", "row", "group", run.alias("run"), *on)
    scratch.keep(*levels)
    found = levels[0].where("done")
    for level in levels[1:]:
        found = found.union(level.where("done"))
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        *kept_columns,
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each set of equal texts (see ``radix_groups``)."""
    return radix_groups(docs, carry=True).where("kept").select("doc.*")


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {sql_lower_ascii("coalesce(text, '')")} AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
