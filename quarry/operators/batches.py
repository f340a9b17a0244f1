"""Batches and commits: packing files into requests, cutting diffs, merging answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.catalog import active
from quarry.operators.folds import fold, placed


def pack_files(files: DataFrame, most_tokens: int = 120_000, most_texts: int = 1000) -> DataFrame:
    """files: project_id, file_path, tokens, texts. With ``batch``: files in path order, whole, in the open batch while
    they fit; a file that fits nowhere is a batch of its own.

    Each next batch depends on the one before, so it is a fold in each project."""

    def step(open_batch: dict, f: dict) -> tuple[int]:
        if open_batch["texts"] and (open_batch["tokens"] + f["tokens"] > most_tokens or open_batch["texts"] + f["texts"] > most_texts):
            open_batch.update(batch=open_batch["batch"] + 1, tokens=0, texts=0)
        open_batch["tokens"] += f["tokens"]
        open_batch["texts"] += f["texts"]
        return (open_batch["batch"],)

    packed = fold(files.select("project_id", "file_path", "tokens", "texts"), ["project_id"], ["file_path"], lambda: {"batch": 0, "tokens": 0, "texts": 0}, step, "batch int")
    return packed.select("project_id", "file_path", "batch")


def fixed_batches(rows: DataFrame, keys: list[str], size: int, *order: str) -> DataFrame:
    return placed(rows, keys, list(order)).withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place", "n")


def batch_totals(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows: keys, batch, failed, and a column of sizes. Per key: batches, files, chars, and the files of batches in which
    any failed."""
    sums = rows.groupBy(*keys, "batch").agg(F.count("*").alias("files"), F.sum(size).alias("chars"), F.bool_or("failed").alias("failed"))
    lost = F.coalesce(F.sum(F.when(F.col("failed"), F.col("files"))), F.lit(0))
    return sums.groupBy(*keys).agg(F.count("*").alias("batches"), F.sum("files").alias("files"), F.sum("chars").alias("chars"), lost.alias("failed_files"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """commit, line_no, line, section: lines of diffs, sections counted from 1; 0 before the first."""
    lines = diffs.select("commit", F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    head = F.startswith("line", F.lit("diff --git")).cast("int")
    order = Window.partitionBy("commit").orderBy("line_no")  # the lines of one commit
    return lines.withColumn("section", F.sum(head).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def changed_files(diffs: DataFrame) -> DataFrame:
    """commit, section, file_path: the third word of each section's head, without a/. Paths with blanks are cut."""
    heads = diff_lines(diffs).where(F.startswith("line", F.lit("diff --git")))
    return heads.select("commit", "section", F.regexp_replace(F.element_at(F.split("line", " "), 3), "^a/", "").alias("file_path"))


def all_sections(diffs: DataFrame) -> DataFrame:
    """commit, section, text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"])
    return diff_lines(diffs).where("section > 0").groupBy("commit", "section").agg(F.array_join(ordered, "\n").alias("text"))


def sections_of(diffs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: commit, file_path. commit, section, text: the sections of those files."""
    kept = changed_files(diffs).join(wanted, ["commit", "file_path"], "left_semi").select("commit", "section")
    lines = diff_lines(diffs).join(kept, ["commit", "section"], "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"])
    return lines.groupBy("commit", "section").agg(F.array_join(ordered, "\n").alias("text"))


def stage(single: Column, overview: Column, files: Column, limit: int = 130_000) -> Column:
    """How a commit is described, by the tokens of prompts: in one, if it fits; in two, of the overview and of the files, if
    both fit; else in parts."""
    return F.when(single <= limit, "single").when((overview <= limit) & (files <= limit), "two_stage").otherwise("chunked")


def current_descriptions(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """commit, file_path, description: what is known of the files that a commit changes."""
    known = active(files).select("project_id", "file_path", "description")
    return changed_files(diffs).select(F.col("commit").alias("project_id"), "file_path").distinct().join(known, ["project_id", "file_path"]).withColumnRenamed("project_id", "commit")


def merge_answers(answers: DataFrame) -> DataFrame:
    """answers: position, updates (path to description). Of each path the last description."""
    rows = answers.select("position", F.explode("updates").alias("file_path", "description"))
    return rows.groupBy("file_path").agg(F.max_by("description", "position").alias("description"))


def prompts(conversations: DataFrame, limit: int = 180_000) -> DataFrame:
    """conv_id, turns, tokens, fits: what a conversation takes as one prompt, by the fall-back estimate."""
    line = F.concat("role", F.lit(": "), "text")
    tokens = F.sum(F.floor(F.char_length(line) / 4))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), tokens.alias("tokens"), (tokens <= limit).alias("fits"))


def repair_json(text: Column) -> Column:
    """Steps by which nearly valid JSON objects become valid: bare URLs and paths, bare keys, trailing commas, bare values."""
    text = F.regexp_replace(text, r":\s*((?:https?://|/)[^\s,}\"]+)", r': "$1"')
    text = F.regexp_replace(text, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", r'$1"$2":')
    text = F.regexp_replace(text, r",\s*([}\]])", "$1")
    return F.regexp_replace(text, r":\s*(?!true\b|false\b|null\b)([A-Za-z_][A-Za-z0-9_./-]*)\s*([,}])", r': "$1"$2')


def parse_json(text: Column) -> Column:
    """The object as a map of strings, as it is or repaired; null for anything else."""
    kind = "map<string,string>"
    return F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\{"), text), kind), F.from_json(F.when(text.rlike(r"^\s*\{"), repair_json(text)), kind))


def first_object(text: str) -> dict | None:
    """The first balanced {...} of a text that is a JSON object. Braces in strings count, as they do for a plain scan. One
    pass pairs all braces."""
    ends, open_at = {}, []
    for m in re.finditer("[{}]", text):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            ends[open_at.pop()] = m.end()
    for start in sorted(ends):
        try:
            value = json.loads(text[start : ends[start]])
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def extract_objects(answers: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """answers: id, text. id, object (JSON), ok: the object found in noisy text, and whether it has the required keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_object(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if f is None else json.dumps(f, sort_keys=True) for f in found], pa.string()), pa.array([f is not None and all(k in f for k in required) for f in found])], names=["id", "object", "ok"])

    return answers.select(F.col("id").cast("long"), "text").mapInArrow(work, "id long, object string, ok boolean")


def within_budget(files: DataFrame, limit: int) -> DataFrame:
    """files: project_id, position, tokens. The files that fit into a prompt: all of a project's, or the first half of
    them, or the first half of those, until their tokens are within the limit."""
    summed = placed(files, ["project_id"], ["position"], "tokens")
    # places that a halving can end at: n, n // 2, n // 4, ...
    half = F.floor(F.log2(F.col("n").cast("double") / F.col("place")))
    ends = F.exists(F.sequence(F.lit(0), F.greatest(half, F.lit(0)).cast("int") + 1), lambda k: F.floor(F.col("n") / F.pow(F.lit(2.0), k)) == F.col("place"))
    kept = summed.where(ends & (F.col("upto_tokens") <= limit)).groupBy("project_id").agg(F.max("place").alias("kept"))
    return summed.join(kept, "project_id").where("place <= kept").select("project_id", "position", "tokens")


def chunk_prompts(sections: DataFrame, size: int, limit: int = 100_000, overhead: int = 500) -> DataFrame:
    """sections: commit, section, text. commit, batch, files, tokens, skipped: the prompts of commits that are described in
    parts, of ``size`` sections each. One that is still over the limit is skipped, and its files get no update."""
    parts = sections.select("commit", F.floor((F.col("section") - 1) / size).alias("batch"), F.floor(F.char_length("text") / 4).alias("tokens"))
    sums = parts.groupBy("commit", "batch").agg(F.count("*").alias("files"), (F.sum("tokens") + overhead).alias("tokens"))
    return sums.withColumn("skipped", F.col("tokens") > limit)


def ask_prompt(overviews: DataFrame, question: str, limit: int = 180_000) -> DataFrame:
    """project_id, prompt, tokens, fits: a question with its project's overview before it."""
    prompt = F.concat(F.lit("Overview:\n"), F.coalesce("overview", F.lit("")), F.lit("\n\nQuestion: "), F.lit(question))
    tokens = F.floor(F.char_length(prompt) / 4)
    return overviews.select("project_id", prompt.alias("prompt"), tokens.alias("tokens"), (tokens <= limit).alias("fits"))
