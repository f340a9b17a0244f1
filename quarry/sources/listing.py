"""Sources of files and their settings, and sinks for reports."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from fnmatch import translate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.folders import read_files, walk_files


@dataclass(frozen=True)
class Settings:
    """What an index run goes by. ``load`` reads 'name: value' lines, over which the environment wins."""

    similarity_threshold: float = 0.5
    max_search_results: int = 20
    batch_size: int = 128
    max_chunk_size: int = 1500
    token_limit: int = 32_000

    @classmethod
    def load(cls, text: str, environment: dict[str, str], prefix: str = "QUARRY_") -> Settings:
        given = dict(line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
        values = {k.strip(): v.strip() for k, v in given.items()} | {k.removeprefix(prefix).lower(): v for k, v in environment.items() if k.startswith(prefix)}
        return cls(**{f.name: type(f.default)(values[f.name]) for f in fields(cls) if f.name in values})


def _either(pattern: str) -> list[str]:
    """A pattern with {a,b} as patterns without."""
    if braces := re.search(r"\{([^{}]*)\}", pattern):
        return [p for part in braces[1].split(",") for p in _either(pattern[: braces.start()] + part + pattern[braces.end() :])]
    return [pattern]


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file_path (relative), size, modified: all files below a folder, listed in tasks, contents unread. The pattern is one of
    names, with * ? [a-z] [^a] {a,b}."""
    found = walk_files(spark, folder)
    if pattern == "*":
        return found
    forms = "|".join(translate(p.replace("[^", "[!")).removesuffix(r"\Z").removesuffix(r"\z") for p in _either(pattern))
    return found.where(F.substring_index("file_path", "/", -1).rlike(rf"^(?:{forms})\z"))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file_path, content: whole files as text; bytes that aren't UTF-8 become replacement marks, blank files go."""
    found = read_files(list_files(spark, folder, pattern), folder)
    return found.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(F.trim("content") != "")


def file_hash(length, content, modified):
    """Of small files the content's sha256, of those of a MiB and more that of size and time; "deleted" for files that are
    gone (no time), "error" for small ones whose content can't be read."""
    whole = F.when(length < 1_048_576, F.coalesce(F.sha2(content, 256), F.lit("error"))).otherwise(F.sha2(F.concat_ws(":", length.cast("string"), modified.cast("string")), 256))
    return F.when(modified.isNull(), "deleted").otherwise(whole)


def write_report(rows: DataFrame, column: str, path: str) -> None:
    """A report's lines into one local file, row by row."""
    with Path(path).open("w", encoding="utf-8") as out:
        for r in rows.toLocalIterator():
            out.write(f"{r[column]}\n")
