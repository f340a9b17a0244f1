"""The catalogue: look-ups, merges, soft deletes and retention, each a function of DataFrames.

A write returns the table as it is afterwards; where its caller stores it is the caller's choice. Deletes cascade as the
schema intends. Times are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION_MONTH = 30 * 86_400


def active(files: DataFrame) -> DataFrame:
    return files.where(F.col("to_be_cleaned").isNull())


def find_file(files: DataFrame, project_id: str, path: str) -> DataFrame:
    return active(files).where((F.col("project_id") == project_id) & (F.col("file_path") == path))


def project_files(files: DataFrame, project_id: str) -> DataFrame:
    return active(files).where(F.col("project_id") == project_id).orderBy("file_path")


def find_project(projects: DataFrame, ident: str) -> DataFrame:
    """By id where it has the shape of one (36 characters with a dash), else by name whatever its case."""
    if len(ident) == 36 and "-" in ident:
        return projects.where(F.col("id") == ident)
    return projects.where(F.lower("name") == ident.lower())


def project_map(projects: DataFrame, files: DataFrame, overviews: DataFrame, ident: str) -> DataFrame:
    """A row per active file of the project, with its name and overview; one row without a file if it has none."""
    own = find_project(projects, ident).select(F.col("id").alias("project_id"), "name")
    return own.join(overviews, "project_id", "left").join(active(files), "project_id", "left").orderBy("file_path")


def in_batches(files: DataFrame, size: int) -> DataFrame:
    """files (file_path) with batch: about ``size`` files each, dealt by a hash, so that nothing is sorted or numbered in one task."""
    n = max(1, -(-files.count() // size))
    return files.withColumn("batch", F.pmod(F.xxhash64("file_path"), F.lit(n)).cast("int"))


def index_meta_defaults(meta: DataFrame, now: Column) -> DataFrame:
    """Index meta with what a missing value means."""
    return meta.select(
        "project_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_chunks", "indexed_chunks", "total_files", "indexed_files", "queue_depth")),
        F.coalesce("sync_status", F.lit("pending")).alias("sync_status"), F.coalesce("created", now).alias("created"), F.coalesce("last_modified", now).alias("last_modified"),
    )


def upsert(table: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those with the same keys; of equal keys in ``new`` the last by
    ``order`` counts. All columns are overwritten, a soft delete among them.

    One aggregate of ``new`` and an anti join: the stored table isn't sorted, and its side can be read bucketed."""
    columns = [c for c in table.columns]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order) if order else F.lit(1)).alias("row")).select("row.*")
    return table.join(last.select(*keys), keys, "left_anti").select(*columns).unionByName(last.select(*columns))


def get_or_create_projects(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: name, folder. Projects with the folder among their aliases; names that are new become projects."""
    folders = wanted.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("new_name"), F.array_sort(F.collect_set("folder")).alias("folders"))
    joined = projects.withColumn("key", F.lower("name")).join(folders, "key", "full")
    none = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("id", F.sha2("key", 256)).alias("id"), F.coalesce("name", "new_name").alias("name"),
        F.array_union(F.coalesce("aliases", none), F.coalesce("folders", none)).alias("aliases"), F.coalesce("vector_mode", F.lit(False)).alias("vector_mode"),
    )


def set_vector_mode(projects: DataFrame, project_id: str, on: bool) -> DataFrame:
    if projects.where(F.col("id") == project_id).isEmpty():
        raise KeyError(project_id)
    return projects.withColumn("vector_mode", F.when(F.col("id") == project_id, F.lit(on)).otherwise(F.col("vector_mode")))


def soft_delete(files: DataFrame, marked: DataFrame, now: int) -> DataFrame:
    """marked: project_id, file_path. Only active files are marked."""
    hits = marked.select("project_id", "file_path").distinct().withColumn("hit", F.lit(True))
    joined = files.join(hits, ["project_id", "file_path"], "left")
    return joined.withColumn("to_be_cleaned", F.when(F.col("hit") & F.col("to_be_cleaned").isNull(), F.lit(now)).otherwise(F.col("to_be_cleaned"))).select(*files.columns)


def restore(files: DataFrame, back: DataFrame) -> DataFrame:
    hits = back.select("project_id", "file_path").distinct().withColumn("hit", F.lit(True))
    joined = files.join(hits, ["project_id", "file_path"], "left")
    return joined.withColumn("to_be_cleaned", F.when(F.col("hit"), F.lit(None)).otherwise(F.col("to_be_cleaned"))).select(*files.columns)


def expired(now: int, months: int) -> Column:
    """Marked longer ago than the retention: strictly before the cut-off."""
    return F.coalesce(F.col("to_be_cleaned") < now - months * RETENTION_MONTH, F.lit(False))


def purge(files: DataFrame, now: int, months: int = 6, project_id: str | None = None) -> DataFrame:
    gone = expired(now, months)
    if project_id is not None:
        gone = gone & (F.col("project_id") == project_id)
    return files.where(~gone)


def cleanup_stats(files: DataFrame, now: int, months: int = 6) -> DataFrame:
    """In one pass: active, marked and eligible files, per project and in all (project_id null)."""
    sums = [F.count(F.when(F.col("to_be_cleaned").isNull(), 1)).alias("active"), F.count("to_be_cleaned").alias("marked"), F.count(F.when(expired(now, months), 1)).alias("eligible")]
    return files.rollup("project_id").agg(*sums)


def empty_projects(projects: DataFrame, files: DataFrame, overviews: DataFrame) -> DataFrame:
    """Projects without a file, active or not, and without an overview."""
    key = lambda df: df.select(F.col("project_id").alias("id"))
    return projects.join(key(files), "id", "left_anti").join(key(overviews), "id", "left_anti")


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Active files that the listing (project_id, file_path) lacks."""
    return active(files).join(listing, ["project_id", "file_path"], "left_anti")


def undescribed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files without an active description."""
    return listing.join(active(files), ["project_id", "file_path"], "left_anti")


def missing_summary(listing: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Per project: listed files in all, those with an active description, those without, and how many of these a call
    with a limit returns."""
    known = active(files).select("project_id", "file_path").distinct().withColumn("known", F.lit(True))
    missing = F.count(F.when(F.col("known").isNull(), 1))
    returned = missing if limit is None else F.least(missing, F.lit(limit))
    return listing.join(known, ["project_id", "file_path"], "left").groupBy("project_id").agg(
        F.count("*").alias("total"), F.count("known").alias("existing"), missing.alias("missing"), returned.cast("long").alias("returned")
    )


def changed_files(current: DataFrame, stored: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """current, stored: file_path, mtime. Files whose time differs, or that aren't stored."""
    s = stored.select("file_path", F.col("mtime").alias("stored_mtime"))
    return current.join(s, "file_path", "left").where(F.abs(F.col("mtime") - F.coalesce("stored_mtime", F.lit(0.0))) > tolerance)


def move_project(files: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """(what goes along, what stays): active files go, soft-deleted ones are dropped."""
    own = F.col("project_id") == project_id
    return active(files).where(own), files.where(~own)


def latest(table: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return table.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def match_projects(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request, name, folder. 2 points for the name, 1 for the folder among the aliases; a match needs 2.

    As a match needs the name, it is an equality join on it: nothing is compared with everything."""
    keyed = requests.withColumn("key", F.lower("name")).select("request", "folder", "key")
    joined = projects.withColumn("key", F.lower("name")).join(keyed, "key")
    scored = joined.withColumn("score", 2 + F.when(F.array_contains("aliases", F.col("folder")), 1).otherwise(0))
    return latest(scored, ["request"], F.col("score").desc(), F.col("id")).select("request", "id", "score")


def file_similarity(files: DataFrame, current: DataFrame) -> DataFrame:
    """Share of the distinct names in a folder now (current: folder, name) that a project has, for projects with any."""
    named = active(files).select("project_id", F.element_at(F.split("file_path", "/"), -1).alias("name")).distinct()
    now = current.distinct()
    total = now.groupBy("folder").agg(F.count("*").alias("total"))
    shared = now.join(named, "name").groupBy("folder", "project_id").agg(F.count("*").alias("shared"))
    return shared.join(total, "folder").select("folder", "project_id", "shared", "total", (F.col("shared") / F.col("total")).alias("similarity"), (F.col("shared") / F.col("total") >= 0.8).alias("similar"))


def monitor_changes(desired: DataFrame, monitored: DataFrame) -> DataFrame:
    """id, action: projects to add and to remove."""
    add = desired.select("id").join(monitored, "id", "left_anti").select("id", F.lit("add").alias("action"))
    return add.unionByName(monitored.select("id").join(desired, "id", "left_anti").select("id", F.lit("remove").alias("action")))


def index_rollup(chunks: DataFrame) -> DataFrame:
    """Per project: chunks, embedded chunks, files, files with an embedded chunk."""
    return chunks.groupBy("project_id").agg(
        F.count("*").alias("total_chunks"), F.count("embedding_id").alias("indexed_chunks"), F.countDistinct("file_id").alias("total_files"),
        F.countDistinct(F.when(F.col("embedding_id").isNotNull(), F.col("file_id"))).alias("indexed_files"),
    )


def put_cache(cache: DataFrame, key: Column, tokens: Column, rows: DataFrame, now: int, ttl: int = 86_400) -> DataFrame:
    """Token counts by key, with the time they expire."""
    fresh = rows.select(key.alias("cache_key"), tokens.alias("token_count"), F.lit(now).cast("long").alias("created"), F.lit(now + ttl).cast("long").alias("expires"))
    return upsert(cache, fresh, ["cache_key"], "token_count")


def live_cache(cache: DataFrame, now: int) -> DataFrame:
    return cache.where(F.col("expires").isNull() | (F.col("expires") > now))


def insert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new``; a key that is there already, or twice in ``new``, is an error."""
    taken = new.join(table.select(*keys), keys, "left_semi").select(*keys)
    twice = new.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    if clash := taken.union(twice).first():
        raise KeyError(tuple(clash))
    return table.unionByName(new)


def update(table: DataFrame, changes: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows with the columns of ``changes`` that aren't null there; keys that the table lacks are left out, or an error."""
    if strict and (lost := changes.join(table.select(key), key, "left_anti").first()):
        raise KeyError(lost[key])
    named = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    joined = table.join(named, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in table.columns))


def apply_updates(files: DataFrame, overviews: DataFrame, updates: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """updates: project_id, descriptions (path to text), overview (or null). Files and overviews afterwards; an overview
    counts its words, and the files that the update named."""
    rows = updates.select("project_id", F.explode("descriptions").alias("file_path", "description"))
    fresh = rows.select(
        F.xxhash64("project_id", "file_path").alias("id"), "project_id", "file_path", "description", F.sha2("description", 256).alias("file_hash"),
        F.lit(1).cast("long").alias("version"), F.lit(None).cast("long").alias("to_be_cleaned"), F.lit(now).cast("long").alias("last_modified"),
    ).select(*files.columns)
    words = F.filter(F.split(F.col("overview"), r"\s+"), lambda w: w != "")
    told = updates.where("overview IS NOT NULL").select("project_id", "overview", F.size(words).cast("long").alias("total_tokens"), F.size("descriptions").cast("long").alias("total_files"))
    return upsert(files, fresh, ["project_id", "file_path"]), upsert(overviews, told.select(*overviews.columns), ["project_id"])


def recommendation(tokens: int, overview: int, limit: int, overview_limit: int = 32_000) -> str:
    """How a project is best read, by the tokens of all its texts and of its overview."""
    if tokens <= limit:
        return "use_overview"
    return "view_overview_then_search" if 0 < overview <= overview_limit else "use_search"


def cleanup_due(last_run: int | None, now: int, cooldown: int = 1800) -> bool:
    """Clean-ups run one at a time, and not again within the cool-down."""
    return last_run is None or now - last_run >= cooldown


def shuffled(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, the same ones for the same seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in rows.columns), F.lit(str(seed))))).limit(n)


def consolidate(versions: DataFrame, projects: DataFrame) -> DataFrame:
    """One row for each project and path: the last version, of projects that exist; a source project that doesn't is null."""
    known = projects.select(F.col("id").alias("project_id"))
    last = latest(versions.join(known, "project_id", "left_semi"), ["project_id", "file_path"], F.col("last_modified").desc(), F.col("id").desc())
    sources = projects.select(F.col("id").alias("source_project_id"), F.lit(True).alias("_known"))
    joined = last.join(sources, "source_project_id", "left")
    return joined.withColumn("source_project_id", F.when(F.col("_known"), F.col("source_project_id"))).drop("_known")
