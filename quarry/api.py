"""The catalogue as an engine: tables in a folder, and thirteen tools that read and write them.

Each table is a Parquet folder. A write makes the next version of a table and then points to it, so that readers see
either the old or the new one. Rows of a table with a key can be put one by one: they go to small folders beside the
version, the last row of a key counts, and once there are many they are merged into the next version. The search index is
such a table: a change folds the changed files alone. One engine writes at a time.
"""

from __future__ import annotations

import html
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import token_estimate
from quarry.operators import catalog as C
from quarry.operators import metrics as M
from quarry.operators import search as S
from quarry.operators import tree as T
from quarry.operators import vectors as V
from quarry.operators.chunking import Handler, chunk_files
from quarry.operators.syntax import HANDLERS
from quarry.schemas import KEYS, SCHEMAS
from quarry.sources.folders import walk_files


def unescaped(value: Any) -> Any:
    """A call's arguments with HTML entities decoded in every text, however deep it lies in lists and maps."""
    if isinstance(value, str):
        return html.unescape(value)
    if isinstance(value, dict):
        return {k: unescaped(v) for k, v in value.items()}
    return [unescaped(v) for v in value] if isinstance(value, list) else value


class ToolError(ValueError):
    """A call with an unknown tool, or with arguments that are missing or not known."""


class Engine:
    """``tokens`` counts a text's tokens as a column, ``embed`` adds ``vector`` to chunks, ``stop_words`` is a file of words that
    frequencies leave out, and ``handlers`` cut files by their endings, by syntax if none are given; each has a local
    stand-in."""

    def __init__(
        self, spark: SparkSession, folder: str, token_limit: int = 32_000, clock: Callable[[], float] = time.time, tokens: Callable[[Column], Column] = token_estimate,
        embed: Callable[[DataFrame], DataFrame] = V.embed, stop_words: str | None = None, handlers: dict[str, Handler] | None = None, most_parts: int = 16,
        batch_files: int = 50, in_flight: int = 5,
    ):
        self.spark, self.folder, self.token_limit, self.clock = spark, folder.rstrip("/"), token_limit, clock
        self.tokens, self.embed, self.handlers, self.most_parts = tokens, embed, HANDLERS if handlers is None else handlers, most_parts
        self.batch_files, self.in_flight = batch_files, in_flight
        self.stop_words = S.stop_words_file(spark, stop_words) if stop_words else S.STOP_WORDS
        self.cleaned_at: int | None = None
        self.tools: dict[str, tuple[Callable[..., Any], tuple[str, ...], tuple[str, ...]]] = {
            "get_file_description": (self.get_file_description, ("projectName", "folderPath", "filePath"), ()),
            "update_file_description": (self.update_file_description, ("projectName", "folderPath", "filePath", "description"), ("fileHash",)),
            "check_codebase_size": (self.check_codebase_size, ("projectName", "folderPath"), ("tokenLimit",)),
            "find_missing_descriptions": (self.find_missing_descriptions, ("projectName", "folderPath"), ("limit", "listing")),
            "search_descriptions": (self.search_descriptions, ("projectName", "folderPath", "query"), ("maxResults",)),
            "get_all_descriptions": (self.get_all_descriptions, ("projectName", "folderPath"), ()),
            "get_codebase_overview": (self.get_codebase_overview, ("projectName", "folderPath"), ()),
            "update_codebase_overview": (self.update_codebase_overview, ("projectName", "folderPath", "overview"), ()),
            "get_word_frequency": (self.get_word_frequency, ("projectName", "folderPath"), ("limit",)),
            "search_codebase_overview": (self.search_codebase_overview, ("projectName", "folderPath", "searchWord"), ()),
            "check_database_health": (self.check_database_health, (), ()),
            "enabled_vector_mode": (self.enabled_vector_mode, ("projectName", "folderPath", "enabled"), ()),
            "find_similar_code": (self.find_similar_code, ("projectName", "folderPath"), ("code_snippet", "file_path", "line_start", "line_end", "similarity_threshold", "max_results")),
        }

    # tables

    def table(self, name: str) -> DataFrame:
        path = self._path(name)
        if not path:
            return self.spark.createDataFrame([], SCHEMAS[name])
        whole = self.spark.read.schema(SCHEMAS[name]).parquet(path)
        parts = self._parts(name)
        if not parts:
            return whole
        numbered = [self.spark.read.schema(SCHEMAS[name]).parquet(p).withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        return C.upsert(whole, reduce(DataFrame.unionByName, numbered), KEYS[name], "_part")

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows of a table with a key, in place of those with the same keys, without writing the others again."""
        if not self._path(name):
            self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))
        fs, root = self._fs(name)
        version, part = self._path(name).rsplit("/", 1)[1], f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self.table(name).schema]).write.parquet(f"{root}/{version}-parts/{part}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.create(path(f"{root}/{version}-parts/_seen/{part}")).close()  # readers see a part once it is whole
        if len(self._parts(name)) >= self.most_parts:
            self.write(name, self.table(name))

    def _parts(self, name: str) -> list[str]:
        fs, _ = self._fs(name)
        base = f"{self._path(name)}-parts"
        seen = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_seen")
        return [f"{base}/{n}" for n in sorted(s.getPath().getName() for s in fs.listStatus(seen))] if fs.exists(seen) else []

    def write(self, name: str, rows: DataFrame) -> None:
        fs, root = self._fs(name)
        version = uuid.uuid4().hex
        rows.select(*[f.name for f in self.table(name).schema]).write.parquet(f"{root}/{version}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(path(f"{root}/_current"))
        old = [s.getPath() for s in fs.listStatus(path(f"{root}/_current"))]
        fs.create(path(f"{root}/_current/{time.time_ns():020d}-{version}")).close()
        for p in old[:-1]:  # what came before the last version; its readers have had their time
            for end in ("", "-parts"):
                fs.delete(path(f"{root}/{p.getName().split('-')[1]}{end}"), True)
            fs.delete(p, True)

    def _fs(self, name: str):
        root = f"{self.folder}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _path(self, name: str) -> str | None:
        fs, root = self._fs(name)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
        versions = sorted(s.getPath().getName() for s in fs.listStatus(mark)) if fs.exists(mark) else []
        return f"{root}/{versions[-1].split('-')[1]}" if versions else None

    # calls

    def call(self, tool: str, **arguments: Any) -> Any:
        if tool not in self.tools:
            raise ToolError(f"unknown tool: {tool}")
        run, needed, known = self.tools[tool]
        if missing := [a for a in needed if a not in arguments]:
            raise ToolError(f"missing arguments: {', '.join(missing)}")
        if extra := [a for a in arguments if a not in (*needed, *known)]:
            raise ToolError(f"unexpected arguments: {', '.join(extra)}")
        return run(**unescaped(arguments))

    def _project(self, name: str, folder: str) -> str:
        """The id of the project of that name; it is made where there is none, and learns the folder."""
        wanted = self.spark.createDataFrame([(1, name, folder)], "request long, name string, folder string")
        projects = self.table("projects")
        found = C.match_projects(projects, wanted).first()
        if found and not projects.where((F.col("id") == found["id"]) & F.array_contains("aliases", folder)).isEmpty():
            return found["id"]
        self.write("projects", C.get_or_create_projects(projects, wanted))
        return C.match_projects(self.table("projects"), wanted).first()["id"]

    def get_file_description(self, projectName: str, folderPath: str, filePath: str) -> dict:
        row = C.find_file(self.table("files"), self._project(projectName, folderPath), filePath).first()
        if row is None:
            return {"exists": False, "message": f"No description for {filePath}"}
        return {"exists": True, "description": row["description"], "lastModified": row["last_modified"], "fileHash": row["file_hash"], "version": row["version"]}

    def update_file_description(self, projectName: str, folderPath: str, filePath: str, description: str, fileHash: str | None = None) -> dict:
        project, now = self._project(projectName, folderPath), int(self.clock())
        values = self.spark.createDataFrame([(project, filePath, description, fileHash, now)], "project_id string, file_path string, description string, file_hash string, last_modified long")
        row = values.select(F.xxhash64("project_id", "file_path").alias("id"), "*", F.lit(1).cast("long").alias("version"), F.lit(None).cast("long").alias("to_be_cleaned"))
        self._put_files(row)
        return {"success": True, "filePath": filePath, "lastModified": now}

    def _put_files(self, rows: DataFrame) -> None:
        self.put("files", rows)
        self.put("search", S.indexed(rows))

    def _own_files(self, project: str) -> DataFrame:
        return C.active(self.table("files")).where(F.col("project_id") == project)

    def _tokens(self, files: DataFrame) -> int:
        line = F.concat("file_path", F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\n"))
        return files.agg(F.coalesce(F.sum(self.tokens(line)), F.lit(0))).first()[0]

    def _clean_up(self, project: str, folder: str) -> int:
        """Marks files that are gone from the folder, and drops those marked longer ago than the retention; not again within
        the cool-down. How many were marked or dropped."""
        now = int(self.clock())
        if not C.cleanup_due(self.cleaned_at, now):
            return 0
        self.cleaned_at = now
        marked = 0
        if (listing := self._listing(project, folder)) is not None:
            gone = C.missing_files(self.table("files").where(F.col("project_id") == project), listing)
            if marked := gone.count():
                self._put_files(gone.withColumn("to_be_cleaned", F.lit(now).cast("long")))
        files = self.table("files")
        old = files.where(C.expired(now, 6) & (F.col("project_id") == project)).count()
        if old:
            kept = C.purge(files, now, project_id=project)
            self.write("search", self.table("search").join(kept.select("project_id", "file_path"), ["project_id", "file_path"], "left_semi"))
            self.write("files", kept)
        return marked + old

    def _listing(self, project: str, folder: str) -> DataFrame | None:
        """project_id, file_path of what the folder holds and isn't ignored; nothing if there is no such folder. Ignored
        folders aren't entered."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        pruned = tuple(p for p in T.IGNORED_PATTERNS if p.endswith("/") and "/" not in p[:-1])
        found = walk_files(self.spark, folder, pruned).where(~T.is_ignored(F.col("file_path")))
        return found.select(F.lit(project).alias("project_id"), "file_path")

    def check_codebase_size(self, projectName: str, folderPath: str, tokenLimit: int | None = None) -> dict:
        project, limit = self._project(projectName, folderPath), tokenLimit or self.token_limit
        cleaned = self._clean_up(project, folderPath)
        files = self._own_files(project)
        told, n = self._tokens(files), files.count()
        overview = self.table("overviews").where(F.col("project_id") == project).select(self.tokens(F.col("overview")).alias("n")).first()
        own = (overview["n"] or 0) if overview else 0
        say = C.recommendation(told + own, own, limit)
        return {"fileDescriptionTokens": told, "overviewTokens": own, "totalTokens": told + own, "isLarge": told + own > limit, "recommendation": say, "tokenLimit": limit, "totalFiles": n, "cleanedUpCount": cleaned}

    def find_missing_descriptions(self, projectName: str, folderPath: str, limit: Any = None, listing: list[str] | None = None) -> dict:
        """``listing`` names the files; without it the folder is listed by Spark, contents unread."""
        project = self._project(projectName, folderPath)
        empty = self.spark.createDataFrame([], "project_id string, file_path string")
        if listing is None:
            rows = self._listing(project, folderPath)
        else:
            rows = self.spark.createDataFrame([(project, p) for p in listing], empty.schema).where(~T.is_ignored(F.col("file_path")))
        rows = empty if rows is None else rows
        most = limit if isinstance(limit, int) and limit > 0 else None
        missing = C.undescribed(rows, self.table("files")).orderBy("file_path")
        names = [r["file_path"] for r in (missing.limit(most) if most else missing).collect()]
        sums = C.missing_summary(rows, self.table("files"), most).first()
        total, known, n = (sums["total"], sums["existing"], sums["missing"]) if sums else (0, 0, 0)
        return {"missingFiles": names, "totalMissing": n, "returnedCount": len(names), "existingDescriptions": known, "totalTrackable": total}

    def search_descriptions(self, projectName: str, folderPath: str, query: str, maxResults: int = 20) -> dict:
        found = S.search_index(self.table("search"), query, self._project(projectName, folderPath), maxResults)
        text = self.table("files").select("id", "description")
        rows = found.join(text, "id").orderBy("score", "id").collect()
        return {"results": [{"filePath": r["file_path"], "description": r["description"], "relevanceScore": r["score"]} for r in rows], "totalResults": len(rows), "query": query, "maxResults": maxResults}

    def get_all_descriptions(self, projectName: str, folderPath: str) -> dict:
        """The tree of folders with their files, in path order."""
        own = self._own_files(self._project(projectName, folderPath))
        root: dict = {"path": "", "files": [], "folders": {}}
        for r in own.orderBy("file_path").toLocalIterator():
            node, parts = root, r["file_path"].split("/")
            for k, part in enumerate(parts[:-1], 1):
                node = node["folders"].setdefault(part, {"path": "/".join(parts[:k]), "files": [], "folders": {}})
            node["files"].append({"path": r["file_path"], "description": r["description"]})
        flat = lambda n: {"path": n["path"], "files": n["files"], "folders": [flat(f) for _, f in sorted(n["folders"].items())]}
        return {"projectName": projectName, "totalFiles": own.count(), "totalTokens": self._tokens(own), "structure": flat(root)}

    def get_codebase_overview(self, projectName: str, folderPath: str) -> dict:
        row = self.table("overviews").where(F.col("project_id") == self._project(projectName, folderPath)).first()
        return {"hasOverview": bool(row), **({"overview": row["overview"], "lastModified": row["last_modified"], "totalFiles": row["total_files"], "totalTokens": row["total_tokens"]} if row else {})}

    def update_codebase_overview(self, projectName: str, folderPath: str, overview: str) -> dict:
        project, now = self._project(projectName, folderPath), int(self.clock())
        own = self._own_files(project)
        n, tokens = own.count(), self._tokens(own)
        row = self.spark.createDataFrame([(project, overview, now, n, tokens)], SCHEMAS["overviews"])
        self.put("overviews", row)
        return {"success": True, "totalFiles": n, "totalTokens": tokens, "lastModified": now}

    def get_word_frequency(self, projectName: str, folderPath: str, limit: int = 200) -> dict:
        rows = S.word_frequency(self._own_files(self._project(projectName, folderPath)), limit, self.stop_words).orderBy(F.col("frequency").desc(), "term").collect()
        return {"topTerms": [{"term": r["term"], "frequency": r["frequency"]} for r in rows], "totalTermsAnalyzed": rows[0]["total_terms"] if rows else 0, "totalUniqueTerms": rows[0]["unique_terms"] if rows else 0}

    def search_codebase_overview(self, projectName: str, folderPath: str, searchWord: str) -> dict:
        own = self.table("overviews").where(F.col("project_id") == self._project(projectName, folderPath))
        rows = S.sentence_context(own, searchWord).orderBy("sentence_index").collect()
        return {"found": bool(rows), "totalMatches": len(rows), "matches": [{"matchIndex": k, "sentenceIndex": r["sentence_index"], "matchSentence": r["sentence"], "matchContext": r["context"]} for k, r in enumerate(rows, 1)]}

    def check_database_health(self) -> dict:
        scores = M.health_score(M.health_metrics(self.table("health"))).collect()
        log = self.table("operations")
        return {"health": [r.asDict() for r in scores], "operations": [r.asDict() for r in M.operation_metrics(log).collect()], "errors": [r.asDict() for r in M.error_stats(log.where(~F.col("ok"))).collect()]}

    def enabled_vector_mode(self, projectName: str, folderPath: str, enabled: bool) -> dict:
        project = self._project(projectName, folderPath)
        self.write("projects", C.set_vector_mode(self.table("projects"), project, enabled))
        return {"success": True, "projectId": project, "vectorMode": enabled}

    def index_vectors(self, projectName: str, folderPath: str) -> int:
        """Chunks and embeds the project's files that changed since they were last indexed; vectors of these and of files that
        went are replaced. The state is kept in the index meta: in_progress, then completed or failed.

        A run is planned once, in batches of about ``batch_files`` files, and a ledger says how far it has come. ``in_flight``
        batches go together as one job, whose vectors are staged; batches that are completed aren't done again by a call
        that takes up a run which failed or was lost. Once all are, the staged vectors replace the files'."""
        project = self._project(projectName, folderPath)
        self._put_status(project, "in_progress")
        try:
            run = self._open_run(project) or self._plan_run(project)
            while todo := self._batches(project, run).where("batch >= 0 AND status <> 'completed'").orderBy("batch").limit(self.in_flight).collect():
                self._do_batches(project, run, todo)
            self._finish_run(project, run)
        except Exception as error:
            self._put_status(project, "failed", str(error)[:500])
            raise
        made = self.table("vectors").where(F.col("project_id") == project)
        n, n_files = made.agg(F.count("*"), F.countDistinct("file_path")).first()
        self._put_status(project, "completed", None, n, n_files)
        return n

    def _batches(self, project: str, run: str) -> DataFrame:
        return self.table("index_batches").where((F.col("project_id") == project) & (F.col("run") == run))

    def _open_run(self, project: str) -> str | None:
        """The run that isn't finished; the ledger's row of batch -1 stands for a whole run."""
        row = self.table("index_batches").where((F.col("project_id") == project) & (F.col("batch") == -1) & (F.col("status") != "completed")).orderBy("updated", "run").first()
        return row["run"] if row else None

    def _mark(self, project: str, run: str, rows: list[tuple[int, int]], status: str, attempts: dict[int, int] | None = None, part: str | None = None, error: str | None = None) -> None:
        """rows: batch and number of files."""
        now, tries = int(self.clock()), attempts or {}
        self.put("index_batches", self.spark.createDataFrame([(project, run, b, n, status, tries.get(b, 0), part, error, now) for b, n in rows], SCHEMAS["index_batches"]))

    def _plan_run(self, project: str) -> str:
        run = uuid.uuid4().hex
        now = self._own_files(project).select("file_path", F.col("last_modified").cast("double").alias("mtime"))
        changed = C.changed_files(now, V.latest_mtimes(self.table("vectors").where(F.col("project_id") == project))).select("file_path", "mtime")
        plan = C.in_batches(changed, self.batch_files).select(F.lit(project).alias("project_id"), F.lit(run).alias("run"), "file_path", "mtime", "batch")
        self.put("index_plan", plan)
        sizes = self._plan(project, run).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()  # a row for each batch
        if sizes:
            self._mark(project, run, [(r["batch"], r["n"]) for r in sizes], "pending")
        self._mark(project, run, [(-1, sum(r["n"] for r in sizes))], "in_progress")  # from here on the run is there
        return run

    def _plan(self, project: str, run: str) -> DataFrame:
        return self.table("index_plan").where((F.col("project_id") == project) & (F.col("run") == run))

    def _do_batches(self, project: str, run: str, todo: list) -> None:
        rows, tries = [(r["batch"], r["files"]) for r in todo], {r["batch"]: r["attempts"] + 1 for r in todo}
        self._mark(project, run, rows, "in_progress", tries)
        part = f"{self.folder}/staged/{run}/{uuid.uuid4().hex}"
        try:
            plan = self._plan(project, run).where(F.col("batch").isin([b for b, _ in rows])).select("file_path", F.col("mtime").alias("file_mtime"))
            chunks = self.embed(chunk_files(self._own_files(project).join(plan, "file_path", "left_semi"), self.handlers)).join(plan, "file_path")
            named = chunks.withColumn("id", F.concat_ws("_", "project_id", "id", "chunk_index"))
            named.select(*[f.name for f in self.table("vectors").schema]).write.parquet(part)
        except Exception as error:
            self._mark(project, run, rows, "failed", tries, None, str(error)[:500])
            raise
        self._mark(project, run, rows, "completed", tries, part)

    def _finish_run(self, project: str, run: str) -> None:
        """Puts the staged vectors in place. Done twice, it gives the same."""
        stored = self.table("vectors")
        parts = sorted({r["part"] for r in self._batches(project, run).where("batch >= 0").select("part").distinct().collect()})
        made = self.spark.read.schema(stored.schema).parquet(*parts) if parts else stored.limit(0)
        gone = V.vanished(stored.where(F.col("project_id") == project), self._own_files(project).select("project_id", "file_path"))
        replaced = self._plan(project, run).select("project_id", "file_path").unionByName(gone)
        self.write("vectors", V.delete_files(stored, replaced).unionByName(made))
        self._mark(project, run, [(-1, 0)], "completed")
        fs, _ = self._fs("staged")
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/staged/{run}"), True)

    def pause(self, projectName: str, folderPath: str) -> None:
        self._put_status(self._project(projectName, folderPath), "paused")

    def run_pending(self) -> dict[str, int]:
        """One round of a monitor: failed and paused projects are pending again, and pending ones and those without a state
        are indexed, if they are in vector mode. Vectors by project; one that fails stays failed until the next round."""
        meta = self.table("index_meta").select(F.col("project_id").alias("id"), "sync_status")
        projects = self.table("projects").where("vector_mode").join(meta, "id", "left").orderBy("id").collect()
        out = {}
        for r in projects:
            if r["sync_status"] in ("failed", "paused"):
                self._put_status(r["id"], "pending")
            if r["sync_status"] in (None, "pending", "failed", "paused"):
                try:
                    out[r["id"]] = self.index_vectors(r["name"], r["aliases"][0] if r["aliases"] else "")
                except Exception:  # noqa: BLE001  its state says what went wrong
                    continue
        return out

    def _put_status(self, project: str, status: str, error: str | None = None, chunks: int | None = None, files: int | None = None) -> None:
        meta, now = self.table("index_meta"), int(self.clock())
        old = meta.where(F.col("project_id") == project).first()
        values = (old.asDict() if old else {"created": now}) | {"project_id": project, "sync_status": status, "error_message": error, "last_modified": now}
        if status == "completed":
            values |= {"last_sync": now, "total_chunks": chunks, "indexed_chunks": chunks, "total_files": files, "indexed_files": files}
        self.put("index_meta", self.spark.createDataFrame([tuple(values.get(f.name) for f in meta.schema)], meta.schema))

    def find_similar_code(self, projectName: str, folderPath: str, code_snippet: str | None = None, file_path: str | None = None, line_start: int | None = None, line_end: int | None = None, similarity_threshold: float | None = None, max_results: int = 20) -> dict:
        project = self._project(projectName, folderPath)
        if (code_snippet is None) == (file_path is None):
            raise ToolError("give either code_snippet, or file_path with line_start and line_end")
        if file_path is not None:
            row = C.find_file(self.table("files"), project, file_path).first()
            lines = row["description"].split("\n") if row else []
            if not line_start or not line_end or not 1 <= line_start <= min(line_end, len(lines)):
                raise ToolError("no such lines")
            code_snippet = "\n".join(lines[line_start - 1 : line_end])
        asked = self.spark.createDataFrame([(0, project, file_path or "snippet.py", code_snippet)], "id long, project_id string, file_path string, description string")
        vectors = self.table("vectors").where(F.col("project_id") == project)
        queries = self.embed(chunk_files(asked, self.handlers)).select(F.col("chunk_index").cast("long").alias("query_id"), "vector")
        near = V.nearest_many(vectors.withColumn("key", F.xxhash64("id")).select(F.col("key").alias("id"), "vector"), queries, min(2 * max_results, 50))
        hits = near.join(vectors.select(F.xxhash64("id").alias("id"), "file_path", "start_line", "end_line", "content", "content_hash"), "id")
        rows = V.similar(hits, similarity_threshold, max_results).collect()
        return {"results": [{"filePath": r["file_path"], "startLine": r["start_line"], "endLine": r["end_line"], "content": r["content"], "similarity": r["similarity"]} for r in rows], "totalResults": len(rows)}

