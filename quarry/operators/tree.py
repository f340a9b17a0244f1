"""Folders: roll-ups by prefix, Merkle hashes level by level, snapshots and their differences, markdown maps."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import base_name, demote_headers, glob_match, parent, suffix, table_cell
from quarry.operators.catalog import active


def folder_rollup(files: DataFrame) -> DataFrame:
    """project_id, folder, depth, files, direct: files under each folder, and right in it. '' is the top.

    Each file is counted for each of its folders; counts are combined before they move."""
    parts = F.split("file_path", "/")
    depth = F.size(parts) - 1
    folders = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = active(files).select("project_id", parent(F.col("file_path")).alias("own"), F.posexplode(folders).alias("depth", "folder"))
    return rows.groupBy("project_id", "folder", "depth").agg(F.count("*").alias("files"), F.count(F.when(F.col("own") == F.col("folder"), 1)).alias("direct"))


def _folder_hashes(children: DataFrame, level: int) -> DataFrame:
    """project_id, path, hash, size, depth, node_type of the folders that hold nodes of ``level``."""
    named = F.array_sort(F.collect_list(F.struct(base_name(F.col("path")).alias("name"), "hash")))
    joined = F.array_join(F.transform(named, lambda c: F.concat(c["name"], F.lit(":"), c["hash"])), "|")
    folders = children.groupBy("project_id", parent(F.col("path")).alias("path")).agg(F.sha2(joined, 256).alias("hash"), F.sum("size").alias("size"))
    return folders.select("project_id", "path", "hash", "size", F.lit(level - 1).alias("depth"), F.when(F.col("path") == "", "project").otherwise("directory").alias("node_type"))


def _leaves(files: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("description"), F.lit(0)).cast("long") if "description" in files.columns else F.lit(0).cast("long")
    return active(files).select("project_id", F.col("file_path").alias("path"), F.col("file_hash").alias("hash"), size.alias("size"), F.size(F.split("file_path", "/")).alias("depth"), F.lit("file").alias("node_type"))


def _with_parent(nodes: DataFrame) -> DataFrame:
    top = F.when(F.col("path") == "", None).otherwise(parent(F.col("path")))
    return nodes.select("project_id", "path", F.when(top != "", top).alias("parent_path"), "node_type", "hash", "depth", "size")


def merkle(files: DataFrame) -> DataFrame:
    """project_id, path, parent_path, node_type, hash, depth, size. A folder's hash is sha256 of 'name:hash' of its children,
    sorted by name and joined with '|'; its size is that of all files below. Children of the top have a null parent; the
    top itself is ''.

    One aggregate per level, from the deepest up, over the leaves of that level and the folders below it alone; levels are
    shared between the branches of the union as exchanges that are reused."""
    leaves = _leaves(files)
    depth = leaves.agg(F.max("depth")).first()[0] or 0
    nodes, folders = leaves, None
    for level in range(depth, 0, -1):
        children = leaves.where(F.col("depth") == level)
        folders = _folder_hashes(children if folders is None else children.unionByName(folders), level)
        nodes = nodes.unionByName(folders)
    return _with_parent(nodes)


def merkle_update(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes as ``merkle`` gives them; changed: project_id, file_path, file_hash, description, a null hash for files that went. The nodes
    afterwards: only folders above a changed file are hashed again, from their children, of which the others stand."""
    columns = ["project_id", "path", "hash", "size", "depth", "node_type"]
    marked = _leaves(changed.withColumn("to_be_cleaned", F.lit(None).cast("long")))
    parts = F.split("path", "/")
    above = marked.select("project_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    touched = above.unionByName(marked.select("project_id", "path"))
    kept = nodes.select(*columns).join(touched, ["project_id", "path"], "left_anti")
    fresh = marked.where("hash IS NOT NULL").select(*columns)
    # of what stands, only children of folders that are hashed again are read
    beside = kept.withColumn("up", parent(F.col("path"))).where("path <> ''").join(above.withColumnRenamed("path", "up"), ["project_id", "up"], "left_semi").drop("up")
    depth = max(nodes.agg(F.max("depth")).first()[0] or 0, marked.agg(F.max("depth")).first()[0] or 0)
    out, folders = kept.unionByName(fresh), None
    for level in range(depth, 0, -1):
        children = beside.unionByName(fresh).where(F.col("depth") == level)
        folders = _folder_hashes(children if folders is None else children.unionByName(folders), level)
        out = out.unionByName(folders)
    return _with_parent(out)


def tree_stats(nodes: DataFrame) -> DataFrame:
    is_file = F.col("node_type") == "file"
    return nodes.groupBy("project_id").agg(
        F.count("*").alias("nodes"), F.count(F.when(is_file, 1)).alias("files"), F.count(F.when(~is_file, 1)).alias("folders"), F.max("depth").alias("max_depth"), F.sum(F.when(is_file, F.col("size"))).alias("total_size")
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, path, change: nodes created, modified or deleted between two trees."""
    a = old.select("project_id", "path", F.col("hash").alias("old_hash"))
    b = new.select("project_id", "path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, ["project_id", "path"], "full").select("project_id", "path", change.alias("change")).where("change IS NOT NULL")


def markdown_folders(files: DataFrame) -> DataFrame:
    """project_id, folder, depth, header, body: a table of files per folder, in path order; the top comes first."""
    rows = active(files).select("project_id", parent(F.col("file_path")).alias("folder"), base_name(F.col("file_path")).alias("name"), table_cell(F.col("description")).alias("cell"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "cell"))), lambda r: F.concat(F.lit("| "), r["name"], F.lit(" | "), r["cell"], F.lit(" |")))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    out = rows.groupBy("project_id", "folder").agg(F.array_join(lines, "\n").alias("body")).withColumn("depth", depth)
    header = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("depth") + 2)), F.lit(" "), F.when(F.col("folder") == "", "Root").otherwise(F.col("folder")))
    return out.select("project_id", "folder", "depth", header.alias("header"), "body")


def project_markdown(projects: DataFrame, files: DataFrame, overviews: DataFrame, project_id: str) -> DataFrame:
    """One row: the whole map of a project as markdown."""
    folders = markdown_folders(files.where(F.col("project_id") == project_id))
    section = F.concat("header", F.lit("\n\n| File | Description |\n|---|---|\n"), "body")
    body = folders.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", section.alias("s")))), lambda r: r["s"]), "\n\n").alias("body"))
    own = projects.where(F.col("id") == project_id).select(F.col("id").alias("project_id"), "name")
    title = F.when(F.col("name") == F.lower("name"), F.initcap("name")).otherwise(F.col("name"))
    joined = own.join(overviews, "project_id", "left").join(body, "project_id", "left")
    return joined.select("project_id", F.concat_ws("\n\n", F.concat(F.lit("# "), title), demote_headers(F.col("overview")), "body").alias("markdown"))


#: Names and endings that a listing leaves out.
IGNORED_PATTERNS = (
    ".git/", ".svn/", ".hg/", "node_modules/", "venv/", ".venv/", "env/", ".env/", "__pycache__/", "*.pyc", "*.pyo", "*.pyd", ".Python",
    "build/", "dist/", "target/", "out/", "bin/", "obj/", "*.o", "*.so", "*.dylib", "*.dll", "*.exe", ".vscode/", ".idea/", ".vs/", "*.swp", "*.swo", "*~",
    ".DS_Store", "Thumbs.db", "coverage/", "htmlcov/", ".pytest_cache/", ".coverage", "*.coverage", "_build/", "docs/_build/", "site/",
    "*.log", "*.tmp", "*.temp", "*.cache", "*.tar.gz", "*.zip", "*.rar", "*.7z", "package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock",
)
#: Extensions that a listing leaves out.
IGNORED_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".obj", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".zip", ".tar", ".gz", ".rar", ".7z", ".ttf", ".otf", ".woff", ".woff2", ".eot",
)
#: What an index of vectors leaves out, and the endings of code.
VECTOR_IGNORED = (
    "*.log", "*.tmp", "*~", ".git/*", "__pycache__/*", "node_modules/*", "*.pyc", "*.pyo", ".DS_Store", "Thumbs.db", ".vscode/*", ".coverage", ".ruff_cache/*",
    ".mypy_cache/*", ".pytest_cache/*", ".import_linter_cache/*", "*/tiktoken_cache/*", ".code-index/*", ".hypothesis/*", "poetry.lock", "venv/*", "htmlcov/*",
)
CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".cs", ".php", ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".clj", ".cljs", ".hs",
    ".ml", ".fs", ".ex", ".exs", ".cr", ".dart", ".lua", ".pl", ".sh", ".bash", ".zsh", ".fish", ".sql", ".r", ".m", ".mm", ".vim", ".el", ".lisp", ".scm",
)


def is_ignored(path, patterns: tuple[str, ...] = IGNORED_PATTERNS, extensions: tuple[str, ...] = IGNORED_EXTENSIONS):
    """A pattern that ends in / names a folder or file on the way; one that begins with * is an ending; one with another
    slash is a part of the path; any other is a name on the way. Extensions count whatever their case."""
    names = [p.rstrip("/") for p in patterns if p[0] != "*" and (p.endswith("/") or "/" not in p)]
    endings = [p[1:] for p in patterns if p[0] == "*"]
    inner = [p for p in patterns if p[0] != "*" and "/" in p and not p.endswith("/")]
    whole = suffix(path).isin(*extensions) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))
    for parts, pattern in ((endings, "(?:{})$"), (inner, "(?:{})")):
        if parts:
            whole = whole | path.rlike(pattern.format("|".join(map(re.escape, parts))))
    return whole


def gitignored(path, lines: list[str]):
    """Does any line of a .gitignore match? Comments and blank lines don't count, nor do negations."""
    whole = F.lit(False)
    for line in (x.strip() for x in lines):
        if not line or line[0] in "#!":
            continue
        anchored = line.startswith("/") or "/" in line.rstrip("/")
        body = fnmatch.translate(line.strip("/")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace(".*", "[^/]*")
        tail = "/.*" if line.endswith("/") else "(?:/.*)?"
        whole = whole | path.rlike(f"^{'' if anchored else '(?:.*/)?'}{body}{tail}$")
    return whole


def gitignored_upward(path, root: str, lines_by_folder: dict[str, list[str]]):
    """Does a .gitignore of ``root`` or of a folder above it match? path is relative to root, folders are absolute."""
    whole = F.lit(False)
    for folder, lines in lines_by_folder.items():
        base = folder.rstrip("/")
        if root.rstrip("/") == base or root.startswith(base + "/"):
            inner = root.rstrip("/")[len(base) :].strip("/")
            whole = whole | gitignored(F.concat(F.lit(inner + "/"), path) if inner else path, lines)
    return whole


def ignored_by_name(path, patterns: tuple[str, ...]):
    """Shell patterns: one that ends in / names a folder on the way, others match the whole path or the name."""
    folders = [p.rstrip("/") for p in patterns if p.endswith("/")]
    names = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    others = [p for p in patterns if not p.endswith("/")]
    return F.exists(names, lambda n: glob_match(n, folders)) | glob_match(path, others) | glob_match(base_name(path), others)


def ignored_in_tree(path, patterns: tuple[str, ...]):
    """What a hash tree leaves out: names that match a pattern. Patterns with a folder never do."""
    return glob_match(base_name(path), list(patterns))


def listing_stats(listing: DataFrame, ignored) -> DataFrame:
    """listing: project_id, file_path, size. Per project: tracked and ignored files, the largest tracked one."""
    kept = ~ignored
    return listing.groupBy("project_id").agg(F.count(F.when(kept, 1)).alias("trackable"), F.count(F.when(ignored, 1)).alias("ignored"), F.max(F.when(kept, F.col("size"))).alias("largest"))


def extension_histogram(listing: DataFrame, ignored) -> DataFrame:
    return listing.where(~ignored).groupBy("project_id", suffix(F.col("file_path")).alias("extension")).agg(F.count("*").alias("files"))
