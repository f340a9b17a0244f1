"""Trees of files, listings and what is left out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import glob_match, suffix
from quarry.operators import tree as T
from quarry.plans.registry import query
from quarry.sources import adapters as A


@query(f"""WITH {A.FILES}, p AS (SELECT project_id, string_split(file_path, '/') AS a FROM files WHERE to_be_cleaned IS NULL), k AS (SELECT project_id, a, unnest(range(len(a))) AS d FROM p)
  SELECT project_id, coalesce(array_to_string(a[1:d], '/'), '') AS folder, d::INT AS depth, count(*) AS files, count(*) FILTER (WHERE d = len(a) - 1) AS direct FROM k GROUP BY 1, 2, 3""")
def ag20_folder_rollup(spark, sf):
    return T.folder_rollup(A.files(spark, sf))


def _merkle_sql(file_hash: str = "file_hash", size: str = "strlen(description)", where: str = "true") -> str:
    return f"""{A.FILES}, leaf AS (SELECT project_id, file_path AS path, regexp_replace(file_path, '/?[^/]*$', '') AS parent, {file_hash} AS hash, {size} AS size FROM files WHERE to_be_cleaned IS NULL AND {where}),
  l2 AS (SELECT project_id, parent AS path, regexp_replace(parent, '/?[^/]*$', '') AS parent, sha256(string_agg(string_split(path, '/')[-1] || ':' || hash, '|' ORDER BY string_split(path, '/')[-1])) AS hash, sum(size)::BIGINT AS size FROM leaf GROUP BY 1, 2, 3),
  l1 AS (SELECT project_id, parent AS path, '' AS parent, sha256(string_agg(string_split(path, '/')[-1] || ':' || hash, '|' ORDER BY path)) AS hash, sum(size)::BIGINT AS size FROM l2 GROUP BY 1, 2),
  l0 AS (SELECT project_id, '' AS path, NULL AS parent, sha256(string_agg(path || ':' || hash, '|' ORDER BY path)) AS hash, sum(size)::BIGINT AS size FROM l1 GROUP BY 1),
  nodes AS (SELECT project_id, path, nullif(parent, '') AS parent_path, 'file' AS node_type, hash, 3 AS depth, size FROM leaf UNION ALL SELECT project_id, path, nullif(parent, ''), 'directory', hash, 2, size FROM l2
    UNION ALL SELECT project_id, path, NULL, 'directory', hash, 1, size FROM l1 UNION ALL SELECT project_id, path, NULL, 'project', hash, 0, size FROM l0)"""


MERKLE = _merkle_sql()


@query(f"WITH {MERKLE} SELECT project_id, path, parent_path, node_type, hash, depth, size FROM nodes")
def ag18_merkle_hashes(spark, sf):
    return T.merkle(A.files(spark, sf))


@query(f"""WITH {_merkle_sql("CASE WHEN id % 31 = 0 THEN 'x' ELSE file_hash END", "CASE WHEN id % 31 = 0 THEN 7 ELSE strlen(description) END", "id % 17 <> 2")} SELECT project_id, path, parent_path, node_type, hash, depth, size FROM nodes""")
def ss4_merkle_update(spark, sf):
    """A tree after some files changed, went, or came: only folders above these are hashed again."""
    f = A.files(spark, sf).where("to_be_cleaned IS NULL")
    nodes = T.merkle(f.where("id % 23 <> 1 OR id % 17 = 2"))
    marked = f.where("id % 31 = 0 OR id % 17 = 2 OR id % 23 = 1")
    went, again = F.col("id") % 17 == 2, F.col("id") % 31 == 0
    changed = marked.select("project_id", "file_path", F.when(went, None).when(again, "x").otherwise(F.col("file_hash")).alias("file_hash"), F.when(again, "changed").otherwise(F.col("description")).alias("description"))
    return T.merkle_update(nodes, changed)


@query(f"""WITH {MERKLE} SELECT project_id, count(*) AS nodes, count(*) FILTER (WHERE node_type = 'file') AS files, count(*) FILTER (WHERE node_type <> 'file') AS folders, max(depth) AS max_depth,
  sum(size) FILTER (WHERE node_type = 'file')::BIGINT AS total_size FROM nodes GROUP BY 1""")
def ag19_tree_stats(spark, sf):
    return T.tree_stats(T.merkle(A.files(spark, sf)))


@query(f"""WITH {A.FILES}, a AS (SELECT project_id, file_path AS path, file_hash AS h FROM files WHERE to_be_cleaned IS NULL AND id % 11 <> 0),
  b AS (SELECT project_id, file_path AS path, CASE WHEN id % 13 = 0 THEN 'x' ELSE file_hash END AS h FROM files WHERE to_be_cleaned IS NULL AND id % 7 <> 0)
  SELECT project_id, path, CASE WHEN a.h IS NULL THEN 'created' WHEN b.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (project_id, path) WHERE a.h IS DISTINCT FROM b.h""")
def ss4_snapshot_diff(spark, sf):
    f = A.files(spark, sf).where("to_be_cleaned IS NULL")
    old = f.where("id % 11 <> 0").select("project_id", F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    new = f.where("id % 7 <> 0").select("project_id", F.col("file_path").alias("path"), F.when(F.col("id") % 13 == 0, "x").otherwise(F.col("file_hash")).alias("hash"))
    return T.snapshot_diff(old, new)


@query(f"""WITH {A.FILES}, r AS (SELECT project_id, regexp_replace(file_path, '/?[^/]*$', '') AS folder, string_split(file_path, '/')[-1] AS name, replace(replace(description, '|', '\\|'), chr(10), ' ') AS cell FROM files WHERE to_be_cleaned IS NULL)
  SELECT project_id, folder, 2 AS depth, '#### ' || folder AS header, sha256(string_agg('| ' || name || ' | ' || cell || ' |', chr(10) ORDER BY name)) AS body_hash FROM r GROUP BY 1, 2""")
def ag21_markdown_dirs(spark, sf):
    return T.markdown_folders(A.files(spark, sf)).select("project_id", "folder", "depth", "header", F.sha2("body", 256).alias("body_hash"))


LISTING = f"""{A.FILES}, listing AS (SELECT project_id, CASE id % 9 WHEN 0 THEN 'node_modules/' || file_path WHEN 1 THEN file_path || '.log' WHEN 2 THEN 'a/build/x.PNG' WHEN 3 THEN 'docs/_build/' || file_path WHEN 4 THEN 'src/yarn.lock' ELSE file_path END AS file_path,
  length(description) AS size FROM files), marked AS (SELECT *, starts_with(file_path, 'node_modules/') OR ends_with(file_path, '.log') OR file_path IN ('a/build/x.PNG', 'src/yarn.lock') OR starts_with(file_path, 'docs/_build/') AS ignored FROM listing)"""


def _listing(spark, sf):
    k, p = F.col("id") % 9, F.col("file_path")
    path = (
        F.when(k == 0, F.concat(F.lit("node_modules/"), p)).when(k == 1, F.concat(p, F.lit(".log"))).when(k == 2, "a/build/x.PNG")
        .when(k == 3, F.concat(F.lit("docs/_build/"), p)).when(k == 4, "src/yarn.lock").otherwise(p)
    )
    return A.files(spark, sf).select("project_id", path.alias("file_path"), F.char_length("description").alias("size"))


@query(f"WITH {LISTING} SELECT project_id, file_path, ignored FROM marked")
def pf6_ignored_paths(spark, sf):
    return _listing(spark, sf).select("project_id", "file_path", T.is_ignored(F.col("file_path")).alias("ignored"))


@query(f"WITH {LISTING} SELECT project_id, count(*) FILTER (WHERE NOT ignored) AS trackable, count(*) FILTER (WHERE ignored) AS ignored, max(size) FILTER (WHERE NOT ignored) AS largest FROM marked GROUP BY 1")
def ag6_project_stats(spark, sf):
    out = T.listing_stats(_listing(spark, sf), T.is_ignored(F.col("file_path")))
    return out.withColumn("largest", F.col("largest").cast("long"))


@query(f"WITH {LISTING} SELECT project_id, lower(regexp_extract(string_split(file_path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS extension, count(*) AS files FROM marked WHERE NOT ignored GROUP BY 1, 2")
def ag6_extension_histogram(spark, sf):
    return T.extension_histogram(_listing(spark, sf), T.is_ignored(F.col("file_path")))


@query(f"""WITH {LISTING} SELECT file_path, count(*) AS n FROM listing WHERE NOT (regexp_full_match(file_path, 'node_modules/.*') OR ends_with(file_path, '.log')) GROUP BY 1""")
def pf10_vector_listing(spark, sf):
    kept = _listing(spark, sf).where(~glob_match(F.col("file_path"), list(T.VECTOR_IGNORED)))
    return kept.groupBy("file_path").agg(F.count("*").alias("n"))


@query(f"WITH {LISTING} SELECT file_path, starts_with(file_path, 'node_modules/') OR ends_with(file_path, '.log') OR starts_with(file_path, 'a/build/') OR contains(file_path, '_build/') OR file_path = 'src/yarn.lock' AS ignored, count(*) AS n FROM listing GROUP BY 1, 2")
def pf8_ignored_by_name(spark, sf):
    return _listing(spark, sf).select("file_path", T.ignored_by_name(F.col("file_path"), T.IGNORED_PATTERNS).alias("ignored")).groupBy("file_path", "ignored").agg(F.count("*").alias("n"))


@query(f"WITH {A.FILES} SELECT id, regexp_matches(file_path, '(^|/)doc_1[^/]*$') OR ends_with(file_path, '.md') AS ignored FROM files")
def pf11_ignored_in_tree(spark, sf):
    return A.files(spark, sf).select("id", T.ignored_in_tree(F.col("file_path"), ("*.md", "doc_1*", "en/*", ".git/*")).alias("ignored"))


@query(f"""WITH {A.FILES} SELECT id, regexp_matches(file_path, '\\.(py|js|ts)$') AS code FROM files""")
def pf12_code_files(spark, sf):
    return A.files(spark, sf).select("id", suffix(F.col("file_path")).isin(*T.CODE_EXTENSIONS).alias("code"))


@query(f"""WITH {A.FILES} SELECT id, ends_with(file_path, '.md') OR starts_with(file_path, 'de/') OR regexp_matches(file_path, '(^|/)doc_1[^/]*\\.py$') AS ignored FROM files""")
def pf9_gitignored(spark, sf):
    return A.files(spark, sf).select("id", T.gitignored(F.col("file_path"), ["# words", "*.md", "/de/", "", "doc_1*.py"]).alias("ignored"))


@query(f"""WITH {A.FILES} SELECT id, ends_with(file_path, '.md') OR starts_with(file_path, 'fr/large/') AS ignored FROM files""")
def pf9_gitignored_upward(spark, sf):
    """Lists of the root and of a folder above it, whose paths begin further up; one of a folder elsewhere doesn't count."""
    lines = {"/w/app": ["*.md"], "/w": ["/app/fr/large/"], "/w/other": ["*.py"], "/": ["# none"]}
    return A.files(spark, sf).select("id", T.gitignored_upward(F.col("file_path"), "/w/app", lines).alias("ignored"))


@query(f"""WITH {A.FILES} SELECT id, regexp_replace(file_path, '/?[^/]*$', '') AS parent, string_split(file_path, '/')[-1] AS name,
  CASE WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.js') THEN 'javascript' WHEN ends_with(file_path, '.ts') THEN 'typescript' ELSE 'generic.' || string_split(file_path, '.')[-1] END AS language FROM files""")
def sf15_path_parts(spark, sf):
    from quarry.functions import text as X

    p = F.col("file_path")
    return A.files(spark, sf).select("id", X.parent(p).alias("parent"), X.base_name(p).alias("name"), X.language(p).alias("language"))
