"""Look-ups, writes and joins of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import NAMESPACE_PREFIX, base_name, namespace
from quarry.operators import catalog as C
from quarry.plans.registry import query
from quarry.sources import adapters as A

ACTIVE = "to_be_cleaned IS NULL"
ROW = ["id", "project_id", "file_path", "file_hash", "version", "to_be_cleaned"]
ROWS = ", ".join(ROW)


@query(f"WITH {A.PROJECTS} SELECT id, name, array_to_string(aliases, ',') AS aliases FROM projects WHERE vector_mode")
def sc2_vector_projects(spark, sf):
    return A.projects(spark, sf).where("vector_mode").select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {A.PROJECTS} SELECT id, name, array_to_string(aliases, ',') AS aliases, coalesce(vector_mode, false) AS vector_mode FROM projects")
def sc1_all_projects(spark, sf):
    return A.projects(spark, sf).select("id", "name", F.array_join("aliases", ",").alias("aliases"), F.coalesce("vector_mode", F.lit(False)).alias("vector_mode"))


@query(f"WITH {A.PROJECTS} SELECT id, name FROM projects WHERE lower(name) = 'src7'")
def sc3_project_by_name(spark, sf):
    return C.find_project(A.projects(spark, sf), "SRC7").select("id", "name")


@query(f"WITH {A.FILES} SELECT {ROWS} FROM files WHERE project_id = 'src4' AND file_path LIKE '%/doc_4.%' AND {ACTIVE}")
def sc4_file_lookup(spark, sf):
    f = A.files(spark, sf)
    path = F.concat_ws("/", F.element_at(F.split("file_path", "/"), 1), F.element_at(F.split("file_path", "/"), 2), F.lit("doc_4.txt"))
    return C.active(f).where((F.col("project_id") == "src4") & (F.col("file_path") == path)).select(*ROW)


@query(f"WITH {A.FILES} SELECT {ROWS} FROM files WHERE project_id = 'src3' AND {ACTIVE} ORDER BY file_path")
def sc5_active_files_sorted(spark, sf):
    return C.project_files(A.files(spark, sf), "src3").select(*ROW)


@query(f"WITH {A.OVERVIEWS} SELECT project_id, sha256(overview) AS overview_hash, total_tokens FROM overviews WHERE project_id = 'src1'")
def sc6_overview_lookup(spark, sf):
    return A.overviews(spark, sf).where("project_id = 'src1'").select("project_id", F.sha2("overview", 256).alias("overview_hash"), "total_tokens")


@query(f"""WITH {A.VECTORS} SELECT project_id, count(*) AS total_chunks, 0::BIGINT AS queue_depth, 'pending' AS sync_status, {A.NOW}::BIGINT AS created
  FROM vectors GROUP BY project_id""")
def sc7_index_meta_defaults(spark, sf):
    meta = A.vectors(spark, sf).groupBy("project_id").agg(F.count("*").alias("total_chunks"))
    for c in ("indexed_chunks", "total_files", "indexed_files", "queue_depth", "created", "last_modified"):
        meta = meta.withColumn(c, F.lit(None).cast("long"))
    meta = meta.withColumn("sync_status", F.lit(None).cast("string"))
    return C.index_meta_defaults(meta, F.lit(A.NOW).cast("long")).select("project_id", "total_chunks", F.col("queue_depth").cast("long").alias("queue_depth"), "sync_status", "created")


@query(f"""WITH {A.PROJECTS}, {A.FILES}, {A.OVERVIEWS} SELECT p.id AS project_id, p.name, o.total_tokens, f.file_path FROM projects p
  LEFT JOIN overviews o ON o.project_id = p.id LEFT JOIN files f ON f.project_id = p.id AND f.{ACTIVE} WHERE lower(p.name) = 'src2' ORDER BY f.file_path""")
def sc8_project_map(spark, sf):
    return C.project_map(A.projects(spark, sf), A.files(spark, sf), A.overviews(spark, sf), "Src2").select("project_id", "name", "total_tokens", "file_path")


@query(f"""WITH {A.FILES}, {A.PROJECTS}, chunks AS (SELECT id AS file_id, project_id, len(string_split(description, chr(10))) AS n_lines, version > 0 AS embedded FROM files)
  SELECT p.name, f.file_path, c.n_lines FROM chunks c JOIN files f ON f.id = c.file_id JOIN projects p ON p.id = c.project_id WHERE c.embedded AND f.{ACTIVE}""")
def sc15_vector_search_view(spark, sf):
    f = A.files(spark, sf)
    chunks = f.select(F.col("id").alias("file_id"), F.col("project_id").alias("pid"), F.size(F.split("description", "\n")).alias("n_lines"), (F.col("version") > 0).alias("embedded"))
    joined = chunks.where("embedded").join(C.active(f).select("id", "file_path"), F.col("file_id") == F.col("id")).drop("id")
    return joined.join(A.projects(spark, sf).select(F.col("id").alias("pid"), "name"), "pid").select("name", "file_path", F.col("n_lines").cast("long").alias("n_lines"))


@query(f"WITH {A.FILES} SELECT project_id, count(*) AS files FROM files WHERE {ACTIVE} GROUP BY project_id")
def ag1_file_counts(spark, sf):
    return C.active(A.files(spark, sf)).groupBy("project_id").agg(F.count("*").alias("files"))


@query(f"""WITH {A.FILES} SELECT project_id, count(*) FILTER (WHERE {ACTIVE}) AS active, count(to_be_cleaned) AS marked,
  count(*) FILTER (WHERE to_be_cleaned < {A.NOW} - 6 * 2592000) AS eligible FROM files GROUP BY ROLLUP (project_id)""")
def ag5_cleanup_stats(spark, sf):
    return C.cleanup_stats(A.files(spark, sf), A.NOW)


@query(f"""WITH {A.VECTORS}, chunks AS (SELECT project_id, file_path AS file_id, CASE WHEN id % 4 <> 0 THEN id END AS embedding_id FROM vectors)
  SELECT project_id, count(*) AS total_chunks, count(embedding_id) AS indexed_chunks, count(DISTINCT file_id) AS total_files,
  count(DISTINCT CASE WHEN embedding_id IS NOT NULL THEN file_id END) AS indexed_files FROM chunks GROUP BY project_id""")
def ag4_index_rollup(spark, sf):
    chunks = A.vectors(spark, sf).select("project_id", F.col("file_path").alias("file_id"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("embedding_id"))
    return C.index_rollup(chunks)


NEW = "SELECT id, project_id, file_path, 'new' || (id % 3) AS file_hash, version + id % 3 AS version, NULL::BIGINT AS to_be_cleaned FROM files WHERE id % 10 = 0"
EXTRA = "SELECT id + 1000000000 AS id, project_id, file_path || '.new' AS file_path, 'added' AS file_hash, 1::BIGINT AS version, NULL::BIGINT AS to_be_cleaned FROM files WHERE id % 25 = 0"


def _new_rows(f):
    none = F.lit(None).cast("long").alias("to_be_cleaned")
    again = f.where("id % 10 = 0").select("id", "project_id", "file_path", F.concat(F.lit("new"), (F.col("id") % 3).cast("string")).alias("file_hash"), (F.col("version") + F.col("id") % 3).alias("version"), none)
    added = f.where("id % 25 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "project_id", F.concat("file_path", F.lit(".new")).alias("file_path"), F.lit("added").alias("file_hash"), F.lit(1).cast("long").alias("version"), none)
    return again.unionByName(added)


@query(f"""WITH {A.FILES}, new AS ({NEW} UNION ALL {EXTRA}), old AS (SELECT {ROWS} FROM files)
  SELECT {ROWS} FROM old WHERE (project_id, file_path) NOT IN (SELECT project_id, file_path FROM new) UNION ALL SELECT {ROWS} FROM new""")
def dm2_upsert(spark, sf):
    f = A.files(spark, sf).select(*ROW)
    return C.upsert(f, _new_rows(f), ["project_id", "file_path"], "id")


@query(f"""WITH {A.VERSIONS} SELECT project_id, file_path, file_hash, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY last_modified DESC, id DESC) AS k
  FROM versions) WHERE k = 1""")
def dm3_batch_upsert_last_wins(spark, sf):
    v = A.versions(spark, sf)
    return C.upsert(v.limit(0), v, ["project_id", "file_path"], "last_modified", "id").select("project_id", "file_path", "file_hash", "id")


@query(f"""WITH {A.PROJECTS}, wanted AS (SELECT 'Src' || (n % 30) AS name, '/home/w' || n AS folder FROM (SELECT DISTINCT doc_id % 40 AS n FROM documents)),
  folders AS (SELECT lower(name) AS key, min(name) AS new_name, list_sort(list(DISTINCT folder)) AS folders FROM wanted GROUP BY 1)
  SELECT coalesce(p.id, sha256(f.key)) AS id, coalesce(p.name, f.new_name) AS name, array_to_string(list_concat(coalesce(p.aliases, []), coalesce(f.folders, [])), ',') AS aliases
  FROM projects p FULL JOIN folders f ON lower(p.name) = f.key""")
def dm6_alias_append(spark, sf):
    n = A.table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("n")).distinct()
    wanted = n.select(F.concat(F.lit("Src"), (F.col("n") % 30).cast("string")).alias("name"), F.concat(F.lit("/home/w"), F.col("n").cast("string")).alias("folder"))
    return C.get_or_create_projects(A.projects(spark, sf), wanted).select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {A.OVERVIEWS}, new AS (SELECT project_id, 'x' AS overview, 1::BIGINT AS total_tokens FROM overviews WHERE project_id IN ('src0', 'src1'))
  SELECT project_id, sha256(overview) AS overview_hash, total_tokens FROM (SELECT * FROM overviews WHERE project_id NOT IN ('src0', 'src1') UNION ALL SELECT * FROM new)""")
def dm7_replace_overviews(spark, sf):
    o = A.overviews(spark, sf)
    new = o.where("project_id IN ('src0', 'src1')").select("project_id", F.lit("x").alias("overview"), F.lit(1).cast("long").alias("total_tokens"))
    return C.upsert(o, new, ["project_id"]).select("project_id", F.sha2("overview", 256).alias("overview_hash"), "total_tokens")


@query(f"""WITH cache AS (SELECT substr(sha256(text), 1, 16) AS cache_key, max(length(text) // 4) AS token_count, {A.NOW}::BIGINT - (max(doc_id) % 3) * 50000 + 86400 AS expires FROM documents GROUP BY 1)
  SELECT cache_key, token_count, expires FROM cache WHERE expires > {A.NOW}""")
def dm9_token_cache(spark, sf):
    docs = A.table(spark, sf, "documents")
    key = F.substring(F.sha2("text", 256), 1, 16)
    rows = docs.groupBy(key.alias("cache_key")).agg(F.max(F.floor(F.char_length("text") / 4)).alias("token_count"), (F.lit(A.NOW) - (F.max("doc_id") % 3) * 50_000 + 86_400).alias("expires"))
    return C.live_cache(rows, A.NOW)


@query(f"""SELECT key AS cache_key, max(tokens) AS token_count, {A.NOW}::BIGINT AS created, ({A.NOW} + 86400)::BIGINT AS expires FROM (SELECT sha256(source) AS key, n_chars // 4 AS tokens FROM documents) GROUP BY 1
  UNION ALL SELECT 'old', 5, 1, 2""")
def dm9_put_cache(spark, sf):
    stored = spark.createDataFrame([("old", 5, 1, 2)], "cache_key string, token_count long, created long, expires long")
    return C.put_cache(stored, F.sha2("source", 256), F.floor(F.col("n_chars") / 4), A.table(spark, sf, "documents"), A.NOW)


@query(f"""WITH {A.FILES} SELECT id, CASE WHEN {ACTIVE} AND id % 7 = 0 THEN {A.NOW}::BIGINT ELSE to_be_cleaned END AS to_be_cleaned FROM files""")
def dm10_soft_delete(spark, sf):
    f = A.files(spark, sf)
    return C.soft_delete(f, f.where("id % 7 = 0"), A.NOW).select("id", F.col("to_be_cleaned").cast("long").alias("to_be_cleaned"))


@query(f"WITH {A.FILES} SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE to_be_cleaned END AS to_be_cleaned FROM files")
def dm11_restore(spark, sf):
    f = A.files(spark, sf)
    return C.restore(f, f.where("id % 2 = 0")).select("id", "to_be_cleaned")


@query(f"WITH {A.FILES} SELECT id, to_be_cleaned FROM files WHERE NOT coalesce(to_be_cleaned < {A.NOW} - 6 * 2592000, false)")
def dm12_retention(spark, sf):
    return C.purge(A.files(spark, sf), A.NOW).select("id", "to_be_cleaned")


@query(f"WITH {A.FILES} SELECT project_id, file_path, to_be_cleaned FROM files WHERE to_be_cleaned IS NOT NULL ORDER BY to_be_cleaned DESC, file_path")
def sl2_marked_files(spark, sf):
    return A.files(spark, sf).where("to_be_cleaned IS NOT NULL").select("project_id", "file_path", "to_be_cleaned").orderBy(F.col("to_be_cleaned").desc(), "file_path")


@query(f"""WITH {A.PROJECTS}, {A.FILES}, {A.OVERVIEWS} SELECT id FROM projects WHERE id NOT IN (SELECT project_id FROM files WHERE id % 3 <> 0 AND project_id > 'src5')
  AND id NOT IN (SELECT project_id FROM overviews)""")
def dm13_empty_projects(spark, sf):
    f = A.files(spark, sf).where("id % 3 <> 0 AND project_id > 'src5'")
    return C.empty_projects(A.projects(spark, sf), f, A.overviews(spark, sf)).select("id")


@query(f"""WITH {A.FILES} SELECT project_id, file_path FROM files WHERE {ACTIVE} AND id % 6 = 0""")
def dm14_missing_on_disk(spark, sf):
    f = A.files(spark, sf)
    return C.missing_files(f, f.where("id % 6 <> 0").select("project_id", "file_path")).select("project_id", "file_path")


@query(f"""WITH {A.FILES} SELECT 'moved' AS side, id FROM files WHERE project_id = 'src0' AND {ACTIVE} UNION ALL SELECT 'stays', id FROM files WHERE project_id <> 'src0'""")
def dm15_move_project(spark, sf):
    moved, rest = C.move_project(A.files(spark, sf), "src0")
    return moved.select(F.lit("moved").alias("side"), "id").unionByName(rest.select(F.lit("stays").alias("side"), "id"))


@query(f"""WITH {A.FILES}, chunks AS (SELECT id * 10 AS chunk_id, id AS file_id FROM files) SELECT chunk_id, file_id FROM chunks
  WHERE file_id IN (SELECT id FROM files WHERE NOT coalesce(to_be_cleaned < {A.NOW} - 6 * 2592000, false))""")
def dm18_cascade_chunks(spark, sf):
    f = A.files(spark, sf)
    chunks = f.select((F.col("id") * 10).alias("chunk_id"), F.col("id").alias("file_id"))
    return chunks.join(C.purge(f, A.NOW).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("chunk_id", "file_id")


@query(f"""WITH {A.FILES} SELECT f.id, CASE WHEN o.id IS NULL THEN NULL ELSE f.id + 3 END AS source_id FROM files f LEFT JOIN files o ON o.id = f.id + 3
  WHERE f.project_id IN (SELECT source FROM documents WHERE source < 'src5')""")
def jn4_orphans(spark, sf):
    f = A.files(spark, sf)
    valid = A.table(spark, sf, "documents").where("source < 'src5'").select(F.col("source").alias("project_id")).distinct()
    kept = f.join(valid, "project_id", "left_semi").withColumn("source_id", F.col("id") + 3)
    known = f.select(F.col("id").alias("source_id"), F.lit(True).alias("known"))
    return kept.join(known, "source_id", "left").select("id", F.when(F.col("known"), F.col("source_id")).alias("source_id"))


@query(f"WITH {A.FILES} SELECT project_id, file_path FROM files WHERE {ACTIVE} IS NOT TRUE OR id % 5 = 0")
def jn5_missing(spark, sf):
    f = A.files(spark, sf)
    return C.undescribed(f.select("project_id", "file_path"), f.where("id % 5 <> 0")).select("project_id", "file_path")


@query(f"""WITH {A.FILES} SELECT project_id, count(*) AS total, count(*) FILTER (WHERE {ACTIVE}) AS existing, count(*) FILTER (WHERE NOT ({ACTIVE})) AS missing, least(count(*) FILTER (WHERE NOT ({ACTIVE})), 3) AS returned
  FROM files GROUP BY project_id""")
def ag25_missing_summary(spark, sf):
    f = A.files(spark, sf)
    return C.missing_summary(f.select("project_id", "file_path"), f, 3)


@query(f"""WITH {A.PROJECTS}, requests AS (SELECT conv_id AS request, 'SRC' || (conv_id % 25) AS name, '/repo/src' || (conv_id % 7) AS folder FROM (SELECT DISTINCT conv_id FROM conversations)),
  scored AS (SELECT r.request, p.id, 2 + CASE WHEN list_contains(p.aliases, r.folder) THEN 1 ELSE 0 END AS score FROM requests r JOIN projects p ON lower(p.name) = lower(r.name))
  SELECT request, id, score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS k FROM scored) WHERE k = 1""")
def jn9_project_match(spark, sf):
    c = A.table(spark, sf, "conversations").select("conv_id").distinct()
    requests = c.select(F.col("conv_id").alias("request"), F.concat(F.lit("SRC"), (F.col("conv_id") % 25).cast("string")).alias("name"), F.concat(F.lit("/repo/src"), (F.col("conv_id") % 7).cast("string")).alias("folder"))
    return C.match_projects(A.projects(spark, sf), requests)


@query(f"""WITH {A.FILES}, named AS (SELECT DISTINCT project_id, string_split(file_path, '/')[-1] AS name FROM files WHERE {ACTIVE}),
  now AS (SELECT DISTINCT 'w' || (id % 4) AS folder, string_split(file_path, '/')[-1] AS name FROM files WHERE id % 3 <> 0), total AS (SELECT folder, count(*) AS total FROM now GROUP BY 1)
  SELECT folder, project_id, shared, total, shared / total AS similarity, shared / total >= 0.8 AS similar
  FROM (SELECT folder, project_id, count(*) AS shared FROM now JOIN named USING (name) GROUP BY 1, 2) JOIN total USING (folder)""")
def jn10_file_similarity(spark, sf):
    f = A.files(spark, sf)
    now = f.where("id % 3 <> 0").select(F.concat(F.lit("w"), (F.col("id") % 4).cast("string")).alias("folder"), base_name(F.col("file_path")).alias("name"))
    return C.file_similarity(f, now)


@query(f"WITH {A.PROJECTS} SELECT id FROM projects WHERE list_contains(aliases, '/repo/src9')")
def jn11_alias_lookup(spark, sf):
    return A.projects(spark, sf).where(F.array_contains("aliases", "/repo/src9")).select("id")


@query(f"""WITH {A.PROJECTS}, monitored AS (SELECT DISTINCT 'src' || (doc_id % 30) AS id FROM documents WHERE doc_id % 2 = 0), d AS (SELECT id FROM projects WHERE vector_mode)
  SELECT id, 'add' AS action FROM d WHERE id NOT IN (SELECT id FROM monitored) UNION ALL SELECT id, 'remove' FROM monitored WHERE id NOT IN (SELECT id FROM d)""")
def jn12_monitor_diff(spark, sf):
    monitored = A.table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("src"), (F.col("doc_id") % 30).cast("string")).alias("id")).distinct()
    return C.monitor_changes(A.projects(spark, sf).where("vector_mode"), monitored)


@query(f"""WITH {A.VERSIONS} SELECT project_id, file_path, id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY last_modified DESC, id DESC) AS k FROM versions) WHERE k = 1""")
def wn1_latest_version(spark, sf):
    return C.latest(A.versions(spark, sf), ["project_id", "file_path"], F.col("last_modified").desc(), F.col("id").desc()).select("project_id", "file_path", "id", "file_hash")


@query(f"""WITH {A.VERSIONS}, p AS (SELECT DISTINCT source AS id FROM documents WHERE source < 'src5'), v AS (SELECT *, 'src' || (id % 20) AS source_id FROM versions)
  SELECT project_id, file_path, v.id, s.id AS source_project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY last_modified DESC, id DESC) AS k FROM v WHERE project_id IN (SELECT id FROM p)) v
  LEFT JOIN p s ON s.id = v.source_id WHERE k = 1""")
def dm19_consolidate(spark, sf):
    projects = A.table(spark, sf, "documents").where("source < 'src5'").select(F.col("source").alias("id")).distinct()
    versions = A.versions(spark, sf).withColumn("source_project_id", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    return C.consolidate(versions, projects).select("project_id", "file_path", "id", "source_project_id")


@query("""SELECT source AS project_id, doc_id, n_chars // 4 AS total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars // 4 DESC, doc_id DESC) AS k FROM documents) WHERE k = 1""")
def wn2_best_overview(spark, sf):
    o = A.table(spark, sf, "documents").select(F.col("source").alias("project_id"), "doc_id", F.floor(F.col("n_chars") / 4).alias("total_tokens"))
    return C.latest(o, ["project_id"], F.col("total_tokens").desc(), F.col("doc_id").desc())


@query(f"""WITH {A.FILES} SELECT id, lower(replace('{NAMESPACE_PREFIX}' || project_id || ' x/' || id, ' ', '_')).replace('/', '_') AS namespace,
  sha256(file_path) AS path_hash, substr(sha256(project_id || ':' || file_hash), 1, 16) AS cache_key FROM files""")
def sf10_hashes_sf12_namespaces(spark, sf):
    name = F.concat("project_id", F.lit(" x/"), F.col("id").cast("string"))
    return A.files(spark, sf).select("id", namespace(name).alias("namespace"), F.sha2("file_path", 256).alias("path_hash"), F.substring(F.sha2(F.concat("project_id", F.lit(":"), "file_hash"), 256), 1, 16).alias("cache_key"))
