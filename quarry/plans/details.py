"""Smaller operators: strict writes, reports, zips, totals, and functions of requests and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import catalog as C
from quarry.plans.registry import query
from quarry.sources import adapters as A


@query(f"WITH {A.PROJECTS} SELECT id, name FROM projects UNION ALL SELECT 'new', 'New'")
def dm1_insert_project(spark, sf):
    p = A.projects(spark, sf).select("id", "name")
    return C.insert(p, spark.createDataFrame([("new", "New")], "id string, name string"), ["id"])


@query(f"WITH {A.PROJECTS} SELECT id, CASE WHEN id IN ('src1', 'src2') THEN 'Renamed ' || id ELSE name END AS name, CASE WHEN id = 'src2' THEN true ELSE vector_mode END AS vector_mode FROM projects")
def dm4_update_projects(spark, sf):
    changes = spark.createDataFrame([("src1", "Renamed src1", None), ("src2", "Renamed src2", True), ("none", "x", None)], "id string, name string, vector_mode boolean")
    return C.update(A.projects(spark, sf).select("id", "name", "vector_mode"), changes, "id")


META = f"{A.VECTORS}, meta AS (SELECT project_id, count(*) AS total_chunks, 'pending' AS sync_status FROM vectors GROUP BY 1)"


@query(f"WITH {META} SELECT project_id, total_chunks, CASE WHEN project_id = 'p1' THEN 'completed' ELSE sync_status END AS sync_status FROM meta")
def dm8_index_meta_update(spark, sf):
    meta = A.vectors(spark, sf).groupBy("project_id").agg(F.count("*").alias("total_chunks")).withColumn("sync_status", F.lit("pending"))
    done = spark.createDataFrame([("p1", "completed")], "project_id string, sync_status string")
    return C.update(meta, done, "project_id", strict=True)


@query(f"""WITH {A.FILES} SELECT project_id, count(*) AS files, sum(length(description) // 4)::BIGINT AS tokens, sha256(string_agg(file_path, chr(10) ORDER BY file_path)) AS dump_hash
  FROM files WHERE to_be_cleaned IS NULL GROUP BY 1""")
def dm25_dump(spark, sf):
    own = C.active(A.files(spark, sf))
    dump = F.array_join(F.array_sort(F.collect_list("file_path")), "\n")
    return own.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(X.token_estimate(F.col("description"))).alias("tokens"), F.sha2(dump, 256).alias("dump_hash"))


@query(f"""WITH {A.FILES}, new AS (SELECT 'src1' AS project_id, unnest(['a.py', 'en/b.py']) AS file_path, unnest(['alpha', 'beta gamma']) AS description)
  SELECT project_id, file_path, sha256(description) AS description_hash FROM files WHERE (project_id, file_path) NOT IN (SELECT project_id, file_path FROM new)
  UNION ALL SELECT project_id, file_path, sha256(description) FROM new UNION ALL SELECT 'src1', 'overview', '3/2'""")
def dm26_apply_updates(spark, sf):
    updates = spark.createDataFrame([("src1", {"a.py": "alpha", "en/b.py": "beta gamma"}, " one two\nthree ")], "project_id string, descriptions map<string,string>, overview string")
    own = A.overviews(spark, sf).withColumn("total_files", F.lit(0).cast("long"))
    files, overviews = C.apply_updates(A.files(spark, sf), own, updates, A.NOW)
    told = overviews.where("project_id = 'src1'").select("project_id", F.lit("overview").alias("file_path"), F.concat_ws("/", "total_tokens", "total_files").alias("description_hash"))
    return files.select("project_id", "file_path", F.sha2("description", 256).alias("description_hash")).unionByName(told)


@query("""WITH b AS (SELECT vec_id // 128 AS batch, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1), z AS (SELECT batch, ids, unnest(range(len(ids))) AS k FROM b)
  SELECT batch, k::INT AS chunk_index, ids[k + 1] AS vec_id, 'chunk' || (k + 1) AS chunk FROM z""")
def jn15_positional_zip(spark, sf):
    """Requests of up to 128 vectors, each vector beside the chunk in its place."""
    ids = A.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 128).alias("batch")).agg(F.array_sort(F.collect_list("vec_id")).alias("vectors"))
    named = ids.withColumn("chunks", F.transform("vectors", lambda v, k: F.concat(F.lit("chunk"), (k + 1).cast("string"))))
    both = named.where(F.size("vectors") == F.size("chunks")).select("batch", F.posexplode(F.arrays_zip("vectors", "chunks")).alias("chunk_index", "z"))
    return both.select("batch", "chunk_index", F.col("z.vectors").alias("vec_id"), F.col("z.chunks").alias("chunk"))


@query("""WITH b AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch, n_chars, doc_id FROM documents),
  s AS (SELECT source, batch, count(*) AS files, sum(n_chars) AS chars, bool_or(doc_id % 37 = 0) AS failed FROM b GROUP BY 1, 2)
  SELECT source, count(*) AS batches, sum(files)::BIGINT AS files, sum(chars)::BIGINT AS chars, coalesce(sum(CASE WHEN failed THEN files END), 0)::BIGINT AS failed_files FROM s GROUP BY 1""")
def ag22_batch_totals(spark, sf):
    from quarry.operators.batches import batch_totals, fixed_batches

    own = fixed_batches(A.table(spark, sf, "documents"), ["source"], 50, "doc_id").withColumn("failed", F.col("doc_id") % 37 == 0)
    return batch_totals(own, ["source"], "n_chars")


@query(f"WITH {A.VECTORS} SELECT id // 100 AS batch, count(*) AS chunks, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS kinds FROM vectors GROUP BY 1")
def ag28_batch_kinds(spark, sf):
    v = A.vectors(spark, sf)
    return v.groupBy(F.floor(F.col("id") / 100).alias("batch")).agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("kinds"))


@query(f"WITH {A.FILES} SELECT DISTINCT project_id, regexp_replace(file_path, '/?[^/]*$', '') AS folder FROM files ORDER BY project_id, folder")
def sl9_folder_order(spark, sf):
    return A.files(spark, sf).select("project_id", X.parent(F.col("file_path")).alias("folder")).distinct().orderBy("project_id", "folder")


@query(f"WITH {A.FILES} SELECT id, file_path FROM files ORDER BY md5(concat_ws('|', id, file_path, '0')) LIMIT 25")
def sl8_shuffled_files(spark, sf):
    return C.shuffled(A.files(spark, sf).select("id", "file_path"), 25)


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1)")
def st5_ordered_distinct(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query(f"WITH {A.VECTORS} SELECT id, (file_mtime + 1700000000)::DOUBLE AS seconds, strftime(make_timestamp((round((file_mtime + 1700000000) * 10) * 100000)::BIGINT), '%Y-%m-%dT%H:%M:%S') AS iso FROM vectors")
def sf21_mtime_iso(spark, sf):
    seconds = F.col("file_mtime").cast("double") + 1_700_000_000
    return A.vectors(spark, sf).select("id", seconds.alias("seconds"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id WHEN user_id % 3 = 1 THEN '10.1.0.' || user_id ELSE 'unknown' END AS ip, 0.5 * pow(2, event_id % 4) AS wait FROM events")
def sf29_client_ip_sf32_backoff(spark, sf):
    user, kind = F.col("user_id").cast("string"), F.col("user_id") % 3
    forwarded = F.when(kind == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 9.9.9.9"))).when(kind == 1, "")
    real = F.when(kind == 1, F.concat(F.lit("10.1.0."), user))
    ip = X.client_ip(forwarded, real, F.lit(None).cast("string"))
    return A.table(spark, sf, "events").select("event_id", ip.alias("ip"), X.backoff(F.lit(0.5), F.col("event_id") % 4 + 1).alias("wait"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'server' ELSE 'unknown' END AS failure FROM events")
def sf28_provider_errors(spark, sf):
    k = F.col("event_id") % 4
    status = F.when(k == 0, 401).when(k == 1, 429).when(k == 2, 503).otherwise(418)
    return A.table(spark, sf, "events").select("event_id", X.provider_error(status, F.lit("Something failed")).alias("failure"))


@query(f"WITH {A.FILES} SELECT id, file_path FROM files WHERE to_be_cleaned IS NULL AND last_modified >= {A.EPOCH} + 6000")
def pf19_changed_since(spark, sf):
    return C.active(A.files(spark, sf)).where(F.col("last_modified") >= A.EPOCH + 6000).select("id", "file_path")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '[REDACTED]' WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM conversations""")
def pf22_sanitised_arguments(spark, sf):
    name = F.when(F.col("turn") % 4 == 0, "api_key").otherwise("text")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", X.sanitised(name, F.col("text")).alias("shown"))


REQUESTS = ('{{"jsonrpc": "2.0", "method": "{m}", "id": {i}}}', '{{"jsonrpc": 2.0, "method": "{m}"}}', '{{"jsonrpc": "1.0", "method": "{m}"}}', '{{"jsonrpc": "2.0", "method": ""}}', '{{"jsonrpc": "2.0", "method": {i}}}', '["2.0", "{m}"]', '{{"jsonrpc": "2.0", "method": "{m}"', '{{"method": "{m}", "params": {{"jsonrpc": "2.0"}}, "jsonrpc": "2.0"}}')


@query("SELECT event_id, event_id % 8 IN (0, 7) AS valid FROM events")
def pf24_valid_requests(spark, sf):
    """A request for each event, in eight forms of which two are right."""
    forms = F.array(*(F.lit(r.replace("{{", "{").replace("}}", "}")) for r in REQUESTS))
    text = F.replace(F.replace(F.element_at(forms, (F.col("event_id") % 8 + 1).cast("int")), F.lit("{m}"), F.col("event_type")), F.lit("{i}"), F.col("event_id").cast("string"))
    return A.table(spark, sf, "events").select("event_id", X.valid_request(text).alias("valid"))


@query("""SELECT doc_id, sha256(translate(CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || '...' ELSE text END, chr(8) || chr(11) || chr(12) || chr(14) || chr(15), '')) AS input_hash FROM documents""")
def pf24_sanitised_input(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.sha2(X.sanitised_input(F.col("text")), 256).alias("input_hash"))
