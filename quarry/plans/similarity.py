"""Vectors: replacement, neighbours, thresholds, incremental listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import NAMESPACE_PREFIX, namespace
from quarry.operators import catalog as C
from quarry.operators import vectors as V
from quarry.operators.neighbours import VectorLists
from quarry.plans.registry import query
from quarry.sources import adapters as A
from quarry.sources.shared import shared_folder, snapshot

LENGTH = "sqrt(list_dot_product(vector, vector))"
COSINE = "list_dot_product(v.vector, q.vector) / (sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(q.vector, q.vector)))"


def _asked(spark, sf, number: int) -> list[float]:
    return A.vectors(spark, sf).where(F.col("id") == number).select("vector").first()[0]


@query(f"WITH {A.VECTORS}, q AS (SELECT vector FROM vectors WHERE id = 7) SELECT v.id, v.file_path, round({COSINE}, 6) AS similarity FROM vectors v, q WHERE v.project_id <> 'p3' ORDER BY {COSINE} DESC, v.id LIMIT 10")
def jn13_knn_topk(spark, sf):
    near = V.nearest(A.vectors(spark, sf), _asked(spark, sf, 7), 10, F.col("project_id") != "p3")
    return near.select("id", "file_path", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTORS}, q AS (SELECT vector FROM vectors WHERE id = 11) SELECT v.id, round({COSINE}, 6) AS similarity FROM vectors v, q WHERE {COSINE} >= 0.3 AND v.chunk_type IN ('function', 'class')")
def pf13_threshold(spark, sf):
    q = F.array(*map(F.lit, _asked(spark, sf, 11)))
    sims = A.vectors(spark, sf).where(F.col("chunk_type").isin("function", "class")).withColumn("similarity", V.cosine(F.col("vector"), q))
    return sims.where("similarity >= 0.3").select("id", F.round("similarity", 6).alias("similarity"))


MANY = f"""{A.VECTORS}, q AS (SELECT id AS query_id, vector FROM vectors WHERE id % 20 = 0), s AS (SELECT q.query_id, v.id, v.file_path, v.content_hash, {COSINE} AS similarity FROM vectors v, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)"""


def stored_lists(spark, sf) -> VectorLists:
    """The vectors' lists. They are made once for each state of the table."""
    lists = VectorLists(spark, f"{shared_folder(spark)}/quarry-lists-{snapshot(spark, f'{sf}/embeddings.parquet')}")
    return lists.open() if lists.ready() else lists.build(A.vectors(spark, sf))


def _many(spark, sf, k: int):
    return stored_lists(spark, sf).nearest_many(A.vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), k)


@query(f"WITH {MANY} SELECT query_id, rank::INT AS rank, id, round(similarity, 6) AS similarity FROM r WHERE rank <= 8")
def sl7_multi_query_knn(spark, sf):
    return _many(spark, sf, 8).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {MANY}, h AS (SELECT * FROM r WHERE rank <= 40 AND similarity >= 0.2) SELECT id, file_path, content_hash, round(similarity, 6) AS similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY file_path, content_hash ORDER BY round(similarity, 9) DESC, id) AS k FROM h) WHERE k = 1 ORDER BY round(similarity, 9) DESC, id LIMIT 20""")
def wn4_similar_dedup(spark, sf):
    hits = _many(spark, sf, 40).join(A.vectors(spark, sf).select("id", "file_path", "content_hash"), "id")
    return V.similar(hits, 0.2, 20).select("id", "file_path", "content_hash", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTORS} SELECT project_id, file_path, max(file_mtime::DOUBLE) AS mtime FROM vectors GROUP BY 1, 2")
def ag7_latest_mtime(spark, sf):
    return V.latest_mtimes(A.vectors(spark, sf))


@query(f"""WITH {A.VECTORS}, new AS (SELECT id + 5000000 AS id, project_id, file_path, 'fresh' AS content_hash FROM vectors WHERE id % 40 = 1)
  SELECT id, project_id, file_path, content_hash FROM vectors WHERE (project_id, file_path) NOT IN (SELECT project_id, file_path FROM new) UNION ALL SELECT * FROM new""")
def dm21_replace_vectors(spark, sf):
    v = A.vectors(spark, sf).select("id", "project_id", "file_path", "content_hash")
    new = v.where("id % 40 = 1").select((F.col("id") + 5_000_000).alias("id"), "project_id", "file_path", F.lit("fresh").alias("content_hash"))
    return V.replace_by_file(v, new)


@query(f"""WITH {A.VECTORS} SELECT id, content_hash, NULL AS model FROM vectors WHERE id % 25 <> 3 UNION ALL SELECT id, 'fresh', 'm' || (id % 2) FROM vectors WHERE id % 25 = 3
  UNION ALL SELECT id + 7000000, 'fresh', 'm' || (id % 2) FROM vectors WHERE id % 50 = 3""")
def dm20_upsert_vectors(spark, sf):
    v = A.vectors(spark, sf).select("id", "content_hash")
    fresh = v.where("id % 25 = 3").union(v.where("id % 50 = 3").select(F.col("id") + 7_000_000, "content_hash"))
    return V.upsert_vectors(v, fresh.select("id", F.lit("fresh").alias("content_hash"), F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model")))


@query(f"WITH {A.VECTORS} SELECT id, project_id FROM vectors WHERE lower('{NAMESPACE_PREFIX}' || project_id) <> '{NAMESPACE_PREFIX}p1'")
def dm23_drop_namespace(spark, sf):
    return V.drop_namespace(A.vectors(spark, sf), f"{NAMESPACE_PREFIX}p1").select("id", "project_id")


@query(f"WITH {A.VECTORS} SELECT id FROM vectors WHERE (project_id, file_path) NOT IN (SELECT project_id, file_path FROM vectors WHERE id % 30 = 2)")
def dm22_delete_vectors(spark, sf):
    v = A.vectors(spark, sf)
    return V.delete_files(v, v.where("id % 30 = 2")).select("id")


@query(f"WITH {A.VECTORS} SELECT lower(replace('{NAMESPACE_PREFIX}' || project_id, ' ', '_')) AS namespace, count(*) AS vectors FROM vectors GROUP BY 1")
def dm23_namespaces(spark, sf):
    return A.vectors(spark, sf).groupBy(namespace(F.col("project_id")).alias("namespace")).agg(F.count("*").alias("vectors"))


@query(f"WITH {A.VECTORS} SELECT DISTINCT project_id, file_path FROM vectors WHERE (project_id, file_path) NOT IN (SELECT project_id, file_path FROM vectors WHERE id % 3 = 0)")
def jn7_vanished(spark, sf):
    v = A.vectors(spark, sf)
    return V.vanished(v, v.where("id % 3 = 0").select("project_id", "file_path").distinct())


@query(f"""WITH {A.VECTORS}, stored AS (SELECT project_id || '/' || file_path AS file_path, max(file_mtime::DOUBLE) AS mtime FROM vectors WHERE id % 7 <> 0 GROUP BY 1),
  now AS (SELECT project_id || '/' || file_path AS file_path, max(file_mtime::DOUBLE) + CASE WHEN max(id) % 2 = 0 THEN 0.0005 ELSE 0.5 END AS mtime FROM vectors GROUP BY 1)
  SELECT now.file_path, round(now.mtime, 4) AS mtime FROM now LEFT JOIN stored USING (file_path) WHERE abs(now.mtime - coalesce(stored.mtime, 0)) > 0.001""")
def jn8_incremental(spark, sf):
    v = A.vectors(spark, sf).withColumn("file_path", F.concat("project_id", F.lit("/"), "file_path")).withColumn("t", F.col("file_mtime").cast("double"))
    stored = v.where("id % 7 <> 0").groupBy("file_path").agg(F.max("t").alias("mtime"))
    now = v.groupBy("file_path").agg((F.max("t") + F.when(F.max("id") % 2 == 0, 0.0005).otherwise(0.5)).alias("mtime"))
    return C.changed_files(now, stored).select("file_path", F.round("mtime", 4).alias("mtime"))


@query("SELECT sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) / 1000 * 0.00013, 6) AS cost FROM documents")
def ag24_embedding_cost(spark, sf):
    return V.embedding_cost(A.table(spark, sf, "documents"), "text")


@query("""WITH b AS (SELECT vec_id // 128 AS batch, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1), k AS (SELECT batch, ids, unnest(range((len(ids) + 2) // 3)) AS k FROM b)
  SELECT batch::BIGINT AS batch, 'f' || k AS file_path, array_to_string(ids[k * 3 + 1 : k * 3 + 3], ',') AS ids FROM k""")
def jn16_regroup(spark, sf):
    """Requests of up to 128 vectors; each three of a request are a file's, the last file may have fewer."""
    flat = A.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 128).alias("batch")).agg(F.array_sort(F.collect_list("vec_id")).alias("vectors"))
    k = F.explode(F.sequence(F.lit(0), F.floor((F.size("vectors") - 1) / 3).cast("int")))
    bounds = flat.select("batch", k.alias("k")).select("batch", F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_path"), (F.col("k") * 3).alias("start"), (F.col("k") * 3 + 3).alias("end"))
    return V.regroup(flat, bounds).select("batch", "file_path", F.array_join(F.transform("vectors", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def tx6_find_similar_code(spark, sf):
    """Files chunked, embedded by the local stand-in, and the chunks most like one of them."""
    from quarry.operators.chunking import chunk_files

    chunks = V.embed(chunk_files(A.files(spark, sf)), 64).withColumn("id", F.xxhash64("file_path", "chunk_index"))
    asked = chunks.where("chunk_index = 0").orderBy("file_path").select("vector").first()[0]
    hits = V.nearest(chunks, asked, 40).withColumn("query_id", F.lit(0).cast("long"))
    return V.similar(hits, None, 20).select("file_path", "start_line", "end_line", F.round("similarity", 6).alias("similarity"))
