"""Health, operations, requests, changes; the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import metrics as M
from quarry.plans.registry import query
from quarry.sources import adapters as A
from quarry.streaming import changes as S

LAST_GOOD = f"""{A.HEALTH}, good AS (SELECT monitor, max((ts, event_id)) FILTER (WHERE healthy) AS g FROM health GROUP BY 1),
  m AS (SELECT h.monitor, count(*) AS total, count(*) FILTER (WHERE healthy) AS healthy, count(*) FILTER (WHERE NOT healthy) AS failed, avg(ms) FILTER (WHERE healthy) AS avg_ms,
    count(*) FILTER (WHERE NOT healthy AND (g IS NULL OR (ts, event_id) > g)) AS consecutive FROM health h JOIN good USING (monitor) GROUP BY 1)"""


@query(f"WITH {LAST_GOOD} SELECT monitor, total, healthy, failed, round(avg_ms, 6) AS avg_ms, consecutive FROM m")
def ag11_health_metrics(spark, sf):
    return M.health_metrics(A.health(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"""WITH {LAST_GOOD}, s AS (SELECT monitor, greatest(0, least(100, 100 * healthy / total - least(10 * consecutive, 50) - least(20, greatest(0, (coalesce(avg_ms, 0) - 50) / 10)))) AS score FROM m)
  SELECT monitor, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS summary FROM s""")
def ag27_health_score(spark, sf):
    return M.health_score(M.health_metrics(A.health(spark, sf))).select("monitor", F.round("score", 6).alias("score"), "summary")


@query(f"""WITH {A.OPERATIONS} SELECT operation, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, round(sum(ms), 4) AS sum_ms, round(avg(ms), 6) AS avg_ms,
  min(ms) AS min_ms, max(ms) AS max_ms FROM ops GROUP BY 1""")
def ag12_operation_metrics(spark, sf):
    return M.operation_metrics(A.operations(spark, sf)).withColumn("sum_ms", F.round("sum_ms", 4)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"""WITH {A.OPERATIONS}, l AS (SELECT * FROM ops ORDER BY ts DESC, event_id DESC LIMIT 50), b AS (SELECT operation, count(*) AS locks, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR) AS last_hour FROM l GROUP BY 1)
  SELECT operation, locks, last_hour, (SELECT sum(locks) FROM b)::BIGINT AS total FROM b ORDER BY locks DESC, operation LIMIT 5""")
def ag13_lock_frequency(spark, sf):
    return M.lock_frequency(A.operations(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"))


@query(f"WITH {A.OPERATIONS} SELECT event_id, operation, CASE WHEN length(message) > 20 THEN substr(message, 1, 20) || '...' ELSE message END AS message FROM ops ORDER BY ts DESC, event_id DESC LIMIT 10")
def sf22_recent_locks(spark, sf):
    return M.recent_locks(A.operations(spark, sf), 10, 20)


@query(f"""WITH {A.REQUESTS}, l AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) AS k FROM requests), t AS (SELECT client, list_sort(list(seconds)) AS t FROM l WHERE k <= 1000 GROUP BY 1)
  SELECT client, count(*) AS requests, round(avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0 END), 6) AS error_rate, round(avg(seconds), 6) AS avg_seconds,
  any_value(t[least(floor(0.95 * len(t)) + 1, len(t))::INT]) AS p95, any_value(t[least(floor(0.99 * len(t)) + 1, len(t))::INT]) AS p99 FROM requests JOIN t USING (client) GROUP BY client""")
def ag14_http_percentiles(spark, sf):
    return M.request_metrics(A.requests(spark, sf)).withColumn("error_rate", F.round("error_rate", 6)).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(f"""WITH {A.OPERATIONS} SELECT count(*) AS operations, round_even(100 * avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 2) AS success_percent,
  round_even(100 * avg(CASE WHEN ok AND attempts > 1 THEN 1.0 ELSE 0 END), 2) AS retry_percent, round_even(avg(attempts), 2) AS avg_attempts FROM ops""")
def ag15_retry_stats(spark, sf):
    return M.retry_stats(A.operations(spark, sf))


CLASS = """CASE message WHEN 'database is locked' THEN 'DatabaseLockError' WHEN 'attempt to write a readonly database' THEN 'DatabaseLockError' WHEN 'database is busy' THEN 'DatabaseBusyError'
  WHEN 'cannot start a transaction within a transaction' THEN 'DatabaseBusyError' WHEN 'disk I/O error' THEN 'DatabaseConnectionError' WHEN 'no such table: t' THEN 'DatabaseSchemaError'
  WHEN 'UNIQUE constraint failed: t.id' THEN 'DatabaseIntegrityError' WHEN 'FOREIGN KEY constraint failed' THEN 'DatabaseIntegrityError' ELSE 'DatabaseError' END"""


@query(f"""WITH {A.OPERATIONS} SELECT {CLASS} AS error_class, {CLASS} IN ('DatabaseLockError', 'DatabaseBusyError', 'DatabaseConnectionError') AS retryable, count(*) AS errors FROM ops GROUP BY 1, 2""")
def ag16_error_classes(spark, sf):
    return M.error_stats(A.operations(spark, sf))


@query(f"WITH {A.OPERATIONS} SELECT message, count(*) AS errors FROM ops GROUP BY 1 ORDER BY errors DESC, message LIMIT 5")
def sl6_top_messages(spark, sf):
    return M.top_messages(A.operations(spark, sf))


@query(f"""WITH {A.OPERATIONS} SELECT DISTINCT message, CASE message WHEN 'database is locked' THEN 'read' WHEN 'attempt to write a readonly database' THEN 'write' WHEN 'database is busy' THEN 'connection'
  WHEN 'cannot start a transaction within a transaction' THEN 'transaction' WHEN 'UNIQUE constraint failed: t.id' THEN 'unique' WHEN 'FOREIGN KEY constraint failed' THEN 'foreign_key' ELSE '' END AS subtype FROM ops""")
def sf24_error_subtypes(spark, sf):
    return A.operations(spark, sf).select("message").distinct().select("message", X.error_subtype(F.col("message")).alias("subtype"))


@query(f"WITH {A.CHANGES} SELECT change_type, count(*) AS events FROM changes GROUP BY 1")
def ag17_change_stats(spark, sf):
    return S.count_by_type(S.classify(A.raw_changes(spark, sf)))


@query(f"WITH {A.CHANGES} SELECT event_id, path, change_type FROM changes WHERE change_type IN ('created', 'deleted') AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100")
def pf18_recent_changes(spark, sf):
    c = S.code_changes(S.classify(A.raw_changes(spark, sf))).where("change_type IN ('created', 'deleted') AND ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return c.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "path", "change_type")


@query(f"WITH {A.CHANGES} SELECT path FROM changes UNION SELECT dest FROM changes WHERE change_type = 'moved'")
def st3_changed_paths(spark, sf):
    c = S.classify(A.raw_changes(spark, sf))
    return c.select("path").union(c.where("change_type = 'moved'").select("dest")).distinct()


@query(f"WITH {A.REQUESTS} SELECT count(DISTINCT client) AS active_clients, count(*) AS requests_in_window FROM requests WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 DAY")
def ag23_rate_limit_active(spark, sf):
    return M.rate_window(A.requests(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"), 86_400)


@query(f"""WITH {A.HEALTH}, l AS (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY ts DESC, event_id DESC) AS r FROM health)
  SELECT monitor, count(*) AS checks, count(*) FILTER (WHERE NOT healthy) AS failed, round(avg(ms) FILTER (WHERE healthy), 6) AS avg_ms, coalesce(min(r) FILTER (WHERE healthy), count(*) + 1) - 1 AS consecutive,
  arg_min(event_id, r) AS last_event FROM l WHERE r <= 100 GROUP BY 1""")
def ss14_health_history(spark, sf):
    return M.health_history(A.health(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {A.HEALTH} SELECT monitor, event_id, recency::INT AS recency FROM (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY ts DESC, event_id DESC) AS recency FROM health) WHERE recency <= 5")
def wn5_last_n(spark, sf):
    return M.last_n(A.health(spark, sf), ["monitor"], 5, "ts", "event_id").select("monitor", "event_id", "recency")


@query(f"""WITH {A.HEALTH}, l AS (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY ts DESC, event_id DESC) AS r FROM health), e AS (SELECT monitor, count(*) AS n, count(*) FILTER (WHERE healthy) AS good,
  arg_max(ms, r) FILTER (WHERE healthy) AS a, arg_min(ms, r) FILTER (WHERE healthy) AS b FROM l WHERE r <= 5 GROUP BY 1)
  SELECT monitor, CASE WHEN n < 5 OR good < 2 THEN 'insufficient_data' WHEN b > 1.5 * a THEN 'degrading' WHEN b < 0.7 * a THEN 'improving' ELSE 'stable' END AS trend FROM e""")
def wn6_trend(spark, sf):
    return M.trend(A.health(spark, sf))


@query(f"""WITH {A.HEALTH}, i AS (SELECT *, sum(healthy::INT) OVER (PARTITION BY monitor ORDER BY ts, event_id) AS island FROM health)
  SELECT monitor, event_id, sum((NOT healthy)::INT) OVER (PARTITION BY monitor, island ORDER BY ts, event_id)::BIGINT AS in_a_row FROM i""")
def wn7_consecutive_failures(spark, sf):
    return M.consecutive_failures(A.health(spark, sf)).select("monitor", "event_id", "in_a_row")


@query("SELECT event_id, CASE WHEN value / 1000 < 0.1 THEN 'fast' WHEN value / 1000 < 1 THEN 'normal' WHEN value / 1000 < 5 THEN 'slow' ELSE 'very_slow' END AS speed FROM events")
def sf23_perf_class(spark, sf):
    return A.table(spark, sf, "events").select("event_id", X.speed(F.col("value") / 1000).alias("speed"))


@query(f"""WITH RECURSIVE {A.CHANGES}, o AS (SELECT path, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM raw_changes),
  w AS (SELECT path, k, event_id, t AS last, true AS took FROM o WHERE k = 1
    UNION ALL SELECT o.path, o.k, o.event_id, CASE WHEN o.t - w.last >= 3600000000 THEN o.t ELSE w.last END, o.t - w.last >= 3600000000 FROM w JOIN o ON o.path = w.path AND o.k = w.k + 1)
  SELECT path, event_id FROM w WHERE took""")
def ss1_leading_debounce(spark, sf):
    return M.debounced(A.raw_changes(spark, sf), 3600)


@query(f"""WITH {A.CHANGES}, f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS fresh FROM raw_changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS session FROM f)
  SELECT path, session::BIGINT AS session, count(*) AS events, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY 1, 2""")
def ss2_trailing_debounce(spark, sf):
    return M.settled(A.raw_changes(spark, sf), 7200)


@query(f"""WITH RECURSIVE {A.REQUESTS}, o AS (SELECT client, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS k FROM requests),
  w AS (SELECT client, k, event_id, [t] AS taken, true AS ok FROM o WHERE k = 1
    UNION ALL SELECT client, k, event_id, CASE WHEN len(still) < 5 THEN list_append(still, t) ELSE still END, len(still) < 5
      FROM (SELECT o.client, o.k, o.event_id, o.t, list_filter(w.taken, lambda x: x > o.t - 86400000000) AS still FROM w JOIN o ON o.client = w.client AND o.k = w.k + 1))
  SELECT client, count(*) AS requests, count(*) FILTER (WHERE ok) AS accepted, max(event_id) FILTER (WHERE ok) AS last_accepted FROM w GROUP BY 1""")
def ss10_rate_limit(spark, sf):
    return M.rate_limited(A.requests(spark, sf), 5, 86_400)


@query(f"""WITH {A.CHANGES}, last AS (SELECT path, arg_max(change_type, (ts, event_id)) AS change_type FROM changes GROUP BY 1) SELECT path, change_type FROM last WHERE change_type <> 'deleted'""")
def ss7_latest_change_per_file(spark, sf):
    c = S.classify(A.raw_changes(spark, sf)).groupBy("path").agg(F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"))
    return c.where("change_type <> 'deleted'")
