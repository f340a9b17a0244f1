"""The driver's tables as a catalogue of projects, files, vectors and events.

Each adapter is written twice, as a DataFrame and as the SQL of a common table expression, so that a query and the SQL it
is compared with start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed clock: the first soft delete, and the present.
EPOCH, DAY = 1_700_000_000, 86_400
NOW = EPOCH + 500 * DAY
EXTENSIONS = ("py", "js", "ts", "md", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, aliases, vector_mode: a project per source."""
    source = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("id")).distinct()
    number = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    return source.select("id", F.initcap("id").alias("name"), F.array(F.concat(F.lit("/repo/"), "id")).alias("aliases"), (number % 2 == 0).alias("vector_mode"))


PROJECTS = """projects AS (SELECT source AS id, upper(left(source, 1)) || lower(substr(source, 2)) AS name, ['/repo/' || source] AS aliases,
  CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AS vector_mode FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"""


def _path():
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("n_chars") < 2000, "small").otherwise("large")
    return F.concat("lang", F.lit("/"), folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), extension)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path, content: a file per document, where it has a path. No label bears on it, so that no text meets a join."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _path().alias("file_path"), F.col("text").alias("content")).where("file_path IS NOT NULL")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, file_path, description, file_hash, version, to_be_cleaned, last_modified: a file per document."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("project_id"), _path().alias("file_path"), F.col("text").alias("description"),
        F.sha2("text", 256).alias("file_hash"), F.lit(1).cast("long").alias("version"),
        F.when(F.col("toxic") == 1, F.lit(EPOCH) + F.col("doc_id") * DAY).alias("to_be_cleaned"), (F.lit(EPOCH) + F.col("doc_id") * 60).alias("last_modified"),
    )


FILES = f"""files AS (SELECT d.doc_id AS id, d.source AS project_id,
  d.lang || '/' || CASE WHEN d.n_chars < 2000 THEN 'small' ELSE 'large' END || '/doc_' || d.doc_id || '.' || (['py', 'js', 'ts', 'md', 'txt'])[d.doc_id % 5 + 1] AS file_path,
  d.text AS description, sha256(d.text) AS file_hash, 1::BIGINT AS version,
  CASE WHEN l.toxic = 1 THEN {EPOCH} + d.doc_id * {DAY} END AS to_be_cleaned, {EPOCH} + d.doc_id * 60 AS last_modified
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, overview, total_tokens: of each project the longest text, the smallest id among equals. Every fourth
    project has none."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    best = docs.where(number % 4 != 3).groupBy(F.col("source").alias("project_id")).agg(F.max_by("text", F.struct("n_chars", -F.col("doc_id"))).alias("overview"))
    return best.withColumn("total_tokens", F.floor(F.char_length("overview") / 4))


OVERVIEWS = """overviews AS (SELECT source AS project_id, text AS overview, length(text) // 4 AS total_tokens FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE source IS NOT NULL AND CAST(regexp_extract(source, '[0-9]+') AS INT) % 4 <> 3) WHERE k = 1)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share paths: project and id modulo 7, as before branches were merged."""
    f = files(spark, sf_dir)
    return f.select("id", "project_id", F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".py")).alias("file_path"), "file_hash", "last_modified")


VERSIONS = f"{FILES}, versions AS (SELECT id, project_id, 'f' || (id % 7) || '.py' AS file_path, file_hash, last_modified FROM files)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, file_path, content_hash, file_mtime, vector, chunk_type: a row per embedding."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"), F.concat(F.lit("src/f"), (v % 20).cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("h"), (v % 50).cast("string")).alias("content_hash"), (v / 10.0).cast("string").alias("file_mtime"),
        F.col("embedding").cast("array<double>").alias("vector"), F.when(v % 3 == 0, "function").when(v % 3 == 1, "class").otherwise("generic").alias("chunk_type"),
    )


VECTORS = """vectors AS (SELECT vec_id AS id, 'p' || label AS project_id, 'src/f' || (vec_id % 20) || '.py' AS file_path, 'h' || (vec_id % 50) AS content_hash,
  vec_id / 10.0 AS file_mtime, embedding::DOUBLE[] AS vector, CASE vec_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'generic' END AS chunk_type FROM embeddings)"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """monitor, ts, event_id, healthy, ms: health checks."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor"), "ts", "event_id", (F.col("event_type") != "error").alias("healthy"), F.col("value").alias("ms"))


HEALTH = "health AS (SELECT user_id AS monitor, ts, event_id, event_type <> 'error' AS healthy, value AS ms FROM events)"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """operation, ts, event_id, ok, ms, attempts, message: a log of operations."""
    kinds = F.array(*map(F.lit, MESSAGES))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"),
        (F.col("event_id") % 5 + 1).alias("attempts"), F.element_at(kinds, (F.col("event_id") % len(MESSAGES) + 1).cast("int")).alias("message"),
    )


MESSAGES = (
    "database is locked", "database is busy", "UNIQUE constraint failed: t.id", "no such table: t", "disk I/O error", "attempt to write a readonly database",
    "cannot start a transaction within a transaction", "FOREIGN KEY constraint failed", "something else",
)
OPERATIONS = f"""ops AS (SELECT event_type AS operation, ts, event_id, event_type <> 'error' AS ok, value AS ms, event_id % 5 + 1 AS attempts,
  ({list(MESSAGES)!r})[event_id % {len(MESSAGES)} + 1] AS message FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, ts, event_id, status, seconds: HTTP requests."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"), "ts", "event_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 1000).alias("seconds")
    )


REQUESTS = "requests AS (SELECT 'c' || user_id AS client, ts, event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 1000 AS seconds FROM events)"


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, event, ts, event_id: file events under the names that watchers use."""
    return change_rows(table(spark, sf_dir, "events"))


def change_rows(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "view", "created").when(kind == "click", "modified").when(kind == "error", "deleted").when(kind == "purchase", "moved").otherwise(kind)
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/f"), (F.col("event_id") % 13).cast("string"), F.lit(".py"))
    return events.select(path.alias("path"), event.alias("event"), "ts", "event_id", F.concat(path, F.lit(".new")).alias("dest"))


CHANGES = """raw_changes AS (SELECT 'u' || user_id || '/f' || (event_id % 13) || '.py' AS path,
  CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'modified' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE event_type END AS event, ts, event_id,
  'u' || user_id || '/f' || (event_id % 13) || '.py.new' AS dest FROM events),
 changes AS (SELECT path, CASE WHEN event IN ('created', 'added') THEN 'created' WHEN event IN ('modified', 'changed') THEN 'modified' WHEN event IN ('deleted', 'removed') THEN 'deleted'
  WHEN event IN ('moved', 'renamed') THEN 'moved' END AS change_type, ts, event_id, dest FROM raw_changes WHERE event IN ('created', 'added', 'modified', 'changed', 'deleted', 'removed', 'moved', 'renamed'))"""


PYTHON = 'import os\n\n\ndef f_{id}():\n    """{text}\n    """\n    return 1\n\n\nclass C{id}:\n    def m(self):\n        return 2\n'
JAVASCRIPT = "import a from 'a';\n\nexport function f_{id}(x) {\n  const t = `{text}`;\n  return t;\n}\n\nclass C{id} {\n  m(x) {\n    return 2;\n  }\n}\n"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path, description: a program around each document, which is a string of it; Python and JavaScript in turn."""
    f = files(spark, sf_dir).where("description IS NOT NULL")
    inside = F.translate("description", '"`$\\\\', "")

    def program(form: str):
        return F.replace(F.replace(F.lit(form), F.lit("{text}"), inside), F.lit("{id}"), F.col("id").cast("string"))

    even = F.col("id") % 2 == 0
    path = F.concat(F.lit("src/f"), F.col("id").cast("string"), F.when(even, ".py").otherwise(".js"))
    return f.where("description not like '%{id}%'").select("id", path.alias("file_path"), F.when(even, program(PYTHON)).otherwise(program(JAVASCRIPT)).alias("description"))


#: Where the parts of these programs stand: k is how many line ends the document has.
CODE = f"""{FILES}, code AS (SELECT id, 'src/f' || id || CASE WHEN id % 2 = 0 THEN '.py' ELSE '.js' END AS file_path, length(description) - length(replace(description, chr(10), '')) AS k, id % 2 = 0 AS py
  FROM files WHERE description IS NOT NULL AND description NOT LIKE '%{{id}}%'),
 parts AS (SELECT id, file_path, 'import' AS chunk_type, 'imports' AS name, 1 AS start_line, 1 AS end_line FROM code
  UNION ALL SELECT id, file_path, 'function', 'f_' || id, CASE WHEN py THEN 4 ELSE 3 END, k + CASE WHEN py THEN 7 ELSE 6 END FROM code
  UNION ALL SELECT id, file_path, 'class', 'C' || id, k + CASE WHEN py THEN 10 ELSE 8 END, k + 12 FROM code
  UNION ALL SELECT id, file_path, 'method', 'C' || id || '.m', k + CASE WHEN py THEN 11 ELSE 9 END, k + CASE WHEN py THEN 12 ELSE 11 END FROM code)"""


def commit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, file_path, old, new: commits of up to a hundred files of a project, some of which come, go or get a line."""
    f = files(spark, sf_dir).where("project_id IS NOT NULL AND file_path IS NOT NULL AND description IS NOT NULL")
    commit = F.concat("project_id", F.lit("-"), F.floor(F.col("id") / 100).cast("string"))
    old = F.when(F.col("id") % 5 != 0, F.col("description"))
    new = F.when(F.col("id") % 5 == 0, F.col("description")).when(F.col("id") % 5 != 1, F.concat("description", F.lit("\nadded by the commit")))
    return f.select(commit.alias("commit"), "file_path", old.alias("old"), new.alias("new"))


def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, message."""
    counts = commit_versions(spark, sf_dir).groupBy("commit").agg(F.count("*").alias("n"))
    return counts.select("commit", F.concat(F.lit("Update "), F.col("n").cast("string"), F.lit(" files")).alias("message"))


def _lines(sign: str, lines: str) -> str:
    return f"array_to_string(list_transform({lines}, lambda x: '{sign}' || x), chr(10))"


def _span(start: str, n: str) -> str:
    return f"{start} || CASE WHEN {n} = 1 THEN '' ELSE ',' || {n} END"


DIFFS = f"""{FILES}, versions AS (SELECT id, project_id || '-' || (id // 100) AS commit, file_path AS p, string_split(description, chr(10)) AS l, len(string_split(description, chr(10))) AS n
  FROM files WHERE project_id IS NOT NULL AND file_path IS NOT NULL AND description IS NOT NULL),
 sections AS (SELECT commit, p, 'diff --git a/' || p || ' b/' || p || chr(10) || CASE WHEN id % 5 = 0 THEN '--- /dev/null' || chr(10) || '+++ b/' || p || chr(10) || '@@ -0,0 +' || {_span("1", "n")} || ' @@' || chr(10) || {_lines("+", "l")}
   WHEN id % 5 = 1 THEN '--- a/' || p || chr(10) || '+++ /dev/null' || chr(10) || '@@ -' || {_span("1", "n")} || ' +0,0 @@' || chr(10) || {_lines("-", "l")}
   ELSE '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) || '@@ -' || {_span("(n - least(3, n) + 1)", "least(3, n)")} || ' +' || {_span("(n - least(3, n) + 1)", "(least(3, n) + 1)")} || ' @@' || chr(10)
     || {_lines(" ", "l[n - least(3, n) + 1 : n]")} || chr(10) || '+added by the commit' END AS diff FROM versions),
 diffs AS (SELECT commit, 'Update ' || count(*) || ' files' AS message, string_agg(diff, chr(10) ORDER BY p) AS diff FROM sections GROUP BY commit)"""
