"""Contents of files: lines, chunks, secrets, markup, batches, commits and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import batches as B
from quarry.operators import chunking as K
from quarry.operators import diffs as D
from quarry.operators import syntax
from quarry.plans.registry import query
from quarry.sources import adapters as A


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS section FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def sc13_line_section(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.line_section(F.col("text"), 2, 4).alias("section")).where("section IS NOT NULL")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE trim(text) <> ''")
def sc12_text_files(spark, sf):
    return A.table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", F.char_length("text").cast("long").alias("chars"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
  w AS (SELECT doc_id, a, 0 AS i, 1 AS first, 0 AS n, false AS closed, 0 AS cf, 0 AS cl FROM l
    UNION ALL SELECT doc_id, a, i + 1, CASE WHEN e THEN i + 2 ELSE first END, CASE WHEN e THEN 0 ELSE n + 1 END, e OR i + 1 = len(a), first, i + 1
      FROM (SELECT *, (regexp_replace(a[i + 1], '\\s+', '', 'g') = '' AND n + 1 > 5) OR n + 1 >= 50 AS e FROM w WHERE i < len(a))),
  c AS (SELECT doc_id, cf AS start_line, cl AS end_line, array_to_string(a[cf:cl], chr(10)) AS content FROM w WHERE closed)
  SELECT doc_id, start_line, end_line, sha256(content) AS content_hash FROM c WHERE regexp_replace(content, '\\s+', '', 'g') <> ''""")
def tx1_line_chunks(spark, sf):
    chunks = A.table(spark, sf, "documents").select("doc_id", F.inline(K.line_chunks(F.col("text"))))
    return chunks.select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


SECRET = r"(?i)token = \"[0-9a-f]{40}\""


@query("""SELECT doc_id, sha256(regexp_replace(text, '(?i)token = "[0-9a-f]{40}"', rpad('[REDACTED:SECRET]', 50, 'X'), 'g')) AS redacted_hash, len(regexp_extract_all(text, '(?i)token = "[0-9a-f]{40}"')) AS hits
  FROM documents WHERE regexp_matches(text, '(?i)token = "[0-9a-f]{40}"')""")
def tx2_redact_env_secret(spark, sf):
    docs = A.table(spark, sf, "documents").where(F.col("text").rlike(SECRET))
    mark = X.redaction_marker("secret", F.lit("x" * 50))
    hits = F.regexp_count("text", F.lit(SECRET)).cast("long")
    return docs.select("doc_id", F.sha2(F.regexp_replace("text", F.lit(SECRET), mark), 256).alias("redacted_hash"), hits.alias("hits"))


@query()
def tx2_redact_full(spark, sf):
    out = K.redact_files(A.files(spark, sf))
    return out.select("id", F.sha2("redacted", 256).alias("redacted_hash"), "redactions", F.array_join("names", ",").alias("names"), "high_confidence")


@query()
def tx3_optimize(spark, sf):
    return K.chunk_files(A.files(spark, sf)).drop("content")


@query()
def ag8_redaction_stats(spark, sf):
    names = K.redact_files(A.files(spark, sf)).select(F.explode("names").alias("name"))
    return names.join(F.broadcast(K.pattern_table(spark)), "name").groupBy("type", "name").agg(F.count("*").alias("redactions"), F.count(F.when(F.col("confidence") >= 0.8, 1)).alias("high_confidence"))


def _pattern_sql(patterns) -> str:
    quoted = lambda t: t.replace("'", "''")
    parts = [f"SELECT '{n}' AS name, '{k}' AS type, count(*) FILTER (WHERE regexp_matches(description, '{quoted(p)}', '{'c' if k == 'private_key' else 'i'}')) AS files FROM files" for n, k, _, _, p in patterns]
    return f"{A.FILES}, f AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {_pattern_sql(K.PATTERNS)} SELECT type, count(*) AS patterns, sum(files)::BIGINT AS files FROM f GROUP BY type")
def ag9_pattern_summary(spark, sf):
    return K.pattern_files(A.files(spark, sf)).groupBy("type").agg(F.count("*").alias("patterns"), F.sum("files").alias("files"))


@query(f"WITH {_pattern_sql([p for p in K.PATTERNS if p[2] >= 0.6 and p[3]])} SELECT name, files FROM f")
def pf20_pattern_subset(spark, sf):
    return K.pattern_files(A.files(spark, sf)).where("confidence >= 0.6 AND context").select("name", "files")


@query(f"WITH {A.CODE} SELECT id, file_path, chunk_type, name, start_line::INT AS start_line, end_line::INT AS end_line FROM parts")
def tx4b_syntax_chunks(spark, sf):
    return K.cut_files(A.code_files(spark, sf), syntax.HANDLERS).drop("content")


@query(f"WITH {A.CODE} SELECT CASE WHEN ends_with(file_path, '.py') THEN 'python' ELSE 'javascript' END AS language, chunk_type, count(*) AS chunks, count(DISTINCT id) AS files FROM parts GROUP BY 1, 2")
def ag10_chunk_kinds(spark, sf):
    return K.chunk_kinds(K.cut_files(A.code_files(spark, sf), syntax.HANDLERS))


@query()
def ag10_chunk_stats(spark, sf):
    return K.chunk_stats(K.chunk_files(A.files(spark, sf)))


@query(f"""WITH {A.FILES} SELECT id, NOT (regexp_matches(file_path, '\\.(md|txt)$') OR regexp_matches(string_split(file_path, '/')[-1], 'test|spec|mock')) AS redacts FROM files""")
def pf17_needs_redaction(spark, sf):
    return A.files(spark, sf).select("id", K.needs_redaction(F.col("file_path")).alias("redacts"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&')) AS text_hash FROM pages""")
def sf6_html_decode(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.sha2(X.unescape_html(F.col("html"), closed=True), 256).alias("text_hash"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def sf7_parse_json(spark, sf):
    parsed = B.parse_json(F.replace("props", F.lit('"k"'), F.lit("k")))
    return A.table(spark, sf, "events").select("event_id", F.element_at(parsed, "k").cast("long").alias("k"))


@query("SELECT event_id AS id, '{\"k\": ' || regexp_extract(props, '[0-9]+') || '}' AS object, true AS ok FROM events")
def sf8_extract_object(spark, sf):
    noisy = F.concat(F.lit("Sure: {x} then "), "props", F.lit(" done }"))
    return B.extract_objects(A.table(spark, sf, "events").select(F.col("event_id").alias("id"), noisy.alias("text")), ("k",))


@query("""WITH RECURSIVE f AS (SELECT source AS project_id, 'doc_' || lpad(doc_id::VARCHAR, 9, '0') AS file_path, n_chars // 4 AS tokens, n_chars // 40 + 1 AS texts FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path) AS k FROM f),
  w AS (SELECT project_id, k, file_path, 0 AS batch, tokens, texts FROM o WHERE k = 1
    UNION ALL SELECT o.project_id, o.k, o.file_path, w.batch + CASE WHEN w.tokens + o.tokens > 5000 OR w.texts + o.texts > 400 THEN 1 ELSE 0 END,
      o.tokens + CASE WHEN w.tokens + o.tokens > 5000 OR w.texts + o.texts > 400 THEN 0 ELSE w.tokens END, o.texts + CASE WHEN w.tokens + o.tokens > 5000 OR w.texts + o.texts > 400 THEN 0 ELSE w.texts END
      FROM w JOIN o ON o.project_id = w.project_id AND o.k = w.k + 1) SELECT project_id, file_path, batch FROM w""")
def wn9_token_batches(spark, sf):
    docs = A.table(spark, sf, "documents")
    files = docs.select(F.col("source").alias("project_id"), F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_path"), F.floor(F.col("n_chars") / 4).alias("tokens"), (F.floor(F.col("n_chars") / 40) + 1).alias("texts"))
    return B.pack_files(files, 5000, 400)


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50)::BIGINT AS batch FROM documents")
def wn10_fixed_batches(spark, sf):
    return B.fixed_batches(A.table(spark, sf, "documents"), ["source"], 50, "doc_id").select("doc_id", "batch")


def _commits(spark, sf):
    return D.commit_diffs(A.commit_versions(spark, sf), A.commit_messages(spark, sf))


@query(f"WITH {A.DIFFS} SELECT commit, message, sha256(diff) AS diff_hash FROM diffs")
def sc17_commit_diffs(spark, sf):
    return _commits(spark, sf).select("commit", "message", F.sha2("diff", 256).alias("diff_hash"))


@query(f"""WITH {A.FILES}, v AS (SELECT id, file_path, string_split(replace(description, '. ', '.' || chr(10)), chr(10)) AS l FROM files WHERE file_path IS NOT NULL AND description IS NOT NULL),
  e AS (SELECT id, file_path, list_filter(list_transform(l, lambda x, i: CASE WHEN (i - 1 + id) % 7 = 3 THEN NULL WHEN (i - 1 + id) % 11 = 5 THEN x || chr(10) || 'added ' || (i - 1) WHEN (i - 1 + id) % 13 = 2 THEN x || '!' ELSE x END), lambda x: x IS NOT NULL) AS l FROM v)
  SELECT id::VARCHAR AS commit, file_path, sha256(array_to_string(l, chr(10))) AS text_hash FROM e WHERE len(l) > 0""")
def sc17_edited_texts(spark, sf):
    """Versions that differ in many places: the older one and the diff give the newer one."""
    f = A.files(spark, sf).where("file_path IS NOT NULL AND description IS NOT NULL")
    k = lambda i: i + F.col("id")
    edited = lambda x, i: F.when(k(i) % 7 == 3, F.lit(None)).when(k(i) % 11 == 5, F.concat(x, F.lit("\nadded "), i.cast("string"))).when(k(i) % 13 == 2, F.concat(x, F.lit("!"))).otherwise(x)
    old = F.replace("description", F.lit(". "), F.lit(".\n"))
    lines = F.filter(F.transform(F.split(old, "\n"), edited), lambda x: x.isNotNull())
    versions = f.select(F.col("id").cast("string").alias("commit"), "file_path", old.alias("old"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("new"))
    same = versions.where(F.col("old").eqNullSafe(F.col("new"))).select("commit", "file_path", F.col("old").alias("text"))
    return D.apply_diffs(versions, D.file_diffs(versions)).union(same).where("text IS NOT NULL").select("commit", "file_path", F.sha2("text", 256).alias("text_hash"))


LINES = f"""{A.DIFFS}, l AS (SELECT commit, unnest(range(len(string_split(diff, chr(10))))) AS line_no, unnest(string_split(diff, chr(10))) AS line FROM diffs),
  s AS (SELECT *, sum(starts_with(line, 'diff --git')::INT) OVER (PARTITION BY commit ORDER BY line_no) AS section FROM l)"""


@query(f"WITH {LINES} SELECT commit, section::BIGINT AS section, regexp_replace(string_split(line, ' ')[3], '^a/', '') AS file_path FROM s WHERE starts_with(line, 'diff --git')")
def sc21_diff_files(spark, sf):
    return B.changed_files(_commits(spark, sf))


@query(f"""WITH {LINES}, w AS (SELECT commit, section FROM s WHERE starts_with(line, 'diff --git') AND (ends_with(line, '.js') OR ends_with(line, '7.md')))
  SELECT commit, section::BIGINT AS section, string_agg(line, chr(10) ORDER BY line_no) AS text FROM s JOIN w USING (commit, section) GROUP BY 1, 2""")
def jn17_diff_sections(spark, sf):
    wanted = A.commit_versions(spark, sf).where(F.col("file_path").endswith(".js") | F.col("file_path").endswith("7.md")).select("commit", "file_path")
    return B.sections_of(_commits(spark, sf), wanted)


@query(f"""WITH {A.DIFFS}, n AS (SELECT commit, row_number() OVER (PARTITION BY commit ORDER BY p) AS section, length(diff) // 4 AS tokens FROM sections),
  b AS (SELECT commit, ((section - 1) // 7)::BIGINT AS batch, count(*) AS files, sum(tokens)::BIGINT + 500 AS tokens FROM n GROUP BY 1, 2) SELECT *, tokens > 6000 AS skipped FROM b""")
def lm3_chunk_prompts(spark, sf):
    return B.chunk_prompts(B.all_sections(_commits(spark, sf)), 7, 6000)


@query(f"WITH {A.FILES} SELECT project_id AS commit, file_path, sha256(description) AS description_hash FROM files WHERE id % 10 = 3 AND to_be_cleaned IS NULL")
def jn18_current_descriptions(spark, sf):
    """A commit for each project that changes some of its files and one that nothing is known of."""
    f = A.files(spark, sf)
    heads = F.transform(F.array_sort(F.collect_list("file_path")), lambda p: F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n+x")))
    diffs = f.where("id % 10 = 3").groupBy(F.col("project_id").alias("commit")).agg(F.concat(F.array_join(heads, "\n"), F.lit("\ndiff --git a/no/such.py b/no/such.py")).alias("diff"))
    return B.current_descriptions(diffs, f).select("commit", "file_path", F.sha2("description", 256).alias("description_hash"))


@query("""SELECT source, greatest(5, least(50, greatest(1, floor(70000 / (sum(n_chars // 4) / count(*)))::BIGINT))) AS chunk_size, CASE WHEN sum(n_chars // 4) + 2000 <= 40000 THEN 'single'
  WHEN sum(n_chars // 4) // 2 + 2000 <= 40000 AND sum(n_chars // 4) // 3 <= 40000 THEN 'two_stage' ELSE 'chunked' END AS stage FROM documents GROUP BY 1""")
def sf27_diff_chunk_size(spark, sf):
    sums = A.table(spark, sf, "documents").groupBy("source").agg(F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens"), F.count("*").alias("files"))
    return sums.select("source", X.diff_chunk_size(F.col("tokens"), F.col("files")).alias("chunk_size"), B.stage(F.col("tokens") + 2000, F.floor(F.col("tokens") / 2) + 2000, F.floor(F.col("tokens") / 3), 40_000).alias("stage"))


@query("SELECT 'f' || (turn % 6) AS file_path, arg_max(text, conv_id * 100 + turn) AS description FROM conversations GROUP BY 1")
def st4_merge_answers(spark, sf):
    answers = A.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("position"), F.create_map(F.concat(F.lit("f"), (F.col("turn") % 6).cast("string")), "text").alias("updates"))
    return B.merge_answers(answers)


@query("SELECT conv_id, count(*) AS turns, sum(length(role || ': ' || text) // 4)::BIGINT AS tokens, sum(length(role || ': ' || text) // 4) <= 100 AS fits FROM conversations GROUP BY 1")
def lm1_prompt_accounting(spark, sf):
    return B.prompts(A.table(spark, sf, "conversations"), 100)


@query("""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '# n' || doc_id || chr(10) || text ELSE text END) AS prepared_hash, sha256(substr(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1, 10000)) AS scrubbed_hash FROM documents""")
def sf25_embedding_text(spark, sf):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    return A.table(spark, sf, "documents").select("doc_id", F.sha2(X.embedding_text(name, F.col("text")), 256).alias("prepared_hash"), F.sha2(X.scrub(F.col("text")), 256).alias("scrubbed_hash"))


@query(f"WITH {A.OVERVIEWS} SELECT project_id, sha256(p) AS prompt_hash, length(p) // 4 AS tokens, length(p) // 4 <= 3000 AS fits FROM (SELECT project_id, 'Overview:' || chr(10) || overview || chr(10) || chr(10) || 'Question: why?' AS p FROM overviews)")
def lm1_ask_prompt(spark, sf):
    out = B.ask_prompt(A.overviews(spark, sf), "why?", 3000)
    return out.select("project_id", F.sha2("prompt", 256).alias("prompt_hash"), "tokens", "fits")


@query("""WITH f AS (SELECT source AS project_id, doc_id AS position, n_chars // 4 AS tokens, row_number() OVER w AS place, sum(n_chars // 4) OVER w AS upto, count(*) OVER (PARTITION BY source) AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
  e AS (SELECT project_id, max(place) AS kept FROM f WHERE upto <= 6000 AND list_contains([n, n // 2, n // 4, n // 8, n // 16, n // 32, n // 64, n // 128, n // 256, n // 512, n // 1024, n // 2048, n // 4096, n // 8192, n // 16384], place) GROUP BY 1)
  SELECT project_id, position, tokens FROM f JOIN e USING (project_id) WHERE place <= kept""")
def lm2_halved_context(spark, sf):
    docs = A.table(spark, sf, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("position"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return B.within_budget(docs, 6000)
