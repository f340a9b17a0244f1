"""Search, words, sentences and token accounts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.text import FOLD_FROM, FOLD_TO, preprocess_query, token_estimate
from quarry.operators import search as S
from quarry.operators.catalog import active
from quarry.operators.inverted import InvertedIndex
from quarry.plans.registry import query
from quarry.sources import adapters as A
from quarry.sources.shared import shared_folder, snapshot


def _folded(expr: str) -> str:
    return f"' ' || trim(regexp_replace(lower(translate(coalesce({expr}, ''), '{FOLD_FROM}', '{FOLD_TO}')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _length(expr: str) -> str:
    return f"(CASE WHEN trim({expr}) = '' THEN 0 ELSE length({expr}) - length(replace({expr}, ' ', '')) - 1 END)"


def _places(expr: str, phrase: str) -> str:
    # blanks are doubled, so that neighbouring places share none
    return f"(length(replace({expr}, ' ', '  ')) - length(replace(replace({expr}, ' ', '  '), ' {phrase.replace(' ', '  ')} ', ''))) // {len(phrase.replace(' ', '  ')) + 2}"


def _search_sql(phrases: list[str], limit: int, project: str | None = None, digits: int = 6) -> str:
    cols = ("p", "f", "x")
    hits = ", ".join("(" + " + ".join(_places(c, p) for c in cols) + f") AS f{k}" for k, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(phrases)))
    score = " - ".join(f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / avg_d))" for k in range(len(phrases)))
    where = "to_be_cleaned IS NULL AND " + " AND ".join(f"f{k} > 0" for k in range(len(phrases))) + (f" AND project_id = '{project}'" if project else "")
    return f"""WITH {A.FILES}, t AS (SELECT id, project_id, file_path, to_be_cleaned, {_folded("project_id")} AS p, {_folded("file_path")} AS f, {_folded("description")} AS x FROM files),
  c AS (SELECT id, project_id, file_path, to_be_cleaned, {" + ".join(_length(c) for c in cols)} AS d, {hits} FROM t), s AS (SELECT count(*) AS n, avg(d) AS avg_d, {stats} FROM c)
  SELECT id, project_id, file_path, round(0 - {score}, {digits}) AS score FROM c, s WHERE {where} ORDER BY 0 - {score}, id LIMIT {limit}"""


def stored_index(spark, sf):
    """The inverted index of the files. It is built once for each state of the tables that the files come from."""
    at = f"{shared_folder(spark)}/quarry-index-{snapshot(spark, f'{sf}/documents.parquet', f'{sf}/labels.parquet')}"
    index = InvertedIndex(spark, at)
    return index if index.ready() else index.build(A.files(spark, sf))


@query(f"""WITH {A.FILES}, t AS (SELECT id, unnest(list_concat(list_concat({{p}}, {{f}}), {{x}})) AS term FROM files)
  SELECT term, count(DISTINCT id) AS files, count(*) AS places FROM t GROUP BY term""".format(**{k: f"list_filter(string_split(trim({_folded(c)}), ' '), lambda w: w <> '')" for k, c in (("p", "project_id"), ("f", "file_path"), ("x", "description"))}))
def tx5_stored_index(spark, sf):
    """What the index holds: of each term, how many files hold it, and at how many places."""
    return stored_index(spark, sf).terms()


@query(_search_sql(["the", "license"], 20))
def tx5_search_bm25(spark, sf):
    return stored_index(spark, sf).search("the license", limit=20).withColumn("score", F.round("score", 6))


@query(_search_sql(["all rights reserved", "and"], 20))
def tx5_search_phrase(spark, sf):
    return stored_index(spark, sf).search('"all rights reserved" and', limit=20).withColumn("score", F.round("score", 6))


@query(_search_sql(["of the"], 10, "src2"))
def tx5_search_in_project(spark, sf):
    return stored_index(spark, sf).search('"of the"', "src2", 10).withColumn("score", F.round("score", 6))


def _tokens(expr: str) -> str:
    return f"list_filter(string_split(trim({_folded(expr)}), ' '), lambda w: w <> '')"


@query(f"""WITH {A.FILES}, q AS (SELECT item_id AS query_id, list_distinct({_tokens("text")}) AS terms FROM benchmark),
  t AS (SELECT id, to_be_cleaned, list_concat(list_concat({_tokens("project_id")}, {_tokens("file_path")}), {_tokens("description")}) AS w FROM files),
  post AS (SELECT id, len(w) AS d, unnest(w) AS term FROM t), tf AS (SELECT term, id, d, count(*) AS tf FROM post GROUP BY ALL),
  df AS (SELECT term, count(*) AS n_t FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avg_d FROM t),
  w AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q),
  sc AS (SELECT query_id, n_terms, id, sum(0 - greatest(ln((n - n_t + 0.5) / (n_t + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg_d))) AS score, count(*) AS matched
    FROM w JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
  SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), id) AS rank FROM sc JOIN t USING (id) WHERE matched = n_terms AND to_be_cleaned IS NULL) WHERE rank <= 5""")
def tx5_search_many(spark, sf):
    from quarry.functions.text import padded_tokens

    terms = F.filter(F.split(F.trim(padded_tokens(F.col("text"))), " "), lambda w: w != "")
    queries = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(terms).alias("terms"))
    return stored_index(spark, sf).search_many(queries).withColumn("score", F.round("score", 6))


TERMS = ["license", "all rights reserved", "the"]
RANKED = " UNION ALL ".join(f"SELECT file_path, {k} AS term_position, row_number() OVER (ORDER BY score, id)::INT AS rank FROM ({sql})" for k, sql in enumerate([_search_sql([t], 15, digits=12) for t in TERMS]))


@query(f"""SELECT file_path, term_position, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY term_position, rank) AS k FROM ({RANKED})) WHERE k = 1 ORDER BY term_position, rank, file_path LIMIT 15""")
def wn12_multi_term_search(spark, sf):
    return S.multi_term_search(A.files(spark, sf), ["license", '"all rights reserved"', "the"], limit=15)


CHANGED = f"""{A.FILES.replace("files AS (", "old AS (", 1)}, files AS (SELECT id, project_id, file_path, CASE WHEN id % 9 = 0 THEN 'the new license text ' || id ELSE description END AS description, CASE WHEN id % 9 = 0 THEN NULL ELSE to_be_cleaned END AS to_be_cleaned FROM old WHERE id % 11 <> 4)"""


@query(_search_sql(["license"], 25).replace(A.FILES, CHANGED, 1))
def dm16_maintained_index(spark, sf):
    """A search over a stored index, after files were updated and deleted: segments hold the changed files alone."""
    f = A.files(spark, sf)
    index = InvertedIndex(spark, f"{shared_folder(spark)}/quarry-index-{uuid.uuid4().hex}").build(f)
    text = F.concat(F.lit("the new license text "), F.col("id").cast("string"))
    index.upsert(f.where("id % 9 = 0").withColumn("description", text).withColumn("to_be_cleaned", F.lit(None).cast("long")))
    index.delete(f.where("id % 11 = 4").select("id"))
    return index.search("license", limit=25).withColumn("score", F.round("score", 6))


@query("""SELECT item_id, coalesce(array_to_string(list_transform(regexp_extract_all(q, '"[^"]*"|\\S+'), lambda t: CASE WHEN length(t) >= 2 AND starts_with(t, '"') AND ends_with(t, '"') THEN t ELSE '"' || t || '"' END), ' AND '), '') AS match
  FROM (SELECT item_id, text || ' "two words" AND "open' AS q FROM benchmark)""")
def sf1_preprocess_queries(spark, sf):
    q = F.concat("text", F.lit(' "two words" AND "open'))
    return A.table(spark, sf, "benchmark").select("item_id", preprocess_query(q).alias("match"))


STOP = ", ".join(f"'{w}'" for w in S.stop_words())


@query(f"""WITH {A.FILES}, w AS (SELECT unnest(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM files WHERE to_be_cleaned IS NULL),
  c AS (SELECT term, count(*) AS frequency FROM w WHERE regexp_full_match(term, '[a-z]{{2,}}') AND term NOT IN ({STOP}) GROUP BY 1)
  SELECT term, frequency, (SELECT sum(frequency) FROM c)::BIGINT AS total_terms, (SELECT count(*) FROM c) AS unique_terms FROM c ORDER BY frequency DESC, term LIMIT 200""")
def ag2_word_frequency(spark, sf):
    return S.word_frequency(A.files(spark, sf))


@query(f"""WITH {A.FILES} SELECT project_id, sum(length(file_path || chr(10) || description || chr(10)) // 4)::BIGINT AS tokens,
  sum(length(file_path || chr(10) || description || chr(10)) // 4) > 32000 AS is_large FROM files WHERE to_be_cleaned IS NULL GROUP BY project_id""")
def ag3_token_totals(spark, sf):
    line = F.concat("file_path", F.lit("\n"), "description", F.lit("\n"))
    return active(A.files(spark, sf)).groupBy("project_id").agg(F.sum(token_estimate(line)).alias("tokens"), (F.sum(token_estimate(line)) > 32_000).alias("is_large"))


@query(f"""WITH {A.FILES}, {A.OVERVIEWS}, t AS (SELECT project_id, sum(length(file_path || chr(10) || description || chr(10)) // 4)::BIGINT AS tokens FROM files WHERE to_be_cleaned IS NULL GROUP BY 1)
  SELECT project_id, tokens, coalesce(total_tokens, 0) AS overview_tokens, CASE WHEN tokens <= 20000 THEN 'use_overview' WHEN coalesce(total_tokens, 0) BETWEEN 1 AND 32000 THEN 'view_overview_then_search' ELSE 'use_search' END AS recommendation
  FROM t LEFT JOIN overviews USING (project_id)""")
def ag26_size_recommendation(spark, sf):
    return recommendation(A.files(spark, sf), A.overviews(spark, sf), 20_000)


def recommendation(files, overviews, limit: int):
    line = F.concat("file_path", F.lit("\n"), "description", F.lit("\n"))
    tokens = active(files).groupBy("project_id").agg(F.sum(token_estimate(line)).alias("tokens"))
    own = F.coalesce("total_tokens", F.lit(0))
    say = F.when(F.col("tokens") <= limit, "use_overview").when((own > 0) & (own <= 32_000), "view_overview_then_search").otherwise("use_search")
    return tokens.join(overviews, "project_id", "left").select("project_id", "tokens", own.alias("overview_tokens"), say.alias("recommendation"))


@query(f"""WITH {A.OVERVIEWS}, s AS (SELECT project_id, list_filter(list_transform(regexp_split_to_array(overview, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a FROM overviews),
  h AS (SELECT project_id, a, unnest(range(len(a))) AS i FROM s)
  SELECT project_id, i::INT AS sentence_index, a[i + 1] AS sentence, greatest(0, i - 2)::INT AS context_start, least(len(a) - 1, i + 2)::INT AS context_end,
  array_to_string(a[greatest(0, i - 2) + 1 : least(len(a) - 1, i + 2) + 1], '. ') || '.' AS context FROM h WHERE contains(lower(a[i + 1]), 'tion')""")
def wn3_sentence_context(spark, sf):
    return S.sentence_context(A.overviews(spark, sf), "tion")
