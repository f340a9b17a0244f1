"""Boolean and phrase search with BM25, and statistics of words and sentences.

A search is two scans without a shuffle. Each row is folded into blank-separated tokens, once, and the query's few phrases
are counted in place; the first scan sums up the statistics, which become constants of the second, whose top k needs no
sort. The folded rows (``indexed``) can be stored and kept up to date by upserts and deletes of rows. An inverted index
(``postings``) serves many queries at once.

Statistics cover all rows, soft-deleted ones too; only active ones are found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import FOLD_FROM, FOLD_TO, padded_tokens, sentences, word_terms
from quarry.operators.catalog import active

K1, B = 1.2, 0.75
COLUMNS = ("project_id", "file_path", "description")


_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])


def query_phrases(query: str) -> list[list[str]]:
    """The phrases of a query, all of which have to match: its words and quoted parts, as tokens."""
    out = []
    for part in re.findall(r'"[^"]*"|\S+', query or ""):
        out.append([t for t in re.split(r"[^\w]+|_", part.translate(_FOLD).lower()) if t])
    return out


def indexed(files: DataFrame) -> DataFrame:
    """id, project_id, file_path, to_be_cleaned, pad, d: of each file the tokens of its columns, each between blanks, with
    a line's end between columns so that no phrase spans two; and how many they are."""
    pads = [padded_tokens(F.col(c)) for c in COLUMNS]
    folded = files.select("id", "project_id", "file_path", "to_be_cleaned", F.concat_ws("\n", *pads).alias("_pad"))
    # through a generator no expression is copied: a text is folded once, however often it is looked at
    once = folded.select("id", "project_id", "file_path", "to_be_cleaned", F.explode(F.array("_pad")).alias("pad"))
    count = lambda blanks: F.octet_length("pad") - F.octet_length(F.replace("pad", F.lit(blanks), F.lit("")))
    # a column of n tokens has n + 1 blanks, one without tokens has two in a row
    return once.withColumn("d", (count(" ") - len(COLUMNS) - count("  ") / 2).cast("int"))


def _occurrences(phrase: list[str]) -> Column:
    """How often the phrase stands in ' a b c '. Places may share tokens, hence the look-ahead for all but the first."""
    rest = "".join(f" {re.escape(t)}" for t in phrase[1:])
    return F.when(F.contains("pad", F.lit(f" {' '.join(phrase)} ")), F.regexp_count("pad", F.lit(rf" {re.escape(phrase[0])}(?={rest} )"))).otherwise(0)


def search(files: DataFrame, query: str, project_id: str | None = None, limit: int = 20) -> DataFrame:
    """``search_index`` over files that are folded on the way."""
    return search_index(indexed(files), query, project_id, limit)


def search_index(index: DataFrame, query: str, project_id: str | None = None, limit: int = 20) -> DataFrame:
    """id, project_id, file_path, score: the ``limit`` best active files; scores are negative, the lowest is best.

    A phrase may stand in any of the three columns. Statistics cover all files, whatever the project asked for.
    A part without a token matches nothing. Ties go to the smaller id."""
    phrases = query_phrases(query)
    if not phrases or not all(phrases):
        return index.select("id", "project_id", "file_path", F.lit(0.0).alias("score")).limit(0)
    names = [f"f{k}" for k in range(len(phrases))]
    counted = index.select("id", "project_id", "file_path", "to_be_cleaned", "d", *(_occurrences(p).alias(f) for f, p in zip(names, phrases, strict=True)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("d").alias("avg_d"), *(F.count(F.when(F.col(f) > 0, 1)).alias(f"n_{f}") for f in names)).first()
    score = F.lit(0.0)
    for f in names:
        score = score - F.lit(_idf(stats["n"], stats[f"n_{f}"])) * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col("d") / F.lit(stats["avg_d"] or 1.0)))
    found = active(counted).where(" AND ".join(f"{f} > 0" for f in names))
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    return found.select("id", "project_id", "file_path", score.alias("score")).orderBy("score", "id").limit(limit)


def _idf(n: int, holding: int) -> float:
    return max(math.log((n - holding + 0.5) / (holding + 0.5)), 1e-6)


def _postings(index: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, id, to_be_cleaned, d, tf, of the given terms alone if any are given: others go before anything is grouped."""
    words = index.select("id", "to_be_cleaned", "d", F.explode(F.filter(F.split("pad", r"[ \n]+"), lambda w: w != "")).alias("term"))
    if terms is not None:
        words = words.join(terms, "term", "left_semi")
    return words.groupBy("term", "id", "to_be_cleaned", "d").agg(F.count("*").alias("tf"))


def postings(files: DataFrame) -> DataFrame:
    """term, id, to_be_cleaned, d, tf: the inverted index."""
    return _postings(indexed(files))


def search_many(files: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """queries: query_id, terms (distinct tokens, all of which have to match). query_id, rank, id, score of the best.

    A query's rarest term names its candidates; the others are looked up for these alone. So no frequent term is joined
    with all queries that hold it."""
    index = indexed(files)
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    stats = index.agg(F.count("*").alias("n"), F.avg("d").alias("avg_d")).first()
    held, no_segment = _postings(index, wanted), F.lit(0).alias("segment")
    alive = active(index).select(no_segment, "id")
    return ranked_queries(held.select("*", no_segment), alive, queries, stats["n"], stats["avg_d"] or 1.0, limit)


def ranked_queries(held: DataFrame, alive: DataFrame, queries: DataFrame, n: int, avg_d: float, limit: int) -> DataFrame:
    """The best of each query from postings (term, segment, id, d, tf) and the files that may be found (segment, id). Parts are
    summed as decimals, whose sum doesn't depend on their order: files that score the same stay equal, and go by id."""
    wanted = queries.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    frequency = held.groupBy("term").agg(F.count("*").alias("holding"))
    idf = F.greatest(F.log((F.lit(n) - F.col("holding") + 0.5) / (F.col("holding") + 0.5)), F.lit(1e-6))
    part = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("d") / F.lit(avg_d)))
    known = wanted.join(frequency, "term")
    # a query of which a term is nowhere has no candidates
    rarest = known.groupBy("query_id", "n_terms").agg(F.min_by("term", F.struct("holding", "term")).alias("term"), F.count("*").alias("n")).where("n = n_terms")
    candidates = held.join(rarest.select("query_id", "n_terms", "term"), "term").join(alive, ["segment", "id"], "left_semi").select("query_id", "n_terms", "segment", "id")
    asked = candidates.join(known.select("query_id", "term", "holding"), "query_id")
    scored = asked.join(held.select("term", "segment", "id", "d", "tf"), ["term", "segment", "id"]).groupBy("query_id", "n_terms", "segment", "id").agg(F.sum(part.cast("decimal(28,18)")).cast("double").alias("score"), F.count("*").alias("matched"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12), "id"))
    return scored.where("matched = n_terms").withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def first_match(results: DataFrame, limit: int) -> DataFrame:
    """results: term_position, rank, file_path. Each path once, with its first term; the first ``limit`` in all."""
    once = results.groupBy("file_path").agg(F.min(F.struct("term_position", "rank")).alias("at"))
    return once.select("file_path", "at.term_position", "at.rank").orderBy("term_position", "rank", "file_path").limit(limit)


#: Words of programs that frequency lists leave out, besides the stop words of a language.
KEYWORDS = (
    "if", "else", "for", "while", "do", "break", "continue", "return", "function", "class", "def", "var", "let", "const", "public", "private",
    "static", "async", "await", "import", "export", "from", "true", "false", "null", "undefined", "this", "that", "self", "super", "new", "delete",
)
#: A short list; a fuller one is a parameter of ``word_frequency``.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "but", "by", "can",
    "could", "did", "does", "doing", "down", "each", "few", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "in", "into",
    "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out",
    "over", "own", "same", "she", "should", "so", "some", "such", "than", "the", "their", "them", "then", "there", "these", "they", "those", "through",
    "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would", "you", "your",
)


def stop_words(extra: tuple[str, ...] = STOP_WORDS) -> list[str]:
    return sorted({w.strip().lower() for w in extra if w.strip()} | set(KEYWORDS))


def stop_words_file(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words of a list, a line each, trimmed and in lower case; blank lines go. A list, so it fits on the driver."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()
    return tuple(sorted(r["w"] for r in words.collect()))


def multi_term_search(files: DataFrame, terms: list[str], project_id: str | None = None, limit: int = 20) -> DataFrame:
    """file_path, term_position, rank: the ``limit`` best files of each term, each file with its first term alone, in the
    order of terms and ranks, ``limit`` in all."""
    index = indexed(files)
    rank = F.row_number().over(Window.partitionBy("term_position").orderBy("score", "id"))
    found = [search_index(index, term, project_id, limit).withColumn("term_position", F.lit(k)) for k, term in enumerate(terms)]
    if not found:
        return files.select("file_path", F.lit(0).alias("term_position"), F.lit(0).alias("rank")).limit(0)
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return first_match(both.withColumn("rank", rank).select("term_position", "rank", "file_path"), limit)


def word_frequency(files: DataFrame, limit: int = 200, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """term, frequency, total_terms, unique_terms: the most frequent words; the totals are without stop words."""
    words = active(files).select(F.explode(word_terms(F.col("description"))).alias("term"))
    counts = words.where(~F.col("term").isin(stop_words(stop))).groupBy("term").agg(F.count("*").alias("frequency"))
    totals = counts.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_terms"), F.count("*").alias("unique_terms"))
    return counts.orderBy(F.col("frequency").desc(), "term").limit(limit).crossJoin(totals)


def sentence_context(overviews: DataFrame, word: str, around: int = 2) -> DataFrame:
    """project_id, sentence_index, sentence, context: sentences that hold the word, with up to ``around`` on each side."""
    own = overviews.select("project_id", sentences(F.col("overview")).alias("all"))
    hits = own.select("project_id", "all", F.posexplode("all").alias("sentence_index", "sentence")).where(F.contains(F.lower("sentence"), F.lit(word.lower())))
    first = F.greatest(F.lit(0), F.col("sentence_index") - around)
    last = F.least(F.size("all") - 1, F.col("sentence_index") + around)
    return hits.select(
        "project_id", "sentence_index", "sentence", first.alias("context_start"), last.alias("context_end"),
        F.concat(F.array_join(F.slice("all", first + 1, last - first + 1), ". "), F.lit(".")).alias("context"),
    )
