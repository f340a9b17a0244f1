"""Ranked lexical search by Fagin's threshold algorithm.

One pass over the texts makes a forward index: of each document its length and, of the terms that the queries ask for,
how often it holds them. Totals over it give every term's weight. Then each task takes its documents in shards. A shard
has an impact-sorted list for each term, and its forward index for random look-ups. For a query the lists are read from
their heads in turn, a few entries more each round; a document seen for the first time gets its whole score by a look-up.
No document unseen can score more than the threshold, the sum of what stands next in each list: a shard is done with the
query once that is strictly below its kth score, so that ties are all seen. The shards' best are ranked together.

No text and no list is shuffled: what moves is at most k rows of each shard and query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import LOWER, UPPER, Scratch, sql_lower_ascii

#: Every byte of ASCII but letters and digits parts terms; A-Z become a-z; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; of a null text none."""
    return (text or b"").translate(FOLD).split()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of those of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                n.append(len(words))
                own = Counter(map(number, words))
                own.pop(None, None)
                terms += own.keys()
                tfs += own.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(work, FORWARD)


class Shard:
    """Documents with their forward index and, of each term, its list by falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, vocabulary: int, total: int, length: int):
        m = 50 + (50 * n * total) // max(length, 1)
        self.ids, self.sizes, self.terms = ids, sizes, terms
        self.starts = sizes.cumsum() - sizes
        doc = np.repeat(np.arange(len(ids)), sizes)
        tf = tfs.astype(np.int64)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -self.part, terms))
        self.list_doc, self.list_part = doc[order], self.part[order]
        self.list_at = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        #: documents looked up, for tests
        self.looked_up = 0

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores, by look-ups in the forward index. Every document has a term."""
        sizes = self.sizes[docs]
        ends = sizes.cumsum()
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(sizes.sum())
        self.looked_up += len(docs)
        return np.add.reduceat(weights[self.terms[at]] * self.part[at], ends - sizes)

    def top(self, asked: np.ndarray, weights: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best above 0; of equal scores the smallest ids. weights: of every term, 0 where it isn't asked for."""
        at, ends = self.list_at[asked], self.list_at[asked + 1]
        own = (at < ends) & (weights[asked] > 0)
        at, ends, weight = at[own], ends[own], weights[asked][own]
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(at):
            upto = np.minimum(at + step, ends)
            fresh = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(at.tolist(), upto.tolist(), strict=True)]))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            if len(fresh):
                docs, scores = np.append(docs, fresh), np.append(scores, self.scores(fresh, weights))
                best = np.lexsort((self.ids[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
            more = upto < ends
            at, ends, weight, step = upto[more], ends[more], weight[more], 2 * step
            threshold = int((weight * self.list_part[at]).sum()) if len(at) else 0
            if len(docs) == k and threshold < scores[-1]:
                break
        good = scores > 0
        return docs[good], scores[good]


def _shards(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, n, sizes, terms and counts of documents with a term, as many as have about so many entries."""
    held, entries = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            terms, tfs = part.column(2), part.column(3)
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            own = np.flatnonzero(sizes)
            ids = part.column(0).fill_null(NO_ID).to_numpy()
            held.append((ids[own], part.column(1).to_numpy()[own], sizes[own], terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            entries += int(sizes.sum())
            if entries >= postings:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, entries = [], 0
    if entries:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def weights_of(found: np.ndarray, total: int) -> np.ndarray:
    """Of each term from the number of documents that hold it; 0 if none does."""
    w = np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * found + 1))).astype(np.int64)
    return np.where(found > 0, w, 0)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 4096, postings: int = 2_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its k best of ``docs`` (doc_id, text).

    Ranks begin with 1; scores are above 0; ties go to the smaller doc_id, rows without one last. Null and empty texts
    have no terms: such a document counts nowhere, such an item has no rows. Repeated documents are candidates each; of
    items with one id the largest text asks. Empty tables give an empty result; other columns are ignored. Items are
    taken in blocks of ``block``, for each of which the texts are read once; a task holds a block's terms and a shard of
    about ``postings`` entries (one document's, if it has more).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    asked = scratch.store(items.groupBy("item_id").agg(F.max("text").alias("text")).where("text is not null").repartitionByRange("item_id"))
    found, last, totals = [], None, None
    while True:
        rows = asked if last is None else asked.where(F.col("item_id").isNull() | (F.col("item_id") > last))
        own = rows.orderBy(F.col("item_id").asc_nulls_last()).limit(block).collect()  # a block, of a size that is a parameter
        if not own and found:
            break
        texts = [terms_of(r["text"].encode()) for r in own]
        vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for own_terms in texts for t in own_terms))}
        index = scratch.store(forward_index(docs, vocabulary))
        if totals is None:
            totals = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the block's terms
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted:
            df[r["term"]] = r["count"]
        ids = [r["item_id"] for r in own]
        numbers = [np.array([vocabulary[t] for t in dict.fromkeys(own_terms)], np.int64) for own_terms in texts]
        found.append(_search(index, ids, numbers, weights_of(df, totals[0]), totals, k, postings))
        last = ids[-1] if ids else None
        if len(own) < block or last is None:
            break
        found[-1] = scratch.store(found[-1])  # so that the plan doesn't grow with the number of blocks
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search(index: DataFrame, ids: list[int | None], numbers: list[np.ndarray], weights: np.ndarray, totals: tuple, k: int, postings: int) -> DataFrame:
    total, length = totals

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, postings):
            shard = Shard(*part, len(weights), total, length)
            of_item = np.zeros_like(weights)
            for item, own in zip(ids, numbers, strict=True):
                of_item[own] = weights[own]
                docs, scores = shard.top(own, of_item, k)
                of_item[own] = 0
                names = shard.ids[docs]
                columns = [pa.array([item] * len(docs), pa.int64()), pa.array(names, pa.int64(), mask=names == NO_ID), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(work, "item_id long, doc_id long, score long")


_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_D, _Q = _TERMS.format(sql_lower_ascii("text")), _TERMS.format(f"translate(text, '{UPPER}', '{LOWER}')")
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_D} AS w FROM documents
), doc AS (
  SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), tot AS (
  SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM doc
), q AS (
  SELECT DISTINCT item_id, unnest({_Q}) AS term FROM benchmark
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot
), s AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN doc USING (r), tot GROUP BY item_id, doc_id, r
), b AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM b WHERE rank <= 50
"""
