"""A stored inverted index with positions, searched without reading texts.

Files are dealt into slots of some thousand, those of similar length together. A term has a row of postings for each slot
that holds it: ids in ascending order, how often and where each file holds the term, and the most that any of them can
score: the highest count and the least length. Each file of postings is sorted by term, so a query's filter reaches the
pages of its terms alone; ids and positions ascend within a row, which the Parquet writer stores as differences.

A search bounds each slot that holds all terms by the sum of what its rows can score, scores the slots of the highest
bounds, and goes on to the others only if their bound reaches the kth score. A phrase is an intersection of positions.

An update adds a segment with the changed files alone, and names the files of older segments that it replaces or deletes;
``merge`` makes one segment of what is alive. A segment counts once its totals are there, which are written last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import B, K1, _idf, indexed, query_phrases, ranked_queries
from quarry.sources.shared import file_system

DOCS = "id long, project_id string, file_path string, to_be_cleaned long, d int, slot long, pad string, segment int"
POSTINGS = "term string, slot long, n int, max_tf int, min_d int, ids array<long>, ds array<int>, positions array<array<int>>, segment int"
DEAD = "of int, id long, d int, segment int"
TOTALS = "base boolean, n long, sum_d long, slots long, segment int"
KEY = ["project_id", "file_path"]


def with_slots(index: DataFrame, files: int, words: int = 2_000_000) -> DataFrame:
    """index with slot: consecutive files by length and id, so many in a slot, but no more than hold so many words; a slot is
    within a partition."""
    ordered = index.repartitionByRange("d", "id").sortWithinPartitions("d", "id")
    row = F.monotonically_increasing_id()
    place = row.bitwiseAND(F.lit((1 << 33) - 1))
    # files whose lengths have as many binary digits share a size of slots, beyond those of which ``files`` fit
    digits = F.when(F.col("d") * files > words, F.floor(F.log2(F.col("d").cast("double")))).otherwise(0).cast("long")
    fit = F.when(digits > 0, F.greatest(F.lit(1.0), F.floor(words / F.pow(F.lit(2.0), digits + 1)))).otherwise(F.lit(float(files)))
    return ordered.withColumn("slot", F.shiftleft(F.shiftright(row, 33), 33) + F.shiftleft(digits, 28) + F.floor(place / F.least(fit, F.lit(float(files)))))


def inverted(docs: pa.Table) -> pa.Table:
    """The postings of a slot's files (slot, id, d, pad), by one sort of their words' numbers."""
    docs = docs.sort_by("id")
    words = pc.split_pattern(docs["pad"].combine_chunks(), " ")
    starts = words.offsets.to_numpy()
    numbers = words.flatten().dictionary_encode()
    code, names = numbers.indices.to_numpy(), numbers.dictionary
    doc = np.repeat(np.arange(len(docs)), np.diff(starts))
    at = np.arange(len(code)) - (starts[:-1] - starts[0])[doc]
    keep = pc.invert(pc.is_in(names, pa.array(["", "\n"], names.type))).to_numpy(zero_copy_only=False)[code]
    code, doc, at = code[keep], doc[keep], at[keep]
    order = np.argsort(code, kind="stable")
    code, doc, at = code[order], doc[order], at[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    entry = np.flatnonzero(fresh)  # a term in a file
    tf = np.diff(np.append(entry, len(code)))
    of, held = code[entry], doc[entry]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else entry  # a term
    d = docs["d"].to_numpy()[held]
    ends = lambda x, n: pa.array(np.append(x, n).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(ends(first, len(entry)), values)
    places = pa.ListArray.from_arrays(ends(entry, len(code)), pa.array(at.astype(np.int32)))
    return pa.table({
        "term": names.take(pa.array(of[first])), "slot": pa.array(np.full(len(first), docs["slot"][0].as_py() if len(docs) else 0)), "n": pa.array(np.diff(np.append(first, len(entry))).astype(np.int32)),
        "max_tf": pa.array((np.maximum.reduceat(tf, first) if len(first) else tf).astype(np.int32)), "min_d": pa.array((np.minimum.reduceat(d, first) if len(first) else d).astype(np.int32)),
        "ids": lists(pa.array(docs["id"].to_numpy()[held])), "ds": lists(pa.array(d)), "positions": lists(places),
    })


def postings_of(docs: DataFrame) -> DataFrame:
    """docs: slot, id, d, pad. A row for each term and slot. A slot is inverted in one task, so what moves is
    texts, not a row for each word."""
    return docs.select("slot", "id", "d", "pad").groupBy("slot").applyInArrow(inverted, POSTINGS.removesuffix(", segment int"))


def _part(tf: Column, d: Column, avg_d: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * d / F.lit(avg_d)))


class InvertedIndex:
    """Over a folder that driver and executors share. One writer at a time; readers see whole segments."""

    def __init__(self, spark: SparkSession, folder: str, slot_files: int = 1024, first_slots: int = 64):
        self.spark, self.folder, self.slot_files, self.first_slots = spark, folder.rstrip("/"), slot_files, first_slots
        #: slots that the last search has scored, for tests
        self.scored: int = 0

    # segments

    def _read(self, table: str, schema: str) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.folder}/{table}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def _totals(self) -> list:
        """The totals of segments that count: from the last base on."""
        rows = sorted(self._read("totals", TOTALS).collect(), key=lambda r: r["segment"])  # a row for each segment
        bases = [k for k, r in enumerate(rows) if r["base"]]
        return rows[bases[-1] :] if bases else []

    def _of(self, table: str, schema: str, segments: list[int]) -> DataFrame:
        return self._read(table, schema).where(F.col("segment").isin(segments))

    def ready(self) -> bool:
        return bool(self._totals())

    def terms(self) -> DataFrame:
        """term, files, places, of the files that are alive."""
        segments = [r["segment"] for r in self._totals()]
        rows = self._of("postings", POSTINGS, segments)
        entry = F.explode(F.arrays_zip("ids", F.transform("positions", F.size).alias("tfs"))).alias("e")
        if len(segments) < 2:
            return rows.groupBy("term").agg(F.sum("n").alias("files"), F.sum(F.size(F.flatten("positions"))).alias("places"))
        dead = self._of("dead", DEAD, segments).select(F.col("of").alias("segment"), "id")
        held = rows.select("term", "segment", entry).select("term", "segment", F.col("e.ids").alias("id"), "e.tfs").join(dead, ["segment", "id"], "left_anti")
        return held.groupBy("term").agg(F.count("*").alias("files"), F.sum("tfs").alias("places"))

    def docs(self) -> DataFrame:
        """id, project_id, file_path, to_be_cleaned, d, slot, pad, segment of the files that are alive."""
        return self._alive("docs", DOCS, [r["segment"] for r in self._totals()])

    def _alive(self, table: str, schema: str, segments: list[int]) -> DataFrame:
        rows = self._of(table, schema, segments)
        if len(segments) < 2:  # a base has nothing to replace
            return rows
        dead = self._of("dead", DEAD, segments).select(F.col("of").alias("segment"), "id")
        return rows.join(dead, ["segment", "id"], "left_anti").select(*rows.columns)

    def _write(self, table: str, rows: DataFrame, segment: int) -> None:
        rows.write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{self.folder}/{table}/segment={segment}")

    def _add(self, index: DataFrame | None, segment: int, base: bool, dead: DataFrame | None = None) -> None:
        if index is not None:
            self._write("docs", with_slots(index.select("id", *KEY, "to_be_cleaned", "d", "pad"), self.slot_files), segment)
            docs = self._of("docs", DOCS, [segment])
            self._write("postings", postings_of(docs).sortWithinPartitions("term", "slot"), segment)
            n, sum_d, slots = docs.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0)), F.count_distinct("slot")).first()
        else:
            n, sum_d, slots = 0, 0, 0
        if dead is not None:
            self._write("dead", dead.select("of", "id", "d"), segment)
            gone = self._of("dead", DEAD, [segment]).agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
            n, sum_d = n - gone[0], sum_d - gone[1]
        self._write("totals", self.spark.createDataFrame([(base, n, sum_d, slots)], "base boolean, n long, sum_d long, slots long").coalesce(1), segment)

    def _next(self) -> int:
        fs, at = file_system(self.spark, self.folder)
        names = [s.getPath().getName() for t in ("docs", "dead", "totals") if fs.exists(p := file_system(self.spark, f"{self.folder}/{t}")[1]) for s in fs.listStatus(p)]
        return 1 + max((int(n.partition("=")[2]) for n in names if n.startswith("segment=")), default=0)

    def build(self, files: DataFrame) -> InvertedIndex:
        """Indexes files (id, project_id, file_path, description, to_be_cleaned) in place of all that was there."""
        self._add(indexed(files), self._next(), True)
        return self

    def upsert(self, files: DataFrame) -> None:
        """Files that are new, or in place of those with the same project and path; of equal ones in ``files`` the largest id."""
        last = files.groupBy(*KEY).agg(F.max_by(F.struct(*files.columns), "id").alias("row")).select("row.*")
        replaced = self.docs().join(last.select(*KEY), KEY, "left_semi")
        self._add(indexed(last), self._next(), not self._totals(), replaced.select(F.col("segment").alias("of"), "id", "d"))

    def delete(self, files: DataFrame) -> None:
        """files: id."""
        gone = self.docs().join(files.select("id").distinct(), "id", "left_semi")
        self._add(None, self._next(), not self._totals(), gone.select(F.col("segment").alias("of"), "id", "d"))

    def merge(self) -> None:
        """One segment of what is alive, from the stored tokens; then older segments but the last base go."""
        old = [r["segment"] for r in self._totals()]
        if len(old) > 1:
            self._add(self.docs().drop("slot", "segment"), self._next(), True)
            fs, _ = file_system(self.spark, self.folder)
            for table in ("totals", "docs", "postings", "dead"):
                at = file_system(self.spark, f"{self.folder}/{table}")[1]
                for s in fs.listStatus(at) if fs.exists(at) else ():
                    number = s.getPath().getName().partition("=")[2]
                    if number.isdigit() and int(number) < old[0]:  # the last ones' readers still have their time
                        fs.delete(s.getPath(), True)

    # searches

    def search(self, query: str, project_id: str | None = None, limit: int = 20) -> DataFrame:
        """id, project_id, file_path, score, as ``search.search_index`` says."""
        phrases, totals = query_phrases(query), self._totals()
        nothing = self.spark.createDataFrame([], "id long, project_id string, file_path string, score double")
        count = sum(r["n"] for r in totals)
        if not phrases or not all(phrases) or not count:
            return nothing
        segments = [r["segment"] for r in totals]
        avg_d = sum(r["sum_d"] for r in totals) / count or 1.0
        terms = sorted({t for p in phrases for t in p})
        rows = self._of("postings", POSTINGS, segments).where(F.col("term").isin(terms))
        plain = all(len(p) == 1 for p in phrases) and len(segments) == 1
        if plain:
            held = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
            holding = [held.get(p[0], 0) for p in phrases]
        else:  # files that hold a phrase are known from positions, and those that are dead don't count
            counted = self._matches(rows, phrases, segments)
            holding = counted.agg(*(F.count_if(F.col(f"f{k}") > 0) for k in range(len(phrases)))).first()
        if not all(holding):
            return nothing
        weights = [_idf(count, n) for n in holding]
        weight_of = {t: sum(w for w, p in zip(weights, phrases, strict=True) if p[0] == t) for t in terms}
        if (slots := sum(r["slots"] for r in totals)) <= self.first_slots:
            self.scored = slots
            return self._scored(rows, phrases, segments, weights, avg_d, project_id, limit)
        # a phrase stands at most as often as its first word
        own = F.element_at(F.create_map(*(x for t, w in weight_of.items() for x in (F.lit(t), F.lit(w)))), F.col("term"))
        bounds = rows.groupBy("segment", "slot").agg(F.sum(own * _part(F.col("max_tf"), F.col("min_d"), avg_d)).alias("bound"), F.count("*").alias("n")).where(F.col("n") == len(terms))
        first = bounds.orderBy(F.col("bound").desc(), "segment", "slot").limit(self.first_slots + 1).collect()  # a bounded number
        top = first[: self.first_slots]
        self.scored = len(top)
        best = self._scored(self._in_slots(rows, top), phrases, segments, weights, avg_d, project_id, limit)
        if len(first) <= self.first_slots:
            return best
        found = best.collect()
        least = -found[-1]["score"] if len(found) == limit else 0.0
        chosen = self.spark.createDataFrame([(r["segment"], r["slot"]) for r in top], "segment int, slot long")
        more = bounds.where(F.col("bound") >= least * (1 - 1e-9)).join(F.broadcast(chosen), ["segment", "slot"], "left_anti").select("segment", "slot")
        self.scored += (others := more.count())
        if not others:
            return self.spark.createDataFrame(found, best.schema)
        rest = self._scored(rows.join(more, ["segment", "slot"], "left_semi"), phrases, segments, weights, avg_d, project_id, limit)
        return rest.union(self.spark.createDataFrame(found, best.schema)).orderBy("score", "id").limit(limit)

    @staticmethod
    def _in_slots(rows: DataFrame, slots: list) -> DataFrame:
        return rows.where(F.concat_ws(" ", "segment", "slot").isin([f"{r['segment']} {r['slot']}" for r in slots]))

    def _matches(self, rows: DataFrame, phrases: list[list[str]], segments: list[int]) -> DataFrame:
        """segment, id, d and f0, f1, ...: how often each phrase stands in a file, of files that hold one of the terms."""
        terms = sorted({t for p in phrases for t in p})
        entry = F.explode(F.arrays_zip("ids", "ds", "positions")).alias("e")
        held = rows.select("segment", "term", entry).select("segment", "term", F.col("e.ids").alias("id"), F.col("e.ds").alias("d"), F.col("e.positions").alias("at"))
        if len(segments) > 1:
            dead = self._of("dead", DEAD, segments).select(F.col("of").alias("segment"), "id")
            held = held.join(dead, ["segment", "id"], "left_anti")
        names = {t: f"_t{k}" for k, t in enumerate(terms)}
        by_file = held.groupBy("segment", "id").agg(F.first("d").alias("d"), *(F.max(F.when(F.col("term") == t, F.col("at"))).alias(n) for t, n in names.items()))

        def before(k: int):
            return lambda x: x - k

        def times(phrase: list[str]) -> Column:
            places = F.col(names[phrase[0]])
            for k, t in enumerate(phrase[1:], 1):
                places = F.array_intersect(places, F.transform(names[t], before(k)))
            return F.coalesce(F.greatest(F.size(places), F.lit(0)), F.lit(0))

        return by_file.select("segment", "id", "d", *(times(p).alias(f"f{k}") for k, p in enumerate(phrases)))

    def _scored(self, rows: DataFrame, phrases: list[list[str]], segments: list[int], weights: list[float], avg_d: float, project_id: str | None, limit: int) -> DataFrame:
        found = self._matches(rows, phrases, segments).where(" AND ".join(f"f{k} > 0" for k in range(len(phrases))))
        score = F.lit(0.0)
        for k, w in enumerate(weights):
            score = score - F.lit(w) * _part(F.col(f"f{k}"), F.col("d"), avg_d)
        docs = self._of("docs", DOCS, segments).where("to_be_cleaned IS NULL").select("segment", "id", *KEY)
        if project_id is not None:
            docs = docs.where(F.col("project_id") == project_id)
        return found.select("segment", "id", score.alias("score")).join(docs, ["segment", "id"]).select("id", *KEY, "score").orderBy("score", "id").limit(limit)

    def search_many(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """As ``search.search_many``, from the stored postings."""
        totals = self._totals()
        segments, count = [r["segment"] for r in totals], sum(r["n"] for r in totals)
        wanted = queries.select(F.explode("terms").alias("term")).distinct()
        entry = F.explode(F.arrays_zip("ids", "ds", F.transform("positions", F.size).alias("tfs"))).alias("e")
        rows = self._of("postings", POSTINGS, segments).join(wanted, "term", "left_semi").select("term", "segment", entry)
        held = rows.select("term", "segment", F.col("e.ids").alias("id"), F.col("e.ds").alias("d"), F.col("e.tfs").alias("tf"))
        if len(segments) > 1:
            dead = self._of("dead", DEAD, segments).select(F.col("of").alias("segment"), "id")
            held = held.join(dead, ["segment", "id"], "left_anti")
        alive = self._of("docs", DOCS, segments).where("to_be_cleaned IS NULL").select("segment", "id")
        return ranked_queries(held, alive, queries, count, sum(r["sum_d"] for r in totals) / max(count, 1) or 1.0, limit)
