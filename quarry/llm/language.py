"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built: it recognises exactly the substrings of that text. A
document is parsed greedily: each phrase is the longest match from where the last one ended. Phrases times the log of the
training text's length, over the document's length, estimates the cross entropy; the language with the smallest wins. A
letter that a language lacks is a phrase too, which can't refer to its text: it costs as much as naming any character.

Every language has the whole alphabet of its own training text, as transitions are kept by letter. Workers parse whole
texts in one pass a language, a look-up a letter; texts that a batch repeats are parsed once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import crc_mod

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: What lies between words: all but letters and number signs that are no digits.
GAP = re.compile(r"[\W\d_]+")
#: Bits that name any character.
LITERAL = math.log2(0x110000)


def letters(text: str) -> str:
    """The text in lower case, each run between words a blank."""
    return GAP.sub(" ", text.lower())


def suffix_automaton(text: str) -> dict[str, dict]:
    """The start of the automaton that recognises the substrings of a text; a state is its transitions by letter."""
    nexts: list[dict] = [{}]
    links, lengths, last = [-1], [0], 0
    for ch in text:
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        at = last
        while at >= 0 and ch not in nexts[at]:
            nexts[at][ch] = new
            at = links[at]
        if at >= 0:
            to = nexts[at][ch]
            if lengths[to] == lengths[at] + 1:
                links[new] = to
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[to]))
                links.append(links[to])
                lengths.append(lengths[at] + 1)
                while at >= 0 and nexts[at].get(ch) == to:
                    nexts[at][ch] = copy
                    at = links[at]
                links[to] = links[new] = copy
        last = new
    for state in nexts:
        for ch, number in state.items():
            state[ch] = nexts[number]
    return nexts[0]


def phrases(text: str, start: dict[str, dict]) -> tuple[int, int]:
    """Phrases of the greedy parse, and letters that the automaton lacks, each of which is a phrase of its own."""
    n, lacking, state = 0, 0, start
    for ch in text:
        to = state.get(ch)
        if to is None:
            n += state is not start
            to = start.get(ch)
            if to is None:
                lacking += 1
                to = start
        state = to
    return n + (state is not start), lacking


class CrossParser:
    """Automata of all languages. Of languages that tie, the first in order wins."""

    def __init__(self, texts: dict[str, str]):
        own = {k: letters(t) for k, t in sorted(texts.items())}
        self.languages = list(own)
        self.starts = [suffix_automaton(t) for t in own.values()]
        self.log_sizes = [math.log2(max(2, len(t))) for t in own.values()]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: und and 0 without a letter; else 1 - best / next best cross entropy."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        own = letters(text)
        entropy = []
        for start, bits in zip(self.starts, self.log_sizes, strict=True):
            n, lacking = phrases(own, start)
            entropy.append((n * bits + lacking * LITERAL) / len(own))
        best = min(range(len(entropy)), key=entropy.__getitem__)
        others = min((e for k, e in enumerate(entropy) if k != best), default=None)
        return self.languages[best], 1.0 if others is None else 1 - entropy[best] / others


@lru_cache(maxsize=1)
def _parser(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    """Built once in each worker, from texts that are far smaller than their automata."""
    return CrossParser(dict(texts))


def labelled_text(docs: DataFrame, folds: int = 3, held: int = 1, chars: int = 30_000, total: int = 600_000, longest: int = 2_000, documents: int = 256) -> dict[str, str]:
    """Training text of every language that has a lang: a bounded sample of the labelled rows outside of fold ``held``.

    ``chars`` characters of a language at most, and ``total`` / languages where that is less (but 100), so that all
    automata together take a few hundred MB. Documents of at most ``longest`` characters come first, in the order of a
    hash of their content, ``documents`` at most; they are taken whole, but for the one that reaches the bound.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod(F.col("doc_id"), folds) != held))
    n = known.agg(F.count_distinct("lang")).first()[0]
    each = min(chars, max(100, total // max(1, n)))
    mark = F.xxhash64("doc_id", "lang", "text", F.lit(11)).alias("mark")
    long = (F.char_length("text") > longest).alias("long")
    slim = known.select("lang", mark, long, F.char_length("text").alias("n"))
    order = Window.partitionBy("lang").orderBy("long", "mark")
    first = slim.withColumn("place", F.row_number().over(order)).where(F.col("place") <= documents)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    chosen = first.withColumn("before", before).where(F.col("before") < each)  # at most ``documents`` rows a language
    marks = chosen.select(F.col("mark").alias("of")).distinct()
    rows = known.select("lang", mark, long, F.substring("text", 1, each).alias("text")).join(F.broadcast(marks), F.col("mark") == F.col("of")).distinct().collect()
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["long"], r["mark"], r["text"])):
        texts[r["lang"]] = (texts.get(r["lang"], "") + r["text"] + "\n")[:each]
    return texts


def identify(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from a bounded sample of rows with a lang whose crc32(doc_id) mod ``folds`` isn't ``held`` (see
    ``labelled_text``, which takes ``options``); a prediction sees the text alone, all of it. ``und`` with score 0 if the
    text is null, empty or has no letter, or if no language is known; ties go to the language first in order. Repeated
    rows each have their row; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.sparkSession.sparkContext.broadcast(tuple(sorted(labelled_text(docs, folds, held, **options).items())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts.value)
        for batch in batches:
            own = batch.column(2).dictionary_encode()
            found = [parser.predict(t) for t in own.dictionary.to_pylist()]
            at = own.indices.to_pylist()
            lang, score = ([("und", 0.0)[k] if i is None else found[i][k] for i in at] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "text").mapInArrow(work, SCHEMA)
