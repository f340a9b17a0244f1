"""Alignment of the tokens of two tokenizers, relationally.

No token of either tokenizer reaches over the space between two words. So a text is cut before each such space, and a
block of texts, what one task reads up to a number of characters, encodes each distinct word once. How the tokens of a
word line up depends on their byte lengths alone: words with the same lengths have one shape. The corpus has far fewer
shapes than words, and these are aligned as relations: lengths are exploded with their positions, summed over windows to
byte offsets, an equality join on shape and offset finds where both tokenizers end, running counts of these cuts number
the groups, and a join on the group says how many tokens of each side it links.

A block then reads its words' groups off their shapes: links are pairs of ids with their times, texts that hold a pair are
counted in each block and summed over blocks, and a text's results are sums over its words. What is shuffled is a block's
numbers, in as few bytes as they need, not texts, tokens or links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import PATTERN, Bpe
from quarry.llm.kneser_ney import _unzip, _zip
from quarry.llm.storage import Scratch

#: A text after a space, cut before spaces that follow something else than white space and the sign that stands for a space.
SPACE = "▁"
WORD = re.compile(rf" +[^ ]*(?:(?<=[\s{SPACE}]) +[^ ]*)*")

#: Rows of a block: texts (ids; words, words a text; the distinct ones of each, ascending, as differences, and how many), words
#: (ids of A and B, how many, shapes), shapes (byte lengths, parted by commas).
CODED = "block long, kind int, number int, ids array<long>, data array<binary>, distinct array<binary>, a_len string, b_len string"
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.string(), pa.string()]
TEXTS, WORDS, SHAPES = range(3)
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _parts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones included."""
    return np.diff(np.append(0, values.cumsum())[np.append(0, sizes.cumsum())])


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    ends = sizes.cumsum()
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pair:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        byte_bpe, self.b = Bpe(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        made = [c for _, _, c in byte_bpe.merges]
        if made != sorted(made):
            raise ValueError("ids of this vocabulary aren't in the order of its merges")
        plain = {raw: i for i, raw in byte_bpe.bytes_of.items() if i not in byte_bpe.special.values()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        piece, size = self.b.id_to_piece, self.b.vocab_size()
        if any(SPACE in piece(i).lstrip(SPACE) for i in range(size)):
            raise ValueError("a piece of this vocabulary reaches over a space between words")
        self.len_a = np.zeros(1 + max(plain.values()), np.int64)
        self.len_a[list(plain.values())] = list(map(len, plain))
        self.len_b = np.array([1 if self.b.is_byte(i) else len(piece(i).replace(SPACE, " ").encode()) for i in range(size)], np.int64)
        self.space = self.b.piece_to_id(SPACE)

    def _encode_a(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that end in something else than white space can stand behind each other: no token reaches into the next."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.a.encode_ordinary("".join(words)), np.int64)
        ends = np.searchsorted(self.len_a[ids].cumsum(), sizes.cumsum()) + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each word has, and the same of B. A word whose bytes B doesn't give back has none of either:
        A's always are, and B's are as many as the word's unless it holds the sign that stands for a space."""
        sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        alone = np.fromiter((w[-1].isspace() for w in words), bool, len(words))
        own, rest = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
        a, n = self._encode_a([words[k] for k in own.tolist()], sizes[own])
        a_n = np.zeros(len(words), np.int64)
        a_n[own] = n
        if rest:  # few: the ends of some texts
            lists = [self.a.encode_ordinary(words[k]) for k in rest]
            a_n[rest] = list(map(len, lists))
            both = np.zeros(int(a_n.sum()), np.int64)
            starts = a_n.cumsum() - a_n
            both[_places(starts[own], n)], both[_places(starts[rest], a_n[rest])] = a, list(chain.from_iterable(lists))
            a = both
        # B puts a space ahead by itself, but has no ids for an empty text
        lists = self.b.encode([w[1:] for w in words], num_threads=1)
        b_n = np.fromiter(map(len, lists), np.int64, len(lists))
        if (b_n == 0).any():
            lists = [own or [self.space] for own in lists]
            b_n = np.maximum(b_n, 1)
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(b_n.sum()))
        sound = (_parts(self.len_a[a], a_n) == sizes) & (_parts(self.len_b[b], b_n) == sizes)
        if not sound.all():
            a, b = a[np.repeat(sound, a_n)], b[np.repeat(sound, b_n)]
            a_n, b_n = np.where(sound, a_n, 0), np.where(sound, b_n, 0)
        return a, a_n, b, b_n


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=[f.split()[0] for f in CODED.split(", ")])


class Coder:
    """Gathers the texts of a block."""

    def __init__(self, pair: Pair, block: int):
        self.pair, self.block = pair, block
        self.number: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number = self.number
        own = [number.setdefault(w, len(number)) for w in WORD.findall(" " + text)] if text else []
        self.ids.append(doc_id)
        self.words.append(np.array(own, np.int32))
        self.chars += len(text or "")

    def rows(self, texts: int = 4096, words: int = 65_536) -> Iterator[pa.RecordBatch]:
        names, sound, shapes = list(self.number), [], {}
        self.number = {}
        for k in range(0, len(names), words):
            a, a_n, b, b_n = self.pair.encode(names[k : k + words])
            sound.append(a_n > 0)
            cut = lambda ids, n, lengths: (lengths[ids].astype(np.uint16).tobytes(), (2 * np.append(0, n.cumsum())).tolist())
            (raw_a, at_a), (raw_b, at_b) = cut(a, a_n, self.pair.len_a), cut(b, b_n, self.pair.len_b)
            keys = zip(pairwise(at_a), pairwise(at_b), strict=True)
            shape = np.array([shapes.setdefault((raw_a[s:e], raw_b[u:v]), len(shapes)) for (s, e), (u, v) in keys], np.int64)
            yield _rows([(self.block, WORDS, k, None, list(map(_zip, (a, a_n, b, b_n, shape))), None, None, None)])
        good = np.concatenate(sound) if sound else np.zeros(0, bool)
        lengths = lambda raw: ",".join(map(str, np.frombuffer(raw, np.uint16).tolist()))
        listed = [(self.block, SHAPES, k, None, None, None, lengths(a), lengths(b)) for k, (a, b) in enumerate(shapes) if a]
        for k in range(0, len(listed), 10_000):
            yield _rows(listed[k : k + 10_000])
        for k in range(0, len(self.ids), texts):
            own = [w if good[w].all() else w[:0] for w in self.words[k : k + texts]]  # a text with a word whose bytes differ has no tokens
            sets = list(map(np.unique, own))
            sizes, counts = (np.fromiter(map(len, x), np.int64, len(own)) for x in (own, sets))
            distinct = [_zip(np.concatenate([np.diff(x, prepend=0) for x in sets])), _zip(counts)]
            yield _rows([(self.block, TEXTS, k, self.ids[k : k + texts], [_zip(np.concatenate(own)), _zip(sizes)], distinct, None, None)])


def code_texts(docs: DataFrame, path_a: str, path_b: str, chars: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        coder = Coder(_pair(path_a, path_b), first)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coder.add(i, t.as_py())
                if coder.chars >= chars:
                    yield from coder.rows()
                    coder = Coder(coder.pair, coder.block + 1)
        if coder.ids:
            yield from coder.rows()

    return docs.select("doc_id", "text").mapInArrow(work, CODED)


def aligned(shapes: DataFrame) -> DataFrame:
    """Of shapes (shape, a_len, b_len): shape and how many tokens A and B have in each of its groups, in order, parted by
    commas as the lengths are."""
    by_shape = Window.partitionBy("shape").orderBy("pos")
    upto, before = by_shape.rowsBetween(Window.unboundedPreceding, 0), by_shape.rowsBetween(Window.unboundedPreceding, -1)

    def tokens(lengths: str) -> DataFrame:
        exploded = shapes.select("shape", F.posexplode(F.split(lengths, ",").cast("array<int>")).alias("pos", "len"))
        return exploded.select("shape", "pos", F.sum("len").over(upto).alias("end"))

    a, b = tokens("a_len"), tokens("b_len")
    cuts = a.select("shape", "end").join(b.select("shape", "end"), ["shape", "end"]).withColumn("cut", F.lit(1))

    def sizes(own: DataFrame, name: str) -> DataFrame:
        marked = own.join(cuts, ["shape", "end"], "left")
        grouped = marked.select("shape", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("g"))
        return grouped.groupBy("shape", "g").agg(F.count("*").alias(name))

    linked = sizes(a, "a").join(sizes(b, "b"), ["shape", "g"])
    in_order = linked.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return in_order.select("shape", joined("groups.a").alias("groups_a"), joined("groups.b").alias("groups_b"))


class Block:
    """A block's texts and words, with the groups of their shapes."""

    def __init__(self, coded: pa.Table, shapes: pa.Table):
        rows = sorted(coded.to_pylist(), key=lambda r: (r["kind"], r["number"]))
        texts, words = [r for r in rows if r["kind"] == TEXTS], [r for r in rows if r["kind"] == WORDS]
        join = lambda rows, k: np.concatenate([_unzip(r["data"][k]) for r in rows]) if rows else np.zeros(0, np.int64)
        self.ids = [i for r in texts for i in r.get("ids") or ()]
        self.words, self.sizes = join(texts, 0), join(texts, 1)
        self.a, self.a_n, self.b, self.b_n, shape = (join(words, k) for k in range(5))
        number, counts, flat = self._shapes(shapes)
        size = np.zeros(1 + int(max(shape.max(initial=0), number.max(initial=0))), np.int64)
        size[number] = counts
        start = np.zeros_like(size)
        start[number] = counts.cumsum() - counts
        #: of each word its groups, and of each group its word and its tokens
        self.groups = size[shape]
        at = _places(start[shape], self.groups)
        self.word, self.of_a, self.of_b = np.repeat(np.arange(len(shape)), self.groups), flat[0][at], flat[1][at]

    @staticmethod
    def _shapes(shapes: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Numbers of the shapes, how many groups each has, and the groups' tokens of A and B."""
        if not shapes.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 2
        texts = [",".join(shapes[c].to_pylist()) for c in ("groups_a", "groups_b")]
        counts = np.array(pc.add(pc.count_substring(shapes["groups_a"], ","), 1)).astype(np.int64)
        return shapes["number"].to_numpy().astype(np.int64), counts, [np.array(t.split(","), np.int64) for t in texts]

    def links(self, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, pair of ids as one number, times). Of a group of over ``most`` links each pair of ids is there once."""
        start_a, start_b = self.of_a.cumsum() - self.of_a, self.of_b.cumsum() - self.of_b
        number = self.of_a * self.of_b
        own = np.flatnonzero(number <= most)
        group, k = np.repeat(own, number[own]), _places(np.zeros(len(own), np.int64), number[own])
        found = [(self.word[group], self.a[start_a[group] + k // self.of_b[group]] << 32 | self.b[start_b[group] + k % self.of_b[group]], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(number > most).tolist():
            a, n_a = np.unique(self.a[start_a[g] : start_a[g] + self.of_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[start_b[g] : start_b[g] + self.of_b[g]], return_counts=True)
            pairs = (a[:, None] << 32 | b[None, :]).ravel()
            found.append((np.full(len(pairs), self.word[g]), pairs, (n_a[:, None] * n_b[None, :]).ravel()))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids, ascending, and how many of the texts hold each; of a block that was made from distinct words."""
        word, key, _ = self.links()
        names, pair = np.unique(key, return_inverse=True)
        order = np.argsort(word, kind="stable")
        pair, at = pair[order], np.searchsorted(word[order], np.arange(len(self.groups) + 1))
        held = np.zeros(len(names), np.int64)
        for s, e in pairwise(np.append(0, self.sizes.cumsum()).tolist()):
            if e > s:
                own = self.words[s:e].cumsum()  # distinct words come as differences
                held[np.unique(pair[_places(at[own], at[own + 1] - at[own])])] += 1
        return names, held

    def shown(self) -> list[str]:
        """Of each word its groups: ids of A, a bar, ids of B, parted by semicolons."""
        names = np.array(list(map(str, range(1 + int(max(self.a.max(initial=0), self.b.max(initial=0)))))), object)
        a, b = names[self.a].tolist(), names[self.b].tolist()  # one string for each id
        out: list[list[str]] = [[] for _ in range(len(self.groups))]
        x = y = 0
        for w, n_a, n_b in zip(self.word.tolist(), self.of_a.tolist(), self.of_b.tolist(), strict=True):
            out[w].append(f"{a[x]}|{b[y]}" if n_a == n_b == 1 else f"{','.join(a[x : x + n_a])}|{','.join(b[y : y + n_b])}")
            x, y = x + n_a, y + n_b
        return list(map(";".join, out))

    def results(self, names: np.ndarray, count: np.ndarray, best: np.ndarray) -> pa.Table:
        """The texts' rows. names: the pairs of ids, ascending, with how many texts of the corpus hold them and whether that
        is the most of A's id."""
        word, key, times = self.links()
        pair, n = np.searchsorted(names, key), len(self.groups)
        exact = lambda weights: np.bincount(word, weights, n).astype(np.int64)  # noqa: E731  sums below 2**53
        per_word = (self.a_n, self.b_n, self.groups, exact(times), exact(times * best[pair]) if len(pair) else exact(times), exact(times * count[pair]) if len(pair) else exact(times))
        shown = self.shown()
        digests = [hashlib.sha256(";".join(map(shown.__getitem__, self.words[s:e].tolist())).encode()).hexdigest() if e > s else "" for s, e in pairwise(np.append(0, self.sizes.cumsum()).tolist())]
        sums = {c: _parts(v[self.words], self.sizes) for c, v in zip(SUMS, per_word, strict=True)}
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), **sums, "groups_sha256": pa.array(digests, pa.string())})


def _count_texts(key: tuple, coded: pa.Table, shapes: pa.Table) -> pa.Table:
    names, held = Block(coded, shapes).held()
    return pa.table({"block": pa.array([key[0].as_py()] * len(names), pa.int64()), "a": pa.array(names >> 32, pa.int32()), "b": pa.array(names & 0xFFFFFFFF, pa.int32()), "held": held})


def _sum_texts(key: tuple, coded: pa.Table, known: pa.Table) -> pa.Table:
    """known: the block's shapes, which have a number, and its pairs of ids."""
    shapes, pairs = known.filter(pc.is_valid(known["number"])), known.filter(pc.is_null(known["number"]))
    names = pairs["a"].to_numpy().astype(np.int64) << 32 | pairs["b"].to_numpy().astype(np.int64)
    order = np.argsort(names)
    best = pairs["is_best"].to_numpy(zero_copy_only=False).astype(np.int64)
    return Block(coded, shapes).results(names[order], pairs["count"].to_numpy()[order], best[order])


def _by_block(left: DataFrame, right: DataFrame, work: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(work, schema)


def link_tokens(docs: DataFrame, path_a: str, path_b: str, chars: int = 4_000_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` names a byte-level BPE vocabulary and ``path_b`` a sentencepiece model, which every worker reads from its
    own installation. A encodes a space and the text, B the text; strings of special tokens in a text are plain text.
    Where tokens of both end at the same byte, the text is cut into groups; all tokens of A and B in a group are linked.
    n_links counts links with repeats; count_sum adds up, over links, how many texts hold the link's two ids linked, and
    n_best counts links for which that is the most that any link of A's id has.

    Texts that are null or empty, and those that either tokenizer doesn't give back byte by byte, have no tokens: zeros
    and ''. Null ids stay null, repeated rows are texts each, an empty table gives an empty result, and other columns are
    ignored. A task holds a block of ``chars`` characters, or one text if that is longer.
    """
    scratch = Scratch(docs.sparkSession, "align", tidy=True)
    coded = scratch.store(code_texts(docs, path_a, path_b, chars))
    lengths = coded.where(F.col("kind") == SHAPES).select("block", "number", "a_len", "b_len")
    shapes = scratch.store(lengths.select("a_len", "b_len").distinct().withColumn("shape", F.monotonically_increasing_id()))
    groups = shapes.join(aligned(shapes), "shape").select("a_len", "b_len", "groups_a", "groups_b")
    known = scratch.store(lengths.join(groups, ["a_len", "b_len"]).select("block", "number", "groups_a", "groups_b"))
    rows = coded.where(F.col("kind") != SHAPES)
    sets = rows.select("block", "kind", "number", F.coalesce("distinct", "data").alias("data"))
    held = scratch.store(_by_block(sets, known, _count_texts, "block long, a int, b int, held long"))
    counts = scratch.store(held.groupBy("a", "b").agg(F.sum("held").alias("count")))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    rated = scratch.store(counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best")))
    in_block = scratch.store(held.select("block", "a", "b").join(rated, ["a", "b"]))
    scratch.keep(coded, known, in_block)
    return _by_block(rows.select("block", "kind", "number", "ids", "data"), known.unionByName(in_block, allowMissingColumns=True), _sum_texts, OUT)
