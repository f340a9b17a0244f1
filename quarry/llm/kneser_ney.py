"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and looked up in memory-mapped sorted hash arrays.

Neither the model nor the queries fit into a worker, so both meet in shards. Documents are coded once into blocks: a
block's distinct words, and a number for each token. First, shards of words count them and number them over the whole
input, frequent ones with small numbers, so that n-grams of numbers take a few bytes.

Then, from the highest order down, a block sends each shard of that order its distinct n-grams, once each, in the highest
order with their training count. A shard adds them up, writes its part of the model to files of its own as sorted hashes
with counts, maps them into memory, looks up every block's n-grams in them, and answers with counts. It also passes on,
by n-gram of the order below, after how many different words each one stands: these are the counts of that order.
Last, each block gets the answers for its n-grams and scores its documents.

An n-gram crosses the network once for each block that holds it, however often it stands there. N-grams are dealt by
their context, all but the last word. A word that has more tokens than a shard should hold is split: contexts of such words
alone are dealt over several shards by the last word, and their sums go to the shard of the context itself, which is an
n-gram of the order below, to be added up there.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch, crc_mod, sql_lower_ascii

#: No word holds white space: this stands for a document's end. What precedes its first word has the number 0.
END, START = b"\n", 0
ROWS = "block long, level int, kind int, shard long, parts array<binary>, totals array<long>"
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
NAMES = ["block", "level", "kind", "shard", "parts", "totals"]
DOCS, ASK, FOLLOW, SPLIT, ANSWER, TOTALS, HEAVY = range(7)


def _zip(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as many bytes as the largest needs, one plane after the other, compressed."""
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * n)
    planes = values.astype(f"<u{size}").reshape(-1).view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(data: bytes, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{data[0]}").astype(dtype)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, and where in it each distinct one begins; and these."""
    order = np.argsort(keys)
    found = keys[order]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    return order, starts, found[starts]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(words: list[np.ndarray]) -> np.ndarray:
    """64 bits that tell n-grams, given word by word, apart."""
    key = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        key = _mix(key, w)
    return key


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES], names=NAMES)


class Deal:
    """Where n-grams go: numbers of shards, and the words that are split, with the number of shards of each."""

    def __init__(self, shards: int, heavy: np.ndarray, ways: np.ndarray):
        self.shards = shards
        #: ways by word; frequent words have small numbers, and the last entry stands for all beyond
        self.ways = np.ones(int(heavy.max(initial=0)) + 2, np.int64)
        self.ways[heavy] = ways

    def ways_of(self, words: list[np.ndarray]) -> np.ndarray:
        """Over how many shards the n-grams of a context go: an upper bound of its tokens is that of its rarest word."""
        least = np.full(len(words[0]), self.shards, np.int64)
        for w in words:
            least = np.minimum(least, self.ways[np.minimum(w, len(self.ways) - 1)])
        return least

    def shard_of(self, context: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        if not context:
            return word % self.shards
        spread = _mix(word, np.full(len(word), 7, np.uint64)) % self.ways_of(context).astype(np.uint64)
        return ((_key(context) + spread) % np.uint64(self.shards)).astype(np.int64)


def code_documents(docs: DataFrame, folds: int, tokens: int) -> DataFrame:
    """Blocks of about ``tokens`` tokens: ids, held, lengths, hashes of the words, and the tokens as word numbers."""

    def block(number: int, ids: list, held: list, lengths: list[int], numbers: list[np.ndarray], words: dict[bytes, int]) -> pa.RecordBatch:
        flat = np.concatenate(numbers)
        counts = np.bincount(flat, minlength=len(words))
        rank = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[rank]
        place = np.empty(len(words), np.int32)
        place[rank] = np.arange(len(words), dtype=np.int32)
        columns = [[number], [len(flat)], [pickle.dumps((ids, held, lengths))], [hashes.tobytes()], [_zip(place[flat])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["block", "n", "docs", "words", "tokens"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, held, lengths, numbers, words = [], [], [], [], defaultdict(count().__next__)
        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                split = text.as_py().encode("utf-8", "surrogatepass").lower().split() if text.is_valid else []
                split.append(END)
                numbers.append(np.fromiter(map(words.__getitem__, split), np.int32, len(split)))
                ids.append(i)
                held.append(h)
                lengths.append(len(split))
                size += len(split)
                if size >= tokens:
                    yield block(number, ids, held, lengths, numbers, words)
                    number, size = number + 1, 0
                    ids, held, lengths, numbers, words = [], [], [], [], defaultdict(count().__next__)
        if ids:
            yield block(number, ids, held, lengths, numbers, words)

    read = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held"), "text")
    return read.mapInArrow(work, "block long, n long, docs binary, words binary, tokens binary")


def _by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Shards and the positions that go there, in order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[own[0]]), own) for own in np.split(order, cuts) if len(own)]


def _trains(held: list[bool], lengths: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(held, bool), lengths)


def ask_words(row: dict, shards: int) -> Iterator[tuple]:
    """A block's words, with their tokens in all and in training."""
    _, held, lengths = pickle.loads(row["docs"])
    hashes, tokens = np.frombuffer(row["words"], np.uint64), _unzip(row["tokens"], np.int32)
    total = np.bincount(tokens, minlength=len(hashes)).astype(np.int64)
    train = np.bincount(tokens, _trains(held, np.array(lengths, np.int64)), len(hashes)).astype(np.int64)
    for shard, own in _by_shard((hashes % np.uint64(shards)).astype(np.int64)):
        yield row["block"], 0, ASK, shard, [hashes[own].tobytes(), _zip(total[own]), _zip(train[own])], None


def number_words(table: pa.Table, shards: int, most: int) -> pa.Table:
    """A shard of words: numbers them, the most frequent first, and answers with numbers and training counts. Words of
    over ``most`` tokens are named."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    shard = rows[0]["shard"]
    asked = [np.frombuffer(r["parts"][0], np.uint64) for r in rows]
    words, of = np.unique(np.concatenate(asked), return_inverse=True)
    total, train = (np.bincount(of, np.concatenate([_unzip(r["parts"][k]) for r in rows]), len(words)).astype(np.int64) for k in (1, 2))
    number = np.empty(len(words), np.int64)
    number[np.lexsort((words, -total))] = 1 + shard + shards * np.arange(len(words), dtype=np.int64)
    out = [(-1, 0, TOTALS, shard, None, [int(train.sum()), int((train > 0).sum())])]
    out += [(-1, 0, HEAVY, shard, None, [int(number[k]), int(total[k])]) for k in np.flatnonzero(total > most)]
    for r, own in zip(rows, np.split(of, np.cumsum([len(a) for a in asked])[:-1]), strict=True):
        out.append((r["block"], 0, ANSWER, shard, [_zip(number[own]), _zip(train[own])], None))
    return _table(out)


def put_numbers(table: pa.Table, shards: int) -> pa.Table:
    """A block with its words' numbers and training counts in place of their hashes."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["kind"] == DOCS)
    docs, hashes, tokens = head["parts"]
    hashes = np.frombuffer(hashes, np.uint64)
    number, train = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    at = dict(_by_shard((hashes % np.uint64(shards)).astype(np.int64)))
    for r in rows:
        if r["kind"] == ANSWER:
            number[at[r["shard"]]], train[at[r["shard"]]] = _unzip(r["parts"][0]), _unzip(r["parts"][1])
    return pa.table({"block": pa.array([head["block"]], pa.int64()), "parts": pa.array([[docs, tokens, _zip(number), _zip(train)]], pa.list_(pa.binary()))})


class Block:
    """A block's distinct n-grams of orders 1 to ``upto``, all that there are unless it is given, and where they go. Order 1
    is its words."""

    def __init__(self, parts: list[bytes], order: int, deal: Deal, upto: int | None = None):
        self.ids, self.held, lengths = pickle.loads(parts[0])
        self.lengths = np.array(lengths, np.int64)
        tokens, self.train_words = _unzip(parts[1], np.int32).astype(np.int64), _unzip(parts[3])
        words = np.append(_unzip(parts[2]), START)
        first = np.zeros(len(tokens), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        v = len(words)
        #: by order: numbers of the n-grams' words; the last n-gram is that of starts alone, a context
        self.words: list[list[np.ndarray]] = [[], [words]]
        #: by order: which n-gram ends at each token; of each n-gram its context and, one order below, its suffix
        self.at, self.context, self.suffix = [None, tokens], [None, None], [None, None]
        for k in range(2, (upto or order) + 1):
            before = np.empty(len(tokens), np.int64)
            before[1:] = self.at[-1][:-1]
            before[first] = len(self.words[-1][0]) - 1
            order_of, starts, gram = _distinct(before * v + tokens)
            at = np.empty(len(tokens), np.int64)
            at[order_of] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
            context, target, suffix = gram // v, gram % v, self.at[-1][order_of[starts]]
            if k < order:
                context, target, suffix = np.append(context, len(self.words[-1][0]) - 1), np.append(target, v - 1), np.append(suffix, len(self.words[-1][0]) - 1)
            self.words.append([*(w[context] for w in self.words[-1]), words[target]])
            self.at.append(at)
            self.context.append(context)
            self.suffix.append(suffix)
        self.deal, self.order = deal, order

    def dealt(self, k: int) -> list[tuple[int, np.ndarray]]:
        """Shards of order k and the n-grams that go there, those of a context in a row."""
        *context, word = self.words[k]
        return _by_shard(self.deal.shard_of(context, word))

    def runs(self, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams in a row: where a new context begins, and how many each has."""
        of = self.context[k][own]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        return starts, np.diff(np.append(starts, len(of)))

    def split(self, k: int, own: np.ndarray) -> np.ndarray:
        """Which of the n-grams are contexts that are split."""
        return np.flatnonzero(self.deal.ways_of([w[own] for w in self.words[k]]) > 1) if k < self.order else np.zeros(0, np.int64)

    def asks(self, block: int, k: int) -> Iterator[tuple]:
        if k == 1:
            for shard, own in self.dealt(1):
                yield block, 1, ASK, shard, [_zip(self.words[1][0][own])], None
            return
        trains = np.bincount(self.at[k], _trains(self.held, self.lengths), len(self.words[k][0])).astype(np.int64) if k == self.order else None
        *context, word = self.words[k]
        for shard, own in self.dealt(k):
            starts, runs = self.runs(k, own)
            parts = [_zip(runs), _zip(word[own]), *(_zip(w[own][starts]) for w in context)]
            yield block, k, ASK, shard, [*parts, _zip(trains[own])] if k == self.order else parts, None


class Mapped:
    """Sorted hashes and arrays beside them, in files that are mapped into memory."""

    def __init__(self, folder: str, name: str, keys: np.ndarray, values: list[np.ndarray]):
        self.keys, *self.values = (self._mapped(os.path.join(folder, f"{name}{k}"), x) for k, x in enumerate([keys, *values]))

    def _mapped(self, path: str, values: np.ndarray) -> np.ndarray:
        values.tofile(path)
        return np.memmap(path, values.dtype, "r") if len(values) else values

    def __call__(self, asked: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(asked), v.dtype) for v in self.values]
        order = np.argsort(asked)  # in order, neighbouring look-ups touch neighbouring pages
        at = np.empty(len(asked), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, asked[order]), len(self.keys) - 1)
        hit = self.keys[at] == asked
        return [np.where(hit, v[at], 0).astype(v.dtype) for v in self.values]


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place where each stands, and the sums of the values, a row for each of their rows."""
    order, starts, unique = _distinct(np.concatenate([np.zeros(0, np.uint64), *keys]))
    rows = np.concatenate([np.zeros((values[0].shape[0] if values else 1, 0), np.int64), *values], axis=1)
    sums = np.stack([np.add.reduceat(r[order], starts) for r in rows]) if len(starts) else rows
    return unique, order[starts], sums.astype(np.int64)


def sum_grams(table: pa.Table, k: int, order: int, deal: Deal) -> pa.Table:
    """A shard of n-grams of order k, at least 2: builds its part of the model, answers the blocks, tells the order below."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
    shard = rows[0]["shard"]
    asks, keys, words, counts, places = [], [], [], [], []
    contexts: list[list[np.ndarray]] = [[] for _ in range(k - 1)]  # a row for each context that counts are told of
    context_keys, n_contexts = [], 0
    for r in rows:
        if r["kind"] == SPLIT:
            continue
        if r["kind"] == FOLLOW:
            n, word, *own = map(_unzip, r["parts"])
            runs = np.ones(len(word), np.int64)
        else:
            runs, word, *own = map(_unzip, r["parts"])
            n = own.pop() if k == order else None
        own_keys, of = _key(own), np.repeat(np.arange(len(runs)), runs)
        gram_keys = _mix(own_keys[of], word)
        if r["kind"] == ASK:
            split = deal.ways_of([*(w[of] for w in own), word]) > 1 if k < order else None
            asks.append((r["block"], own_keys, gram_keys, split))
        if n is not None:
            some = np.flatnonzero(n)
            keys.append(gram_keys[some])
            words.append(word[some])
            counts.append(n[some][None])
            places.append(n_contexts + of[some])
            context_keys.append(own_keys)
            for held, w in zip(contexts, own, strict=True):
                held.append(w)
            n_contexts += len(runs)
    unique, at, total = _sums(keys, counts)
    total, none = total[0], np.zeros(0, np.int64)
    place = np.concatenate([none, *places])[at]
    context = [np.concatenate([none, *held])[place] for held in contexts]
    word = np.concatenate([none, *words])[at]
    keys = np.concatenate([np.zeros(0, np.uint64), *context_keys])[place]
    del words, counts, places, contexts, context_keys
    held, first, sums = _sums([keys], [np.stack([total, total == 1, total == 2, total >= 3]).astype(np.int64)])
    out = [(-1, k, TOTALS, shard, None, [int((total == x).sum()) for x in (1, 2, 3, 4)])]
    split = [(_unzip(r["parts"][0]).reshape(4, -1), [_unzip(p) for p in r["parts"][1:]]) for r in rows if r["kind"] == SPLIT]
    split_keys, _, split_sums = _sums([_mix(_key(c[:-1]), c[-1]) for _, c in split], [s for s, _ in split]) if split else (np.zeros(0, np.uint64), none, np.zeros((4, 0), np.int64))
    with tempfile.TemporaryDirectory() as folder:  # this shard's part of the model
        of_gram, of_context, of_split = Mapped(folder, "grams", unique, [total]), Mapped(folder, "contexts", held, list(sums)), Mapped(folder, "split", split_keys, list(split_sums))
        for block, own_keys, gram_keys, is_split in asks:
            parts = [_zip(of_gram(gram_keys)[0]), _zip(np.concatenate(of_context(own_keys)))]
            if k < order:
                parts.append(_zip(np.concatenate(of_split(gram_keys[is_split]))))
            out.append((block, k, ANSWER, shard, parts, None))
        del of_gram, of_context, of_split
    # after how many different words the n-grams of the order below stand
    below, first_at, n = _sums([_mix(_key(context[1:]), word) if k > 2 else word.astype(np.uint64)], [np.ones((1, len(word)), np.int64)])
    lower = [*(c[first_at] for c in context[1:]), word[first_at]]
    for to, own in _by_shard(deal.shard_of(lower[:-1], lower[-1])):
        out.append((-1 - shard, k - 1, FOLLOW, to, [_zip(n[0][own]), _zip(lower[-1][own]), *(_zip(c[own]) for c in lower[:-1])], None))
    # sums of contexts that are split, for the shard of the context itself
    gram = [c[first] for c in context]
    some = np.flatnonzero(deal.ways_of(gram) > 1)
    gram = [c[some] for c in gram]
    for to, own in _by_shard(deal.shard_of(gram[:-1], gram[-1])):
        out.append((-1 - shard, k - 1, SPLIT, to, [_zip(sums[:, some[own]]), *(_zip(c[own]) for c in gram)], None))
    return _table(out)


def sum_words(table: pa.Table, deal: Deal) -> pa.Table:
    """A shard of words: after how many different words each one stands, and the sums of words that are split."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
    shard = rows[0]["shard"]
    of = lambda kind: [[_unzip(p) for p in r["parts"]] for r in rows if r["kind"] == kind]
    words, _, times = _sums([w.astype(np.uint64) for _, w in of(FOLLOW)], [n[None] for n, _ in of(FOLLOW)])
    split, _, sums = _sums([w.astype(np.uint64) for _, w in of(SPLIT)], [s.reshape(4, -1) for s, _ in of(SPLIT)]) if of(SPLIT) else (np.zeros(0, np.uint64), None, np.zeros((4, 0), np.int64))
    times = times[0]
    out = [(-1, 1, TOTALS, shard, None, [int(times.sum()), *(int((times == x).sum()) for x in (1, 2, 3, 4)), int((times >= 3).sum())])]
    with tempfile.TemporaryDirectory() as folder:
        of_word, of_split = Mapped(folder, "words", words, [times]), Mapped(folder, "split", split, list(sums))
        for r in rows:
            if r["kind"] == ASK:
                asked = _unzip(r["parts"][0])
                hot = asked[deal.ways_of([asked]) > 1].astype(np.uint64)
                out.append((r["block"], 1, ANSWER, shard, [_zip(of_word(asked.astype(np.uint64))[0]), _zip(np.concatenate(of_split(hot)))], None))
        del of_word, of_split
    return _table(out)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from how many events occur once to four times; 0 is for count 0."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))])


def score_block(table: pa.Table, order: int, deal: Deal, totals: dict[int, list[int]]) -> pa.Table:
    """totals: of order 0 training tokens and words; of the others as the shards tell."""
    rows = table.to_pylist()
    own = Block(next(r for r in rows if r["kind"] == DOCS)["parts"], order, deal)
    counts = [None, *(np.zeros(len(w[0]), np.int64) for w in own.words[1:])]
    #: by order: of each n-gram what follows it: in all, and how many words once, twice, and three times or more
    sums = [None, *(np.zeros((4, len(w[0])), np.int64) for w in own.words[1:-1])]
    at = [None, *(dict(own.dealt(k)) for k in range(1, order + 1))]
    # sums of contexts that aren't split come from the order above; of split ones from their own, so they go last
    for r in sorted((r for r in rows if r["kind"] == ANSWER), key=lambda r: -r["level"]):
        k, grams = r["level"], at[r["level"]][r["shard"]]
        counts[k][grams] = _unzip(r["parts"][0])
        if k > 1:
            starts, _ = own.runs(k, grams)
            sums[k - 1][:, own.context[k][grams[starts]]] = _unzip(r["parts"][1]).reshape(4, -1)
        if k < order:
            split = own.split(k, grams)
            sums[k][:, grams[split]] = _unzip(r["parts"][-1]).reshape(4, -1)
    n_train, types = totals[0]
    base = np.log10((own.train_words + 0.1) / (n_train + 0.1 * (types + 1)))
    n_follow, k1, k2, k3, k4, more = totals[1]
    if n_follow:
        d = _discounts(k1, k2, k3, k4)
        spare = float(d[1] * k1 + d[2] * k2 + d[3] * more) / n_follow
        chance = (counts[1] - d[np.minimum(counts[1], 3)]).clip(0) / n_follow + spare / (types + 1)
    else:
        chance = np.full(len(counts[1]), 1 / (types + 1))
    for k in range(2, order + 1):
        d = _discounts(*totals[k])
        n, n1, n2, n3 = sums[k - 1][:, own.context[k]]
        gamma = np.divide(d[1] * n1 + d[2] * n2 + d[3] * n3, n, out=np.ones(len(n)), where=n > 0)
        high = np.divide((counts[k] - d[np.minimum(counts[k], 3)]).clip(0), n, out=np.zeros(len(n)), where=n > 0)
        chance = high + gamma * chance[own.suffix[k]]
    by_doc = lambda values: np.add.reduceat(values, np.cumsum(own.lengths) - own.lengths)
    words = own.at[1]
    return pa.table({
        "doc_id": pa.array(own.ids, pa.int64()), "held_out": pa.array(own.held, pa.bool_()), "n_tokens": pa.array(own.lengths),
        "n_known": pa.array(by_doc((own.train_words > 0)[words].astype(np.int64))), "train_tokens": pa.array(np.full(len(own.ids), n_train, np.int64)),
        "base_score": pa.array(by_doc(base[words])), "score": pa.array(by_doc(np.log10(chance)[own.at[order]])),
    })


def _each(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Rows that ``work`` makes of each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            for made in work(batch.slice(k, 1).to_pylist()[0]):
                yield from _table([made]).to_batches()


def score_documents(docs: DataFrame, folds: int = 10, order: int = 3, tokens: int = 1_250_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) mod ``folds`` isn't 0 and scores all. Words are parted by ASCII white space,
    A-Z lower-cased; each text ends with one end token, so a null or empty text has one token. Scores are sums of log10
    probabilities: ``base_score`` of add-0.1 word frequencies, ``score`` of the model of n-grams up to ``order``, 2 at
    least, whose lowest order mixes in a uniform distribution over all words and one unknown. With nothing to learn from
    every token is that unknown. Repeated rows count and score each; an empty table gives an empty result; other columns
    are ignored. ``tokens`` bounds what a block and, on average, a shard hold; a word with more than half as many is split.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kneser-ney")

    def totals_of(table: DataFrame, n: int) -> list[int]:
        row = table.where(F.col("kind") == TOTALS).agg(*(F.sum(F.get("totals", F.lit(i))) for i in range(n))).first()
        return [x or 0 for x in row]

    coded = scratch.store(code_documents(docs, folds, tokens))
    total = coded.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // tokens))
    asked = coded.mapInArrow(lambda batches: _each(batches, lambda r: ask_words(r, shards)), ROWS)
    numbers = scratch.store(asked.groupBy("shard").applyInArrow(lambda t: number_words(t, shards, tokens // 2), ROWS), "kind")
    heads = coded.select("block", F.lit(0).alias("level"), F.lit(DOCS).alias("kind"), F.lit(-1).cast("long").alias("shard"), F.array("docs", "words", "tokens").alias("parts"), F.lit(None).cast("array<bigint>").alias("totals"))
    told = heads.unionByName(numbers.where(F.col("kind") == ANSWER))
    blocks = scratch.store(told.groupBy("block").applyInArrow(lambda t: put_numbers(t, shards), "block long, parts array<binary>"))
    # words of over half a shard: fewer than two a shard
    heavy = [tuple(r["totals"]) for r in numbers.where(F.col("kind") == HEAVY).select("totals").collect()]
    n_docs = docs.count()
    heavy += [(START, n_docs)] if n_docs > tokens // 2 else []
    ways = [min(shards, -(-2 * n // tokens)) for _, n in heavy]
    totals, levels = {0: totals_of(numbers, 2)}, []
    scratch.keep(blocks)
    deal = spark.sparkContext.broadcast(Deal(shards, np.array([w for w, _ in heavy], np.int64), np.array(ways, np.int64)))

    def asks(k: int):
        return lambda batches: _each(batches, lambda r: Block(r["parts"], order, deal.value, k).asks(r["block"], k))

    def sums(k: int):
        return (lambda t: sum_grams(t, k, order, deal.value)) if k > 1 else (lambda t: sum_words(t, deal.value))

    for k in range(order, 0, -1):
        asked = blocks.mapInArrow(asks(k), ROWS)
        rows = asked.unionByName(levels[-1].where(F.col("kind").isin(FOLLOW, SPLIT))) if levels else asked
        levels.append(scratch.store(rows.groupBy("shard").applyInArrow(sums(k), ROWS), "kind"))
        totals[k] = totals_of(levels[-1], 4 if k > 1 else 6)
        scratch.keep(blocks, *levels)
    heads = blocks.select("block", F.lit(0).alias("level"), F.lit(DOCS).alias("kind"), F.lit(-1).cast("long").alias("shard"), "parts", F.lit(None).cast("array<bigint>").alias("totals"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    for table in levels:
        heads = heads.unionByName(table.where(F.col("kind") == ANSWER))
    return heads.groupBy("block").applyInArrow(lambda t: score_block(t, order, deal.value, totals), out)


def _sql_discount(n: str, d: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) >= 3 THEN {d}.d3 WHEN {n} = 2 THEN {d}.d2 WHEN {n} = 1 THEN {d}.d1 ELSE 0 END"


def _sql_level(k: int, lower: str) -> str:
    """The probability of order k, where the context is known; else that of the order below."""
    spare = f"(d{k}.d1 * x{k}.k1 + d{k}.d2 * x{k}.k2 + d{k}.d3 * x{k}.k3) / x{k}.n"
    return f"CASE WHEN x{k}.n > 0 THEN greatest(coalesce(c{k}.n, 0) - {_sql_discount(f'c{k}.n', f'd{k}')}, 0) / x{k}.n + {spare} * {lower} ELSE {lower} END::DOUBLE"


_SUMS = "sum(n)::DOUBLE AS n, count(*) FILTER (WHERE n = 1) AS k1, count(*) FILTER (WHERE n = 2) AS k2, count(*) FILTER (WHERE n >= 3) AS k3"

#: The scores of ``score_documents(docs)``, to six digits; crc32 is spelt out.
ORACLE = f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tbl FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, doc_id IS NULL OR xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10 = 0 AS held_out, list_append(regexp_extract_all({sql_lower_ascii("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM documents, crc),
t AS (SELECT r, held_out, unnest(w) AS a, unnest(range(len(w))) AS i FROM d),
g AS (SELECT r, held_out, a, coalesce(lag(a) OVER o, '') AS b, coalesce(lag(a, 2) OVER o, '') AS c FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c3 AS (SELECT c, b, a, count(*) AS n FROM g WHERE NOT held_out GROUP BY ALL),
c2 AS (SELECT b, a, count(*) AS n FROM c3 GROUP BY ALL),
c1 AS (SELECT a, count(*) AS n FROM c2 GROUP BY ALL),
heard AS (SELECT a, count(*) AS n FROM g WHERE NOT held_out GROUP BY a),
total AS (SELECT coalesce(sum(n), 0)::BIGINT AS train, count(*) AS types FROM heard),
q AS ({" UNION ALL ".join(f"SELECT {k} AS level, " + ", ".join(f"count(*) FILTER (WHERE n = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4)) + f" FROM c{k}" for k in (1, 2, 3))}),
y AS (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END::DOUBLE AS y FROM q),
disc AS (SELECT level, {", ".join(f"least(greatest(CASE WHEN n{i} > 0 THEN {i} - {i + 1} * y * n{i + 1} / n{i} ELSE {i / 2} END, 0.05), {i})::DOUBLE AS d{i}" for i in (1, 2, 3))} FROM y),
{", ".join(f"d{k} AS (SELECT * FROM disc WHERE level = {k})" for k in (1, 2, 3))},
x3 AS (SELECT c, b, {_SUMS} FROM c3 GROUP BY c, b), x2 AS (SELECT b, {_SUMS} FROM c2 GROUP BY b), x1 AS (SELECT {_SUMS} FROM c1),
s AS (SELECT DISTINCT c, b, a FROM g),
p1 AS (SELECT s.*, {_sql_level(1, "(1 / (types + 1))")} AS p FROM s LEFT JOIN c1 USING (a), x1, d1, total),
p2 AS (SELECT p1.c, p1.b, p1.a, {_sql_level(2, "p1.p")} AS p FROM p1 LEFT JOIN c2 ON c2.b = p1.b AND c2.a = p1.a LEFT JOIN x2 ON x2.b = p1.b, d2),
p3 AS (SELECT p2.c, p2.b, p2.a, {_sql_level(3, "p2.p")} AS p FROM p2 LEFT JOIN c3 ON c3.c = p2.c AND c3.b = p2.b AND c3.a = p2.a LEFT JOIN x3 ON x3.c = p2.c AND x3.b = p2.b, d3),
scored AS (SELECT g.r, count(*) AS n_tokens, count(heard.n) AS n_known, sum(log10((coalesce(heard.n, 0) + 0.1::DOUBLE) / (train + 0.1::DOUBLE * (types + 1)))) AS base, sum(log10(p3.p)) AS score
  FROM g JOIN p3 ON p3.c = g.c AND p3.b = g.b AND p3.a = g.a LEFT JOIN heard ON heard.a = g.a, total GROUP BY g.r)
SELECT doc_id, held_out, n_tokens, n_known, train AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM d JOIN scored USING (r), total
"""
