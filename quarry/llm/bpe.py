"""Byte-level BPE encoding and decoding with a pair occurrence index.

A batch's distinct pieces are laid out as one sequence of symbols. An index maps every pair of neighbouring symbols that
has a merge to all its positions; a heap holds the ranks that have any. The lowest rank is taken, its positions are
merged in ascending order, and only the lists of the pairs beside a merged position change. Work follows the merges that
happen, not the length of the sequence times their number.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The split pattern of the vocabulary, and the bytes that its alphabet shows as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Encodes and decodes as the vocabulary file says. A worker that
    remembers more than ``cache`` pieces forgets them before the next batch."""

    def __init__(self, path: str, cache: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.cache_size = spec["model"]["vocab"], cache
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        shown = {b: chr(b) for b in SHOWN}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        byte_of = {c: b for b, c in shown.items()}
        self.byte_ids = [vocab[shown[b]] for b in range(256)]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        #: by rank: left, right and merged id
        self.merges: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.pieces = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.prepare()
        self.forget()

    def prepare(self) -> None:
        """Look-ups that follow from byte_ids and merges."""
        self.base = 1 + max(max(m) for m in self.merges) if self.merges else 1
        keys = np.array([a * self.base + b for a, b, _ in self.merges], np.int64)
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        earliest: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            earliest.setdefault(a, rank)
            earliest.setdefault(b, rank)
        #: ranks whose product takes part in a merge of a lower rank, which must then go first
        self.late = {rank for rank, (_, _, c) in enumerate(self.merges) if earliest.get(c, rank) < rank}

    def forget(self) -> None:
        #: pieces by number, and of each its count of ids, the ids as text, and the bytes that they decode to
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.counts: list[int] = []
        self.shown: list[str] = []
        self.raw: list[bytes] = []

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has no merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: Iterable[str]) -> list[list[int]]:
        """Ids of each piece; all of them share one index."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = sizes.cumsum()
        ids = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(data), np.uint8)]
        after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Puts the pairs that begin at these places into the lists of their ranks."""
            ranks = self._ranks(ids[at], ids[after[at]])
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, places in zip(ranks[starts].tolist(), np.split(at, starts)[1:], strict=True):
                if (have := index.get(rank)) is None:
                    index[rank] = [places]
                    heapq.heappush(heap, rank)
                else:
                    have.append(places)

        if self.merges:
            note(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = self.merges[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            to = after[at]
            # places that went with an earlier merge no longer show this pair
            still = (ids[at] == left) & (to >= 0) & (ids[to] == right)
            at, to = at[still], to[still]
            if left == right and len(at) > 1:
                # in a run of overlapping places every other one is merged, from the left
                chained = np.append(False, at[1:] == to[:-1])
                place = np.arange(len(at))
                odd = (place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 1
                at, to = at[~odd], to[~odd]
            if rank in self.late and len(at) > 1:
                # a lower rank may come up within a piece: only its first place now
                piece = np.searchsorted(ends, at, "right")
                first = np.append(True, piece[1:] != piece[:-1])
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(heap, rank)
                    at, to = at[first], to[first]
            if not len(at):
                continue
            beyond = after[to]
            ids[at], ids[to], after[at] = new, -1, beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            note(np.concatenate([at[inner], ahead[ahead >= 0]]))
        alive = ids >= 0
        kept = np.append(0, alive.cumsum())[np.append(0, ends)]
        flat = ids[alive].tolist()
        return [flat[a:b] for a, b in itertools.pairwise(kept.tolist())]

    def learn(self) -> None:
        """Encodes the pieces that have a number but no ids yet."""
        fresh = list(itertools.islice(self.number, len(self.counts), None))
        for ids in self.encode_pieces(fresh):
            self.counts.append(len(ids))
            self.shown.append(",".join(map(str, ids)))
            self.raw.append(b"".join(map(self.bytes_of.__getitem__, ids)))

    def _parts(self, text: str) -> list[tuple[str | None, list[str]]]:
        """Runs of plain pieces, each before a special token or the end."""
        if self.split_special is None:
            return [(None, self.pieces(text))]
        bits = self.split_special(text)
        return [(bits[k + 1] if k + 1 < len(bits) else None, self.pieces(bits[k])) for k in range(0, len(bits), 2)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for special, pieces in self._parts(text):
            for own in self.encode_pieces(pieces):
                ids += own
            if special is not None:
                ids.append(self.special[special])
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of ids and the digests of the ids and of the text that they decode to."""
        if len(self.number) > self.cache_size:
            self.forget()
        number = self.number.__getitem__
        split = [[(special, np.fromiter(map(number, pieces), np.int32, len(pieces))) for special, pieces in self._parts(t)] for t in texts]
        self.learn()
        counts, shown, raw = self.counts.__getitem__, self.shown.__getitem__, self.raw.__getitem__
        for parts in split:
            n, ids, data = 0, [], []
            for special, numbers in parts:
                numbers = numbers.tolist()
                n += sum(map(counts, numbers))
                ids += map(shown, numbers)
                data += map(raw, numbers)
                if special is not None:
                    n += 1
                    ids.append(str(self.special[special]))
                    data.append(special.encode())
            decoded = b"".join(data).decode("utf-8", "replace")
            yield n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


#: A worker's coder, kept between its tasks with the pieces that it has seen.
_CODERS: dict[str, Bpe] = {}


def _coder(path: str) -> Bpe:
    if path not in _CODERS:
        _CODERS[path] = Bpe(path)
    return _CODERS[path]


def encode_digests(docs: DataFrame, path: str, batch_chars: int = 12_000_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle.

    ``path`` names the vocabulary file, which every worker reads from its own installation. A null or empty text has no
    ids: 0 and the digests of the empty text. Strings of special tokens in a text become those tokens. Null ids stay
    null, an empty table gives an empty result, and other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            rows, k = [], 0
            while k < len(texts):
                end, chars = k + 1, len(texts[k])
                while end < len(texts) and chars + len(texts[end]) <= batch_chars:
                    chars += len(texts[end])
                    end += 1
                rows += bpe.digests(texts[k:end])
                k = end
            n, ids, decoded = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves, an array of ints; nulls as in ``encode_digests``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")
