"""SimHash near-duplicates, linked exactly with vantage-point trees.

Equal fingerprints are one point. Of r + 1 bands of bits, two fingerprints that differ in at most r bits agree in one: a
point goes to one cell for each band, that of the band's first bits, so it has r + 1 copies however many points there
are. As many first bits are taken as leave a cell some thousand points; a small table is one cell. Within a cell, a
vantage-point tree parts the points by their Hamming distance from a vantage point at the median distance. A point is
looked up on both sides where the triangle inequality can't exclude one, down to small blocks that are compared in full.
A cell of far too many points, which agree in more than these bits, is parted by whole bands of the others, and so on;
only its points get more copies.

A cell doesn't return the pairs it finds but a spanning forest of them: a group of n close texts costs n links, not n^2.
Forests are then joined into components by rounds of large-star and small-star, in which counts are pre-aggregated.

Fingerprints of shingles that differ in 3 of 64 bits belong to texts that are all but equal. Near-duplicates down to a
Jaccard similarity of 0.8 of five-word shingles (``keep_one``) are linked by the trees first, as far as their fingerprints
are close, each link verified; the pairs that are left apart are found by an exact prefix-filter join: in one order of all shingles, rare ones first, two such texts share one of their first n - ceil(0.8 n) + 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.storage import Scratch, row_of

BITS = 64


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 255):  # sums of 255 fit into a byte
        part = hashes[k : k + 255].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def _again(hashes: np.ndarray, number: int) -> np.ndarray:
    """Further hashes of what was hashed; number 0 is the hash itself."""
    if not number:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(number))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of fewer words than a shingle's the whole; none without a word."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    return np.array([digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)), strict=False)], np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of ``shingle`` words; A-Z lower-cased; words are parted by ASCII white space."""
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending; shingles as in ``shingle_hashes``, but hashed word by word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    hashes = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    total = hashes[:n]
    for k in range(1, size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return np.unique(_again(total + np.uint64(size), 1))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """Texts of a batch, from ``doc`` if it has one, else from ``text``; a null text is empty."""
    text = batch.column("doc").field("text") if "doc" in batch.schema.names else batch.column("text")
    return [t or b"" for t in text.cast(pa.binary()).to_pylist()]


def _adding(rows: DataFrame, names: list[str], types: str, add) -> DataFrame:
    """``names`` of rows and what ``add`` makes of a batch's texts: arrays of the given names and types."""
    new = [t.split()[0] for t in types.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *add(_texts(batch))], names=[*names, *new])

    return rows.mapInArrow(work, StructType([*rows.select(*names).schema.fields, *StructType.fromDDL(types).fields]))


def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """rows with fp, a signed long, in place of the text. A null text is empty, and its fingerprint 0."""

    def add(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return _adding(rows, [c for c in rows.columns if c != "text"], "fp long", add)


def _distance(codes: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(codes ^ codes.dtype.type(vantage)).astype(np.int64)


def _split(codes: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and a median distance that parts the codes, or nothing."""
    for k in (0, len(codes) // 3, 2 * len(codes) // 3):
        d = _distance(codes, int(codes[k]))
        median = int(np.median(d))
        for m in (median, median - 1):
            if 0 < (d <= m).sum() < len(codes):
                return int(codes[k]), m
    return None


class Forest:
    """Disjoint sets over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two sets."""
        used, rest = [], np.arange(len(a))
        while True:
            ra, rb = self.roots(a[rest]), self.roots(b[rest])
            differ = ra != rb
            if not differ.any():
                return np.concatenate(used) if used else rest[:0]
            rest, ra, rb = rest[differ], ra[differ], rb[differ]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            _, first = np.unique(high, return_index=True)  # each set hangs itself under one smaller one
            self.parent[high[first]] = low[first]
            used.append(rest[first])


def link(codes: np.ndarray, most: int, block: int = 192, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that differ in at most ``most`` bits, by a vantage-point tree."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        used = Forest(len(codes)).unite(a, b)
        return a[used], b[used]

    stack = [(np.arange(len(codes)), np.arange(len(codes)))]
    while stack:
        points, asks = stack.pop()
        if not len(points) or not len(asks):
            continue
        split = _split(codes[points]) if len(points) > block else None
        if split is not None:
            vantage, median = split
            dp, dq = _distance(codes[points], vantage), _distance(codes[asks], vantage)
            stack += [(points[dp <= median], asks[dq <= median + most]), (points[dp > median], asks[dq > median - most])]
            continue
        for p in range(0, len(points), 1024):
            for q in range(0, len(asks), 1024):
                mine, theirs = points[p : p + 1024], asks[q : q + 1024]
                i, j = np.nonzero(np.bitwise_count(codes[theirs, None] ^ codes[mine][None, :]) <= most)
                a, b = theirs[i], mine[j]
                found.append((a[a < b], b[a < b]))
                count += len(found[-1][0])
                if count > held:  # pairs never pile up: what a forest doesn't need goes
                    found = [reduced()]
                    count = len(found[0][0])
    return reduced()


def link_cells(mask: np.ndarray, codes: np.ndarray, most: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, of positions, of the pairs within one cell that differ in at most ``most`` bits. Cells of up to
    ``small`` points are compared in full, all at once; larger ones have a tree each."""
    order = np.lexsort((codes, codes & mask, mask))
    mask, codes = mask[order], codes[order]
    value = codes & mask
    fresh = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
    length = np.diff(np.append(fresh, len(codes)))
    left = np.repeat(np.where(length <= small, length, 0), length) - np.arange(len(codes)) + np.repeat(fresh, length)
    pairs, rest, d = [], np.flatnonzero(left > 1), 1  # left: points of the cell from here on
    while len(rest):
        near = rest[np.bitwise_count(codes[rest] ^ codes[rest + d]) <= most]
        pairs.append((near, near + d))
        d += 1
        rest = rest[left[rest] > d]
    for start, n in zip(fresh[length > small], length[length > small], strict=True):
        a, b = link(codes[start : start + n], most)
        pairs.append((a + start, b + start))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return order[a], order[b]


def bands(mask: int, most: int, bits: int = BITS) -> list[int]:
    """``mask`` with each of ``most`` + 1 bands of the bits outside of it, or the first ``bits`` of each. Neighbouring bits go to
    different bands."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return sorted({mask | sum(1 << b for b in free[k :: most + 1][:bits]) for k in range(most + 1)})


def cells_of(points: DataFrame, most: int, scratch: Scratch, size: int = 8192, cell: int = 32_768) -> tuple[DataFrame, int]:
    """Cells (mask, value, node, fp) of which any two points within ``most`` bits share one, and how many rows there are at most.

    Cells would have about ``size`` points if bits were even. One of over ``cell`` points is parted again. A cell has at
    most 2 ** (bits outside its mask) points, so this ends before a band would be empty."""
    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long")
    n = points.count()
    masks = bands(0, most, max(0, math.ceil(math.log2(max(n, 1) / size))))
    rows = n * len(masks)
    cells = points.select("node", "fp", F.explode(F.array(*map(signed, masks))).alias("mask"))
    done = []
    while True:
        cells = cells.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "node", "fp")
        large = scratch.store(cells.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > cell))
        n = large.agg(F.sum("n")).first()[0] or 0
        if not n:
            break
        done.append(cells.join(large.select("mask", "value"), ["mask", "value"], "left_anti"))
        hot = scratch.store(cells.join(large.select("mask", "value"), ["mask", "value"], "left_semi"))
        parts = F.create_map(*(x for m in masks for x in (signed(m), F.array(*map(signed, bands(m, most))))))
        rows += n * most
        cells = hot.select("node", "fp", F.explode(parts[F.col("mask")]).alias("mask")).distinct()  # bands of bands may meet
        masks = sorted({m for of in masks for m in bands(of, most)})
    for part in done:
        cells = cells.unionByName(part)
    return cells, rows


def near_links(points: DataFrame, most: int, scratch: Scratch, size: int = 8192, cell: int = 32_768, shard: int = 65_536) -> DataFrame:
    """Links (a, b) that join all points within ``most`` bits of each other. points: node (a distinct id), fp. Cells have
    about ``size`` points and at most ``cell``; about ``shard`` rows of cells are searched together."""
    cells, rows = cells_of(points, most, scratch, size, cell)
    shards = max(64, -(-rows // shard))

    def search(table: pa.Table) -> pa.Table:
        node, fp, mask = (table[n].to_numpy() for n in ("node", "fp", "mask"))
        a, b = link_cells(mask.view(np.uint64), fp.view(np.uint64), most)
        names, at = np.unique(node, return_inverse=True)  # a point may stand in several cells here
        used = Forest(len(names)).unite(at[a], at[b])
        return pa.table({"a": node[a[used]], "b": node[b[used]]})

    dealt = cells.select("node", "fp", "mask", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes in links (a, b) that have a smaller one in reach: component is the smallest."""
    edges = scratch.store(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    while True:
        # large star: neighbours above a node are hung under its smallest neighbour
        both = edges.union(edges.select("lo", "hi"))
        least = scratch.store(both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = edges.join(least, edges["lo"] == least["u"]).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = scratch.store(large)
        # small star: a node and its neighbours below it are hung under the smallest of them
        low = scratch.store(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        # a node with one neighbour below has nothing to pass on
        moved = large.join(low.where("n > 1"), large["hi"] == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        small = scratch.store(moved.union(low.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        tops = small.select(F.col("lo").alias("x")).distinct().join(small.select(F.col("hi").alias("x")).distinct(), "x", "left_semi")
        double = small.groupBy("hi").count().where("count > 1")
        edges = small
        if tops.isEmpty() and double.isEmpty():
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Documents are linked when their fingerprints differ in at most ``most`` bits; component_id is the smallest doc_id
    that links lead to, the document's own included. Texts without a word, null ones among them, have fingerprint zero
    and are linked like any other. Null doc_ids are left out of the minimum; a component of such rows alone has a null
    component_id. Repeated rows each have their row; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    row = F.monotonically_increasing_id().alias("row")
    marked = scratch.store(fingerprints(docs.select("doc_id", "text", row), shingle))
    found = _components(marked, most, scratch)
    scratch.keep(marked, found)
    out = marked.join(found, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """fp, component_id of each fingerprint; component_id is the smallest doc_id."""
    # a point's node is its smallest row number: rows are distinct where ids may not be
    points = scratch.store(marked.groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
    joined = components(near_links(points.select("node", "fp"), most, scratch), scratch)
    of = scratch.store(points.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "least_id"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return scratch.store(of.join(scratch.store(least), "component").select("fp", "component_id"))


def common_shingles(marked: DataFrame, shingle: int, sample: int = 16_384, part: int = 32, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts or more of a sample hold, ascending, and how many; the ``most`` most frequent. The sample
    is every ``part``-th text, ``sample`` texts at least. They shape the order of shingles alone: the join is exact in any
    order, and fast if frequent ones come last."""
    share = min(1 << 31, (1 << 31) * sample // max(1, min(marked.count(), sample * part)))
    picked = marked.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 31)) < share).dropDuplicates(["node"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in _texts(batch)]
            found, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = picked.select(F.col("doc.text").alias("text")).mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    table = counted.where("n >= 3").orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    found, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def prefix(held: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, int]:
    """Of a set of shingles, ascending, the first in the common order, and how many of these are its short prefix. Of sets that
    are alike, the short prefix of the smaller one and the prefix of the other have one in common: they share at least as
    much as two sets of the smaller size would have to."""
    at = np.searchsorted(common[0], held)
    known = at < len(common[0])
    known[known] = common[0][at[known]] == held[known]
    count = np.zeros(len(held), np.int64)
    count[known] = common[1][at[known]]
    beyond = lambda share: len(held) - math.ceil(share * len(held) - 1e-9) + 1
    return held[np.argsort(count, kind="stable")[: beyond(similarity)]], beyond(2 * similarity / (1 + similarity))


def signature(held: np.ndarray) -> bytes:
    """How many of a set's hashes, ascending, begin with each value of their first bits, of which there are about half as many
    as hashes. Two sets share at most the sum of the lesser counts. Empty, which bounds nothing, if a count needs two bytes."""
    bits = max(4, (len(held) >> 1).bit_length())
    counts = np.bincount((held >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def folded(counts: np.ndarray, length: int) -> np.ndarray:
    """Rows of counts of fewer first bits, so that there are ``length``."""
    return counts if counts.shape[-1] == length else counts.reshape(*counts.shape[:-1], length, -1).sum(-1)


def shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = min(a.shape[-1], b.shape[-1])
    return np.minimum(folded(a, length), folded(b, length)).sum(-1, dtype=np.int64)


def needed(total: np.ndarray | int, similarity: float) -> np.ndarray:
    """What sets of so many hashes in all have to share."""
    return np.asarray(total) * similarity / (1 + similarity) - 1e-6


def pairs_of_runs(key: np.ndarray, node: np.ndarray, size: np.ndarray, similarity: float, small: int, leaders: int) -> tuple[np.ndarray, ...]:
    """Pairs a < b of nodes with the same key whose sizes allow the similarity, and the sum of the sizes; and (key, node,
    size) of runs in which a node has over ``small`` partners: of those the pairs with ``leaders`` nodes alone. A negative
    size says that the key isn't in the node's short prefix: it has no pair with nodes that are larger. So a passage that
    many texts share makes no pairs of texts that it alone wouldn't make alike."""
    strong, size = size > 0, np.abs(size.astype(np.int64))
    order = np.lexsort((~strong, node, size, key))
    key, node, size, strong = key[order], node[order], size[order], strong[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size, strong = key[fresh], node[fresh], size[fresh], strong[fresh]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.append(starts, len(key)))
    # partners come after a node, in the order of sizes
    run, step = np.repeat(np.arange(len(starts)), lengths), int(size.max()) + 1
    most = np.minimum((size / similarity + 1e-9).astype(np.int64), step - 1)
    partners = np.where(strong, np.searchsorted(run * step + size, run * step + most, "right") - np.arange(len(key)) - 1, 0)
    large = np.repeat(np.maximum.reduceat(partners, starts) > small, lengths)
    left, right, rest, d = [], [], np.flatnonzero((partners > 0) & ~large), 1
    while len(rest):
        left.append(rest)
        right.append(rest + d)
        d += 1
        rest = rest[partners[rest] >= d]
    for start, n in zip(starts[large[starts]], lengths[large[starts]], strict=True):
        own = np.arange(start, start + n)
        for first in own[np.argsort(_again(node[own].view(np.uint64), 1), kind="stable")[:leaders]]:  # runs of the same texts have the same ones
            fit = own[(np.minimum(size[own], size[first]) >= similarity * np.maximum(size[own], size[first]) - 1e-9) & (own != first)]
            left.append(np.full(len(fit), first))
            right.append(fit)
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    both = np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), size[a] + size[b]], 1)
    return *np.unique(both, axis=0).T, key[large], node[large], size[large]


def candidates(marked: DataFrame, shingle: int, similarity: float, keys: int = 500_000, small: int = 32, leaders: int = 4) -> DataFrame:
    """run, a, b, n: without a run, pairs a < b of nodes to verify and the sum of their sizes; with one, a node a of the run,
    whose pairs are to be searched, and its size.

    Each pair of at least ``similarity`` is a pair or shares a run. Shingles of prefixes go to ranges of their hashes, as
    arrays, about ``keys`` to a range; of each hash there go the bits of its range and 32 more."""
    common = marked.sparkSession.sparkContext.broadcast(common_shingles(marked, shingle))
    total = marked.agg(F.sum("size")).first()[0] or 0
    bits = min(31, max(5, int(total * (1 - similarity) / keys).bit_length()))

    def rows_of(parts: list[np.ndarray], nodes: list[int], sizes: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.concatenate(parts), [len(x) for x in parts]
        order = np.argsort(key)
        key, node, size = key[order], np.repeat(np.array(nodes, np.int64), n)[order], np.concatenate(sizes)[order]
        at = (key >> np.uint64(64 - bits)).astype(np.int64)
        low = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        cuts = np.split(np.arange(len(key)), np.flatnonzero(np.diff(at)) + 1)
        return pa.RecordBatch.from_arrays([pa.array([at[c[0]] for c in cuts], pa.int64()), *(pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (low, node, size))], names=["range", "key", "node", "size"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), _texts(batch), strict=True):
                own = shingle_set(text, shingle)
                if not len(own):
                    continue
                first, short = prefix(own, common.value, similarity)
                parts.append(first)
                nodes.append(node)
                sizes.append(np.where(np.arange(len(first)) < short, len(own), -len(own)).astype(np.int32))
                held += len(first)
                if held > 1_000_000:
                    yield rows_of(parts, nodes, sizes)
                    parts, nodes, sizes, held = [], [], [], 0
        if parts:
            yield rows_of(parts, nodes, sizes)

    def search(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        a, b, n, key, node, own = pairs_of_runs(joined("key", np.uint32), joined("node", np.int64), joined("size", np.int32), similarity, small, leaders)
        run = (table["range"][0].as_py() << 32) + key.astype(np.int64)
        return pa.table({"run": pa.array([*[None] * len(a), *run.tolist()], pa.int64()), "a": np.concatenate([a, node]), "b": pa.array([*b.tolist(), *[None] * len(run)], pa.int64()), "n": np.concatenate([n, own])})

    dealt = marked.select("node", F.col("doc.text").alias("text")).mapInArrow(deal, "range long, key binary, node binary, size binary")
    return dealt.groupBy("range").applyInArrow(search, "run long, a long, b long, n long")


def alike_across(node: np.ndarray, component: np.ndarray, held: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that join all components of which two nodes are alike; held: the nodes' sets, none empty."""
    sizes = np.array([len(h) for h in held])
    flat = np.unique(np.concatenate(held), return_inverse=True)[1]
    starts = sizes.cumsum() - sizes
    names, group, count = np.unique(component, return_inverse=True, return_counts=True)
    a, b = [], []
    marks = np.zeros(int(flat.max()) + 1, np.uint8)
    for i in np.flatnonzero(group != count.argmax()):  # a pair within the largest needs no link
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = 1
        shared = np.add.reduceat(marks[flat], starts, dtype=np.int64)
        marks[own] = 0
        found = np.flatnonzero((shared / (sizes + sizes[i] - shared) >= similarity) & (group != group[i]))
        if len(found):
            others, first = np.unique(group[found], return_index=True)
            a += [node[i]] * len(first)
            b += node[found[first]].tolist()
            group[np.isin(group, others)] = group[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def with_sets(marked: DataFrame, points: DataFrame, wanted: DataFrame, shingle: int, scratch: Scratch, held: int = 500_000) -> DataFrame:
    """wanted: node, cell. cell, node, held: for each of them the node's shingles, half a hash each, which tells those of
    two texts apart. Texts are hashed where they lie if there are at most ``held`` rows in wanted (a broadcast of some
    16 MB); beyond that, they move to the join first."""

    def hashes(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.unique(shingle_set(t, shingle).astype(np.uint32)).view(np.int32) for t in texts], pa.list_(pa.int32()))]

    rows = scratch.store(points.join(wanted.groupBy("node").agg(F.collect_set("cell").alias("cells")), "node").select("row", "node", "cells"))
    few = (rows.agg(F.sum(F.size("cells"))).first()[0] or 0) <= held
    texts = marked.select("row", F.col("doc.text").alias("text")).join(F.broadcast(rows) if few else rows.hint("merge"), "row")
    return _adding(texts, ["node", "cells"], "held array<int>", hashes).select(F.explode("cells").alias("cell"), "node", "held")


def possible(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, n) that their signatures don't rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = needed(batch.column("n").to_numpy(), similarity)
            a, b = (batch.column(c).to_pylist() for c in ("sig_a", "sig_b"))
            keep = [not x or not y or shared_at_most(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= t for x, y, t in zip(a, b, need, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "n"])

    of_a, of_b = (points.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n", "sig_a", "sig_b").mapInArrow(work, "a long, b long, n long")


def with_partners(component: np.ndarray, size: np.ndarray, signatures: list[bytes], similarity: float) -> np.ndarray:
    """Which nodes may be alike to one of another component, as far as their signatures tell."""
    keep = np.array([not x for x in signatures])
    if keep.any():
        return np.ones(len(component), bool)
    least = min(map(len, signatures))
    counts = np.stack([folded(np.frombuffer(x, np.uint8).astype(np.uint16), least) for x in signatures]).astype(np.uint16)
    for i in range(len(component)):
        other = np.flatnonzero((component != component[i]) & ~(keep & keep[i]))
        fit = other[np.minimum(counts[other], counts[i]).sum(1, dtype=np.int64) >= needed(size[other] + size[i], similarity)]
        keep[fit] = True
        keep[i] |= len(fit) > 0
    return keep


class Sets:
    """Sets of nodes, by node."""

    def __init__(self, table: pa.Table):
        held = table["held"].combine_chunks()
        node, ends, self.values = table["node"].to_numpy(), held.offsets.to_numpy(), held.values.to_numpy()
        order = np.argsort(node, kind="stable")
        self.node, self.start, self.end = node[order], ends[:-1][order], ends[1:][order]

    def __call__(self, node: np.ndarray) -> list[np.ndarray]:
        return [self.values[self.start[k] : self.end[k]] for k in np.searchsorted(self.node, node)]


def verified(pairs: DataFrame, marked: DataFrame, points: DataFrame, shingle: int, similarity: float, scratch: Scratch, cell: int = 2_000_000) -> DataFrame:
    """Of the candidate pairs (a, b, n) those that are alike. Pairs that hang together meet in one cell, to which each of
    their sets is sent once; what has over ``cell`` shingles in its pairs is dealt over several cells, pair by pair."""
    joined = components(pairs.select("a", "b"), scratch)
    of = scratch.store(pairs.join(joined, pairs["b"] == joined["node"]).select("a", "b", "n", "component"))
    weight = scratch.store(of.groupBy("component").agg(F.sum("n").alias("weight")))
    cells = max(8, (weight.agg(F.sum("weight")).first()[0] or 0) // cell)
    part = F.when(F.col("weight") <= cell, F.pmod(F.xxhash64("component"), F.lit(cells))).otherwise(
        F.xxhash64("component", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("weight") / cell)))
    )
    dealt = scratch.store(of.join(weight, "component").select("a", "b", part.alias("cell")))
    wanted = dealt.select("cell", F.col("a").alias("node")).union(dealt.select("cell", "b"))

    def alike(asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
        sets = Sets(held)
        of_a, of_b = sets(a), sets(b)
        shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(of_a, of_b, strict=True)], np.int64)
        total = np.array([len(x) + len(y) for x, y in zip(of_a, of_b, strict=True)], np.int64)
        keep = shared / (total - shared) >= similarity
        return pa.table({"a": a[keep], "b": b[keep]})

    sets = with_sets(marked, points, wanted, shingle, scratch)
    return scratch.store(dealt.groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(alike, "a long, b long"))


def run_links(runs: DataFrame, joined: DataFrame, marked: DataFrame, points: DataFrame, shingle: int, similarity: float, scratch: Scratch, most: int = 4096) -> DataFrame | None:
    """Verified links (a, b) between nodes of a run (run, node, n) that ``joined`` leaves in different components. A run is
    cut by size; what still has over ``most`` nodes is cut into parts, each pair of which is searched by itself."""
    # sizes that allow the similarity are in the same class or in neighbouring ones
    size_class = F.floor(F.log(F.col("n").cast("double")) / (-math.log(similarity) * 1.0001))
    named = runs.join(joined, "node", "left").select("run", "node", F.coalesce("component", "node").alias("component"), size_class.alias("class"))
    of = scratch.store(named.select("run", "node", "component", F.explode(F.array(F.struct("class", F.lit(True).alias("home")), F.struct((F.col("class") - 1).alias("class"), F.lit(False).alias("home")))).alias("at")).select("run", "node", "component", "at.*"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    cells = of.groupBy("run", "class").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("home").alias("home"), *marks)
    # of cells of the same nodes, as a passage makes them of each of its shingles, one is enough
    once = cells.where("lo < hi AND home").groupBy("mark0", "mark1", "n").agg(F.min(F.struct("run", "class")).alias("at"))
    still = scratch.store(once.select("at.*", F.when(F.col("n") <= most, 1).otherwise(F.greatest(F.lit(3), F.ceil(2 * F.col("n") / most))).cast("int").alias("parts")))
    if still.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = of.join(still, ["run", "class"]).select("run", "class", "node", "component", "parts", own.alias("own"), other).where("parts = 1 OR own <> other")
    cells = scratch.store(cells.select(F.xxhash64("run", "class", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "component"))

    def plausible(table: pa.Table) -> pa.Table:
        return table.filter(with_partners(table["component"].to_numpy(), table["size"].to_numpy(), table["sig"].to_pylist(), similarity)).select(["cell", "node", "component"])

    # sets move only of nodes that may have a partner
    cells = scratch.store(cells.join(points.select("node", "size", "sig"), "node").select("cell", "node", "component", "size", "sig").groupBy("cell").applyInArrow(plausible, "cell long, node long, component long"))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        node = asked["node"].to_numpy()
        a, b = alike_across(node, asked["component"].to_numpy(), Sets(held)(node), similarity)
        return pa.table({"a": a, "b": b})

    sets = with_sets(marked, points, cells.select("node", "cell"), shingle, scratch)
    return scratch.store(cells.groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(search, "a long, b long"))


def close_pairs(points: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Pairs a < b of nodes that the trees link, and the sum of their sizes: a spanning forest of the fingerprints within
    ``most`` bits, and each node with the first of its own fingerprint. points: node, fp, size."""
    leads = scratch.store(points.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")))
    between = near_links(leads.select(F.col("lead").alias("node"), "fp"), most, scratch).select("a", "b")
    within = points.join(leads.where("n > 1"), "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    both = scratch.store(between.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    of_a, of_b = (points.select(F.col("node").alias(c), F.col("size").cast("long").alias(f"n_{c}")) for c in ("a", "b"))
    return both.join(of_a, "a").join(of_b, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose nodes ``joined`` leaves in different components."""
    of_a, of_b = (joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
    named = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "n")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: that with the smallest doc_id.

    Documents are linked when the Jaccard similarity of their distinct shingles is at least ``similarity``; a group is
    what links connect. SimHash fingerprints of the sets within ``most`` bits are found by vantage-point trees, and what they
    link is verified. All pairs that this leaves apart are found, whatever the edits between them, by a prefix-filter join;
    texts of the same set of shingles (a digest of 64 bits) are one node. Each pair of nodes with a shingle of their prefixes in common
    is verified, half a hash a shingle, or else both are in one group already. Texts that share a passage which makes them
    less alike than some 0.78 aren't compared for it; texts that share one which makes them all but alike are, each with
    each of their run, which costs the square of their number. Texts without a word are one group. A row's columns stay as they are; of rows repeated in full one stays; null doc_ids come last; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")

    def mark(texts: list[bytes]) -> list[pa.Array]:
        sets = [shingle_set(t, shingle) for t in texts]
        digests = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64)
        prints = np.array([_majority(h) if len(h) else 0 for h in sets], np.uint64)
        return [pa.array(digests.view(np.int64)), pa.array([len(h) for h in sets], pa.int32()), pa.array([signature(h) for h in sets], pa.binary()), pa.array(prints.view(np.int64))]

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), row_of(docs))
    marked = scratch.store(_adding(rows, ["doc_id", "row", "doc"], "node long, size int, sig binary, fp long", mark))
    points = scratch.store(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("fp").alias("fp")))
    near = scratch.store(possible(close_pairs(points, most, scratch), points, similarity))
    near = verified(near, marked, points, shingle, similarity, scratch)
    found = scratch.store(candidates(marked, shingle, similarity))
    left = apart(found.where("run IS NULL").select("a", "b", "n").distinct(), components(near, scratch))
    pairs = scratch.store(possible(left, points, similarity))
    runs = found.where("run IS NOT NULL").select("run", F.col("a").alias("node"), "n")
    links = near.union(verified(pairs, marked, points, shingle, similarity, scratch))
    joined = components(links, scratch)
    more = run_links(runs, joined, marked, points, shingle, similarity, scratch)
    if more is not None:
        joined = components(links.union(more), scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    slim = scratch.store(marked.select("doc_id", "row", "node").join(joined, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component")))
    firsts = slim.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    later = scratch.store(firsts.where("n > 1"))
    gone = scratch.store(slim.join(later, "component").where(F.col("row") != F.col("first.row")).select("row"))
    scratch.keep(marked, gone)
    return marked.join(gone, "row", "left_anti").select("doc.*")
