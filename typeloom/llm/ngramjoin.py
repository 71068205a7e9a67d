"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles; two documents link when the Jaccard
similarity of their sets reaches a threshold p/q. No link between different texts is lost:

1. Documents of equal sets are one class.
2. A set of n shingles shares at least p/q of them with a set that it links with. So, in any
   order of all shingles, two sets that link share one of the first n - ceil(n p/q) + 1 of each,
   and l of the first n - ceil(n p/q) + l: a prefix. Shingles that a bounded sample shows to be
   very common come last in the order.
   First the order is by hash, and a prefix of l = n / 10 is dealt out: a class of which fewer
   than that many shingles are held by other classes is left out. Then the order, among what is left, is by
   rarity, the number of classes that hold a shingle; each shingle of the shortest prefix that
   several classes hold is a key. So a passage that many documents share makes no candidates of
   them. Shingles are counted in buckets of bounded size, in the form of arrays; very common
   ones don't enter the buckets. Sets aren't kept but worked out anew where they are needed;
   only those that are left are written, once.
3. Classes that share a prefix shingle, and whose sizes can match, form candidate clusters. In
   each, a signature tree is built: leaves of like-sized documents, each node with the OR of its
   documents' token bitmaps and the range of their sizes. Pairs of nodes are visited together
   and left when their sizes can't match, when the bits they share bound the overlap below what
   a link needs, or when all their documents are known to be connected. What is left is
   verified on the sets.
4. A cluster beyond a tile's bound is first held against a few of its own sets (`PIVOTS`), which
   connects most near copies in linear time. Tiles are then cut by what is connected and by size
   band, and only pairs of tiles that could hold a new link are tasks of their own.

Links inside one connected component beyond a spanning forest aren't listed. Shingles and sets
are told apart by 64-bit hashes.

Defined results: a null text or one without words has an empty set and links with nothing; a
null doc_id keeps its row and takes part in no link; repeated rows are equal sets; rows of one
doc_id with different texts are different documents; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm import bytewords as bw
from typeloom.llm.common import discard, stash, tidy
from typeloom.llm.components import connected

#: A tile holds about so many documents, and about so many shingles.
TILE_DOCS, TILE_SHINGLES = 1024, 2_000_000
#: Sets of a large cluster that all others of it are held against first.
PIVOTS = 4
LEAF, FAN = 16, 8
#: Shingles in a counting bucket, and in what a task deals out at once.
BUCKET, DEAL = 500_000, 500_000
#: Buckets that a task works on, one after another.
TASK_BUCKETS = 16
#: One in so many shingles is added to the prefix that leaves classes out.
SPARE = 10
#: Classes of the sample that tells very common shingles, and the share of it from which a shingle is one.
SAMPLE, COMMON, LEAST = 5_000, 0.005, 16
#: Digests by which a task knows sets that it has met, so that it hands on a set of many copies once.
MET = 200_000
#: The filter that spares most texts a second reading has so many bits for each set, up to a whole of 32 MB; what it lets through besides does no harm.
FILTER_EACH, FILTER_BITS = 16, 28


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and the bounds of each row."""
    data = bw.LOWER[data]
    s, e, row = bw.words_of(data, offsets)
    h = bw.span_hashes(data, s, e)
    rows = len(offsets) - 1
    words = np.bincount(row, minlength=rows)
    full = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        full += bw.mix64(part ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1))
    begin = np.concatenate([[0], np.cumsum(words)])[row]
    at = np.arange(len(h)) - begin
    whole = at + n <= words[row]
    # A text of fewer words is one shingle, which also tells how many words it has.
    short = np.flatnonzero((words > 0) & (words < n))
    values, owner = bw.mix64(full[whole]), row[whole]
    if len(short):
        first = np.concatenate([[0], np.cumsum(words)])
        extra = []
        for r in short.tolist():
            total = np.zeros(1, np.uint64)
            for k, x in enumerate(h[first[r] : first[r] + words[r]]):
                total += bw.mix64(np.array([x], np.uint64) ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1))
            extra.append(bw.mix64(total + np.uint64(int(words[r])))[0])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = np.concatenate([values, np.array(extra, np.uint64)])[order], owner[order]
    bounds = bw.counts_to_bounds(owner, rows)
    bw.sort_rows(values, bounds)
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], bw.counts_to_bounds(owner[fresh], rows)


def _digest(values: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(bw.mix64(values ^ np.uint64(salt)), out=running[1:])
    return (running[bounds[1:]] - running[bounds[:-1]]).view(np.int64)


_SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, and two digests of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bw.ranges(whole, budget=2 << 20):
                values, bounds = shingle_sets(*bw.texts_of(b.column(1)), n)
                digests = [pa.array(_digest(values, bounds, salt)) for salt in _SALTS]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(bounds)), *digests], names=["doc_id", "text_key", "n_shingles", "d1", "d2"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return picked.mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, d1 long, d2 long")


def _met_once(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """d1 and size of sets that the task meets first, and their shingles laid end to end."""
    met: set[int] = set()
    for whole in batches:
        for b in bw.ranges(whole, budget=2 << 20):
            values, bounds = shingle_sets(*bw.texts_of(b.column(b.schema.get_field_index("text"))), n)
            d1, size = _digest(values, bounds, _SALTS[0]), np.diff(bounds)
            fresh = np.zeros(len(d1), bool)
            for i, d in enumerate(d1.tolist()):
                if size[i] and d not in met:
                    fresh[i] = True
                    met.add(d)
            if len(met) > MET:
                met.clear()
            yield d1[fresh], size[fresh], values[np.repeat(fresh, size)]


class Members:
    """A bitmap of hashed values: tells most non-members apart before anything is shuffled. `values` is a column of hashes."""

    def __init__(self, values: DataFrame, column: str, number: int):
        self.bits = min(FILTER_BITS, max(16, int(FILTER_EACH * max(1, number) - 1).bit_length()))
        slot = F.shiftrightunsigned(column, 64 - self.bits).alias("slot")
        pages = values.select(slot).groupBy(F.floor(F.col("slot") / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg((F.col("slot") % 32768).cast("long")).alias("bits"))
        filled = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in pages.toLocalIterator():
            filled[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.table = values.sparkSession.sparkContext.broadcast(filled)

    def has(self, hashed: np.ndarray) -> np.ndarray:
        slot = hashed.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


# -- arrays dealt out to buckets, a row for each bucket


_DEALT = "bucket int, kind int, x binary, y binary, z binary"


def _blob(column: np.ndarray, starts: np.ndarray) -> pa.Array:
    ends = np.append(starts, len(column)).astype(np.int64) * column.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(column))])


def _row(kind: int, bucket: np.ndarray, *blobs: pa.Array) -> pa.RecordBatch:
    blobs += (pa.nulls(len(bucket), pa.binary()),) * (3 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), *blobs], names=["bucket", "kind", "x", "y", "z"])


def _deal(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket met, with the bytes of each column's entries that belong there."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return _row(kind, bucket[order][cut], *(_blob(c[order], cut) for c in columns))


def _deal_runs(kind: int, bucket: np.ndarray, values: np.ndarray, row: np.ndarray, d1: np.ndarray) -> pa.RecordBatch:
    """As `_deal`, of values whose sorted `row` says whose they are: values, the d1 of each run of a row's values, and the runs' lengths."""
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    at = np.searchsorted(run, cut)
    return _row(kind, bucket[cut], _blob(values[order], cut), _blob(d1[row[run]], at), _blob(np.diff(run, append=len(row)).astype(np.uint32), at))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Each bucket, and what was dealt to it: for each kind, the bytes of its columns."""
    bucket, held = None, {}
    for b in batches:
        for k, kind, *blobs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if k != bucket:
                if held:
                    yield bucket, {j: [b"".join(x) for x in cols] for j, cols in held.items()}
                bucket, held = k, {}
            for col, blob in zip(held.setdefault(kind, [[], [], []]), blobs, strict=True):
                col.append(blob or b"")
    if held:
        yield bucket, {j: [b"".join(x) for x in cols] for j, cols in held.items()}


def _handed_on(bucket: int, kind: int, columns: list[bytes]) -> pa.RecordBatch:
    return _row(kind, np.array([bucket]), *(pa.array([x], pa.binary()) for x in columns))


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together; no task gets more than some TASK_BUCKETS, whatever the session's number of partitions."""
    few = buckets <= TASK_BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition("bucket") if few else df.repartition(buckets // TASK_BUCKETS, "bucket")).sortWithinPartitions("bucket", "kind")


def _unrun(got: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and their d1, in order of both."""
    values = np.frombuffer(got[0], kind)
    d1 = np.repeat(np.frombuffer(got[1], np.int64), np.frombuffer(got[2], np.uint32))
    order = np.lexsort((d1, values))
    return values[order], d1[order]


def prefix_length(n: np.ndarray, p: int, q: int) -> np.ndarray:
    """Of how many shingles, in any common order, sets that link share one."""
    return n - (p * n + q - 1) // q + 1


def band_of(n: np.ndarray, p: int, q: int) -> np.ndarray:
    """Size bands: sets that link are in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= int(n.max(initial=1)):
        edges.append(max(edges[-1] + 1, edges[-1] * q // p + 1))
    return np.searchsorted(np.array(edges, np.int64), n, "right") - 1


class Common:
    """Shingles that at least COMMON of a sample of SAMPLE texts hold, ranked by how many do.

    Their number is at most 1 / COMMON times the sample's mean size. They only order shingles:
    whatever the sample, no link is lost.
    """

    def __init__(self, docs: DataFrame, n: int, rows: int):
        every = max(1, rows // SAMPLE)
        some = docs.where(F.pmod(F.xxhash64(F.lit(29), "text"), F.lit(every)) == 0).select("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, values in _met_once(batches, n):
                t, often = np.unique(values.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(often)], names=["t", "n"])

        counted = some.mapInArrow(tidy(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
        ranked = sorted((r["n"], r["t"]) for r in counted.where(F.col("n") >= max(LEAST, int(COMMON * rows / every))).collect())
        values = np.array([t for _, t in ranked], np.int64).view(np.uint64)
        order = np.argsort(values)
        self.table = docs.sparkSession.sparkContext.broadcast((values[order], order))

    def rank(self, values: np.ndarray) -> np.ndarray:
        """The rank of each value, -1 for others."""
        known, rank = self.table.value
        if not len(known):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, rank[at], -1)


def _places(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; `row` is sorted."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def spare(n: np.ndarray) -> np.ndarray:
    """How many shared shingles a set of size n looks for in its longer prefix."""
    return n // SPARE + 1


def _promising(docs: DataFrame, n: int, p: int, q: int, common: Common, buckets: int) -> DataFrame:
    """d1 of classes that hold as many shingles of other classes as a link needs, told by longer prefixes in order of hash.

    A partner's prefix is as long as its own size makes it: of a pair, the smaller set's number of shared
    shingles is looked for. Shingles go by 32 bits within their bucket, which can only let more through.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d1, size, values in _met_once(batches, n):
            if not len(d1):
                continue
            row = np.repeat(np.arange(len(d1)), size)
            rare = common.rank(values) < 0
            often = size - np.bincount(row[rare], minlength=len(d1))
            yield _deal(1, _bucket(bw.mix64(d1.view(np.uint64)), buckets), d1, size, often)
            row, values = row[rare], values[rare]
            within = _places(row) < (prefix_length(size, p, q) - 1 + spare(size))[row]
            row, values = row[within], values[within]
            for at in range(0, len(row), DEAL):
                part = slice(at, at + DEAL)
                yield _deal_runs(0, _bucket(values[part], buckets), (bw.mix64(values[part]) >> np.uint64(32)).astype(np.uint32), row[part], d1)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in _gathered(batches):
            if 1 in got:
                yield _handed_on(bucket, 0, got[1])
            if 0 in got:
                values, d1 = _unrun(got[0], np.uint32)
                first = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-1))
                last = np.append(first[1:], len(values)) - 1
                held = np.repeat(d1[first] != d1[last], last - first + 1)
                if held.any():
                    whose, number = np.unique(d1[held], return_counts=True)
                    yield _deal(1, _bucket(bw.mix64(whose.view(np.uint64)), buckets), whose, number)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _gathered(batches):
            d1, first = np.unique(np.frombuffer(got[0][0], np.int64), return_index=True)
            size, often = (np.frombuffer(x, np.int64)[first] for x in got[0][1:])
            number = np.zeros(len(d1), np.int64)
            if 1 in got:
                np.add.at(number, np.searchsorted(d1, np.frombuffer(got[1][0], np.int64)), np.frombuffer(got[1][1], np.int64))
            # Common ones that the prefix reaches count as held by others.
            number += np.maximum(0, prefix_length(size, p, q) - 1 + spare(size) - (size - often))
            yield pa.RecordBatch.from_arrays([pa.array(d1[number >= spare(-(-size * p // q))])], names=["d1"])

    dealt = _dealt(docs.where("doc_id IS NOT NULL").select("text").mapInArrow(tidy(prefixes), _DEALT), buckets)
    return _dealt(dealt.mapInArrow(tidy(shared), _DEALT), buckets).mapInArrow(tidy(enough), "d1 long")


def _wanted_sets(docs: DataFrame, n: int, wanted: Members) -> DataFrame:
    """d1, n_shingles and `shingles` (the set's hashes as bytes) of texts that may be wanted; a task hands on equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (b.filter(pa.array(wanted.has(b.column(1).to_numpy(zero_copy_only=False)))) for b in batches)
        for d1, size, values in _met_once(kept, n):
            bounds = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(size), _blob(values, bounds[:-1])], names=["d1", "n_shingles", "shingles"])

    return docs.where("doc_id IS NOT NULL").select("text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(run), "d1 long, n_shingles long, shingles binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """d1 of rows (d1, shingles), their sizes, and their shingles laid end to end, about DEAL at a time."""
    for b in batches:
        raw = b.column(1).cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        if not len(raw):
            continue
        values = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint64)
        at = (at - at[0]) // 8
        d1 = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(at[1:] // DEAL)) + 1).tolist(), len(d1)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield d1[i:j], np.diff(at[i : j + 1]), values[at[i] : at[j]]


def _candidate_keys(sets: DataFrame, p: int, q: int, common: Common, buckets: int) -> DataFrame:
    """(key, d1): sets that link share a key. A key is a prefix shingle that several classes hold, in a size band."""

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare shingles by shingle; sizes, numbers of common ones, and the common ones of prefixes that reach them, by class."""
        for d1, size, values in _tokens(batches):
            rank, row = common.rank(values), np.repeat(np.arange(len(d1)), size)
            rare = rank < 0
            if rare.any():
                yield _deal_runs(0, _bucket(values[rare], buckets), values[rare], row[rare], d1)
            often = np.bincount(row[~rare], minlength=len(d1))
            to = _bucket(bw.mix64(d1.view(np.uint64)), buckets)
            yield _deal(1, to, d1, size, often)
            reach = prefix_length(size, p, q) - (size - often)
            at = np.flatnonzero(~rare & (reach[row] > 0))
            at = at[np.lexsort((rank[at], row[at]))]
            at = at[_places(row[at]) < reach[row[at]]]
            if len(at):
                yield _deal(2, to[row[at]], d1[row[at]], values[at])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles that several classes hold, with their number, dealt by class."""
        for bucket, got in _gathered(batches):
            for before, after in ((1, 0), (2, 2)):
                if before in got:
                    yield _handed_on(bucket, after, got[before])
            if 0 not in got:
                continue
            values, d1 = _unrun(got[0], np.uint64)
            once = np.ones(len(values), bool)
            once[1:] = (values[1:] != values[:-1]) | (d1[1:] != d1[:-1])
            values, d1 = values[once], d1[once]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            number = np.diff(first, append=len(values))
            number = np.repeat(number, number)
            several = number > 1
            if several.any():
                yield _deal(1, _bucket(bw.mix64(d1[several].view(np.uint64)), buckets), d1[several], values[several], number[several])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _gathered(batches):
            info, first = np.unique(np.frombuffer(got[0][0], np.int64), return_index=True)
            size, often = (np.frombuffer(x, np.int64)[first] for x in got[0][1:])
            row, token = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if 1 in got:
                d1, values, number = (np.frombuffer(x, t) for x, t in zip(got[1], (np.int64, np.uint64, np.int64), strict=True))
                order = np.lexsort((values, number, d1))
                row, values = np.searchsorted(info, d1[order]), values[order]
                several = np.bincount(row, minlength=len(info))
                reach = prefix_length(size, p, q) - (size - often - several)
                keep = _places(row) < reach[row]
                row, token = row[keep], values[keep]
            if 2 in got:
                row = np.concatenate([row, np.searchsorted(info, np.frombuffer(got[2][0], np.int64))])
                token = np.concatenate([token, np.frombuffer(got[2][1], np.uint64)])
            # A set enters its own size band, and the one above if a larger set there could link with it.
            own, above = band_of(size, p, q), band_of(size * q // p, p, q)
            for step in (0, 1):
                use = own[row] + step <= above[row]
                key = bw.mix64(token[use] + bw.mix64((own[row[use]] + step).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(info[row[use]])], names=["key", "d1"])

    by_shingle = _dealt(sets.select("d1", "shingles").mapInArrow(tidy(dealt_out), _DEALT), buckets)
    return _dealt(by_shingle.mapInArrow(tidy(held), _DEALT), buckets).mapInArrow(tidy(prefixes), "key long, d1 long")


def _candidate_edges(keys: DataFrame) -> DataFrame:
    """Edges (a, b) by which all sets that share a key are connected."""
    shared = keys.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("key", "low")
    return keys.join(shared, "key").where("d1 <> low").select(F.col("low").alias("a"), F.col("d1").alias("b")).distinct()


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class _Node:
    __slots__ = ("bits", "lo", "hi", "slack", "below", "docs")

    def __init__(self, bits, lo, hi, slack, below, docs):
        self.bits, self.lo, self.hi, self.slack, self.below, self.docs = bits, lo, hi, slack, below, docs


def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 8), np.uint8)
    for i, s in enumerate(sets):
        at = (s % np.uint64(width)).astype(np.int64)
        np.bitwise_or.at(out[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _tree(docs: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> _Node:
    """A tree over `docs`, which are in order of size: leaves of LEAF documents, nodes of FAN children."""
    slack = sizes - np.bitwise_count(bits).sum(1)
    level = []
    for at in range(0, len(docs), LEAF):
        d = docs[at : at + LEAF]
        level.append(_Node(np.bitwise_or.reduce(bits[d], 0), int(sizes[d].min()), int(sizes[d].max()), int(slack[d].max()), None, d))
    while len(level) > 1:
        level = [_Node(np.bitwise_or.reduce([x.bits for x in g], 0), min(x.lo for x in g), max(x.hi for x in g), max(x.slack for x in g), g, np.concatenate([x.docs for x in g])) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
    return level[0]


def tree_join(sets: list[np.ndarray], tile: np.ndarray, p: int, q: int, across: bool, counter: dict | None = None) -> Forest:
    """Connect the sets that link, by dual traversal: within all of them, or `across` the tiles 0 and 1 only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    width = 256
    while width < 4 * int(sizes.max(initial=1)) and width < 1 << 14:
        width *= 2
    bits = _bitmaps(sets, width)
    slack = sizes - np.bitwise_count(bits).sum(1)
    forest = Forest(len(sets))
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    if across:
        trees = [_tree(order[tile[order] == t], bits, sizes) for t in (0, 1)]
        stack = [(trees[0], trees[1])]
    else:
        root = _tree(order, bits, sizes)
        stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a.hi * q < p * b.lo or b.hi * q < p * a.lo:
            continue
        # A link needs an overlap of p/(p + q) of both sizes; shared tokens share bits, but for those that collide.
        bound = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack)
        if bound * (p + q) < p * (a.lo + b.lo):
            continue
        if len(a.docs) + len(b.docs) > 2 * LEAF and len({forest.root(int(d)) for x in (a, b) for d in x.docs}) == 1:
            continue
        if a.below or b.below:
            if a is b:
                stack += [(x, y) for i, x in enumerate(a.below) for y in a.below[i:]]
            else:
                stack += [(x, y) for x in (a.below or [a]) for y in (b.below or [b])]
            continue
        both = np.bitwise_count(bits[a.docs][:, None, :] & bits[b.docs][None, :, :]).sum(2) + np.minimum(slack[a.docs][:, None], slack[b.docs][None, :])
        fit = both * (p + q) >= p * (sizes[a.docs][:, None] + sizes[b.docs][None, :])
        for i, j in np.argwhere(fit).tolist():
            x, y = int(a.docs[i]), int(b.docs[j])
            if (a is b and j <= i) or forest.root(x) == forest.root(y):
                continue
            if counter is not None:
                counter["verified"] = counter.get("verified", 0) + 1
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if common * q >= p * (len(sets[x]) + len(sets[y]) - common):
                forest.join(x, y)
    return forest


def _overlap_links(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * q >= p * (len(a) + len(b) - common)


def _pivot_links(sets: DataFrame, large: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) of the sets of large clusters with a few sets of the same cluster: `large` is (d1, cluster, n_shingles, cuts).

    For each of PIVOTS seeds a cluster's pivot is the set of the smallest hash. The sets of a
    cluster are dealt by hash into its `cuts`, and the pivots are sent to each of them: a few sets for TILE_DOCS others.
    """
    seeds = F.explode(F.array(*(F.lit(k) for k in range(PIVOTS)))).alias("seed")
    order = F.struct(F.xxhash64("seed", "d1").alias("h"), F.col("d1").alias("pivot"), "cuts")
    pivots = large.select("cluster", "d1", "cuts", seeds).groupBy("cluster", "seed").agg(F.min(order).alias("best")).select("cluster", "best.pivot", "best.cuts").distinct()
    own = sets.select(F.col("d1").alias("pivot"), F.col("shingles").alias("theirs"))
    held = pivots.join(own, "pivot").dropDuplicates(["cluster", "pivot"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, d, mine, theirs = (b.column(i) for i in range(4))
            hit = np.array([_overlap_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p, q) for x, y in zip(mine.to_pylist(), theirs.to_pylist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(hit)), d.filter(pa.array(hit))], names=["a", "b"])

    fit = (F.length("shingles") * q >= F.length("theirs") * p) & (F.length("theirs") * q >= F.length("shingles") * p)
    dealt = large.select("d1", "cluster", F.pmod(F.xxhash64("d1"), F.col("cuts")).cast("int").alias("cut"))
    met = sets.join(dealt, "d1").join(held, ["cluster", "cut"]).where(fit & (F.col("d1") != F.col("pivot")))
    return met.select(F.col("pivot").alias("a"), F.col("d1").alias("b"), "shingles", "theirs").mapInArrow(tidy(run), "a long, b long")


def _band(n: Column, p: int, q: int) -> Column:
    """Size bands as an expression: sets that link are at most one apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(q / p)) - F.lit(1e-9)).cast("int") if q > p else n.cast("int")


def _cuts() -> Column:
    """How many tiles hold `docs` sets of `tokens` shingles."""
    return F.greatest(F.ceil(F.col("docs") / TILE_DOCS), F.ceil(F.col("tokens") / TILE_SHINGLES)).cast("int")


def _tile_pairs(chosen: DataFrame, p: int, q: int) -> DataFrame:
    """(d1, cluster, t1, t2, side): every set of a cluster, once for each pair of tiles that it is part of.

    `chosen` is (d1, cluster, part, n_shingles) with the cluster's `docs` and `tokens`; sets of one
    `part` are known to be connected, a null part says nothing. A cluster within a tile's bounds is one tile. Tiles of larger ones hold
    sets of one part and one size band; two tiles meet if that could connect anything new, and if
    their bands touch. Tiles of the largest part only meet others, so their pairs are never listed.
    All this is told before any set is moved.
    """
    small = (F.col("docs") <= TILE_DOCS) & (F.col("tokens") <= TILE_SHINGLES)
    whole = F.lit(0).cast("long")
    one = chosen.where(small).select("d1", "cluster", whole.alias("t1"), whole.alias("t2"), F.lit(0).alias("side"))
    large = chosen.where(~small).select("d1", "cluster", F.coalesce("part", F.lit(0)).alias("part"), F.col("part").isNull().alias("loose"), "n_shingles", _band(F.col("n_shingles"), p, q).alias("band"))
    kind = ["cluster", "loose", "part", "band"]
    within = large.groupBy(*kind).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("tokens"))
    main = within.where("NOT loose").groupBy("cluster", "part").agg(F.sum("docs").alias("docs")).groupBy("cluster").agg(F.max(F.struct("docs", "part"))["part"].alias("main"))
    within = within.join(main, "cluster", "left").select(*kind, _cuts().alias("cuts"), (~F.col("loose") & (F.col("part") == F.col("main"))).alias("largest"))
    tile = F.xxhash64("loose", "part", "band", "cut")
    tiles = within.select(*kind, "largest", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).withColumn("tile", tile)
    of = lambda side: tiles.select("cluster", *(F.col(c).alias(f"{c}_{side}") for c in ("loose", "part", "band", "tile", "largest")))
    new = (F.col("loose_a") != F.col("loose_b")) | (F.col("part_a") != F.col("part_b")) | F.col("loose_a")
    once = F.col("largest_b") | (F.col("tile_a") < F.col("tile_b")) | (F.col("tile_a") == F.col("tile_b"))
    near = of("a").where("NOT largest_a").withColumn("band_b", F.explode(F.array(*(F.col("band_a") + k for k in (-1, 0, 1)))))
    pairs = near.join(of("b"), ["cluster", "band_b"]).where(new & once).select("cluster", F.col("tile_a").alias("t1"), F.col("tile_b").alias("t2"))
    sides = pairs.select("*", F.col("t1").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.where("t1 <> t2").select("*", F.col("t2").alias("tile"), F.lit(1).alias("side")))
    cut = large.join(within, kind).withColumn("cut", F.pmod(F.xxhash64("d1"), F.col("cuts")).cast("int")).select("d1", "cluster", tile.alias("tile"))
    return one.unionByName(cut.join(sides, ["cluster", "tile"]).select("d1", "cluster", "t1", "t2", "side"))


def _verified_edges(sets: DataFrame, dealt: DataFrame, p: int, q: int) -> DataFrame:
    """Spanning edges (a, b) of the links within each pair of tiles of `dealt` (d1, cluster, t1, t2, side)."""
    moved = dealt.join(sets.select("d1", "shingles"), "d1").select("cluster", "t1", "t2", "side", "d1", "shingles")
    sorted_ = moved.repartition("cluster", "t1", "t2").sortWithinPartitions("cluster", "t1", "t2", "d1")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        key, rows = None, []
        for b in batches:
            for cluster, t1, t2, side, d1, raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (cluster, t1, t2) != key:
                    if rows:
                        yield key, rows
                    key, rows = (cluster, t1, t2), []
                if not rows or rows[-1][0] != d1:  # several tasks may have handed on one set
                    rows.append((d1, side, np.frombuffer(raw, np.uint64)))
        if rows:
            yield key, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for (_, t1, t2), rows in groups(batches):
            tile = np.array([r[1] for r in rows])
            if len(rows) < 2 or t1 != t2 and tile.min() == tile.max():
                continue
            forest = tree_join([r[2] for r in rows], tile, p, q, t1 != t2)
            for i, r in enumerate(rows):
                if (k := forest.root(i)) != i:
                    left.append(rows[k][0])
                    right.append(r[0])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return sorted_.mapInArrow(tidy(run), "a long, b long")


def _links(sets: DataFrame, chosen: DataFrame, p: int, q: int) -> DataFrame:
    """`node` and `component` of the sets that links connect within the clusters of `chosen` (d1, cluster, n_shingles)."""
    size = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("tokens"))
    # Written out, so that a hot cluster's rows are a side of a plain join, which Spark splits, and no later step inherits their place.
    sized = stash(chosen.join(size, "cluster"), "join-sized")
    large = sized.where((F.col("docs") > TILE_DOCS) | (F.col("tokens") > TILE_SHINGLES)).select("d1", "cluster", "n_shingles", _cuts().alias("cuts"))
    first = stash(_pivot_links(sets, large, p, q), "join-pivots")
    parts = connected(first)
    parted = sized.join(parts, F.col("d1") == F.col("node"), "left").select("d1", "cluster", F.col("component").alias("part"), "n_shingles", "docs", "tokens")
    rest = stash(_verified_edges(sets, _tile_pairs(parted, p, q), p, q), "join-tiles")
    out = connected(first.unionByName(rest))
    discard(sized, first, parts, rest)
    return out


def jaccard_classes(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, text_key, n_shingles, and the smallest (doc_id, text_key) reachable by links of similarity p/q or more: component_id, component_key."""
    every = stash(_describe(docs, n), "join-rows")
    rows = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    told = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles")).first()
    common = Common(docs, n, told["rows"])
    buckets = max(1, (told["shingles"] or 0) * (q - p + q // SPARE) // q // BUCKET)
    promising = stash(_promising(docs, n, p, q, common, buckets), "join-promising")
    texts = stash(rows.join(promising, "d1").groupBy("d1").agg(F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n_shingles")), "join-texts")
    left = texts.agg(F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("shingles")).first()
    sets = stash(_wanted_sets(docs, n, Members(texts, "text_key", left["texts"])), "join-sets")
    keys = stash(_candidate_keys(sets, p, q, common, max(1, (left["shingles"] or 0) // BUCKET)), "join-keys")
    clusters = connected(_candidate_edges(keys))
    sizes = rows.groupBy(F.col("d1").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    chosen = stash(clusters.join(sizes, "node").select(F.col("node").alias("d1"), F.col("component").alias("cluster"), "n_shingles"), "join-clusters")
    discard(promising, texts, keys, clusters)

    links = _links(sets, chosen, p, q)
    classes = rows.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("own"))
    linked = classes.join(links, F.col("d1") == F.col("node"), "left").select("n_shingles", "d1", "d2", "own", F.coalesce("component", "d1").alias("component"))
    least = linked.groupBy("component").agg(F.min("own").alias("first"))
    named = linked.join(least, "component").select("n_shingles", "d1", "d2", "first")
    out = rows.join(named, ["n_shingles", "d1", "d2"]).select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_key"))
    apart = every.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_key").alias("component_key"))
    result = stash(out.union(apart), "join-result")
    discard(every, sets, chosen, links)
    return result


def jaccard_components(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links of similarity p/q or more."""
    return jaccard_classes(docs, n, p, q).select("doc_id", "n_shingles", "component_id")
