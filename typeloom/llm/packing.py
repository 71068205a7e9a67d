"""Best-fit packing by a configuration linear program over the histogram of lengths.

Documents become token ids, longer ones are cut, and only the histogram of piece lengths (at
most `capacity` entries) reaches the driver. There a configuration is a multiset of lengths
that fits a sequence, none more often than its pieces are left. The program (fewest sequences
that hold all pieces) is solved by multiplicative weights: a length's price falls as it is
covered, and a knapsack dynamic program finds the configuration of the highest price, which is
used a whole number of times. Of more than `PRICED` lengths that are left, the program takes one of
each group of neighbours, that of the highest price per token. It ends when all pieces are covered.
Every `ROUNDS` rounds what is left is also filled by best fit, still on counts of lengths and never on
single pieces. The plan is the first of these of which the program has made half, and that is within
`GAP` of tokens / capacity sequences, rounded up, which no plan is below; else the one of the fewest sequences,
best fit alone included.

Pieces then look up their place. The pieces of one length are numbered in parallel (within
hash buckets, whose counts are summed first), so that a hot length isn't one task, and a number
falls in a segment of the plan that says which sequences, in which place.

Defined results: a null text has no ids but the end id; equal documents each get their own
place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm import bytewords
from typeloom.llm.common import stash, tidy
from typeloom.llm.wordbpe import WordBpe

CAPACITY = 4096
END_ID = 1
#: Rounds of the multiplicative weights between two tests of the gap, and how fast prices fall.
ROUNDS, RATE = 160, 4.0
#: Lengths that a round prices; bounds its time.
PRICED = 256
#: One sequence in so many that a plan may be above the bound.
GAP = 5000
#: Power of a length in its first price: above 1, of configurations equally full the one of longer pieces comes first.
POWER = 1.001
#: Pieces aimed at in one numbering bucket of one length.
BUCKET_PIECES = 50_000

_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in bytewords.ranges(whole):
                doc, piece, start, length, crc = [], [], [], [], []
                for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


#: A configuration: the places of its lengths in the table of lengths, in rising order, and how often it has each.
Config = tuple[np.ndarray, np.ndarray]
Used = list[tuple[Config, int]]


def price_configuration(lengths: np.ndarray, price: np.ndarray, left: np.ndarray, capacity: int, priced: int = PRICED) -> Config:
    """The configuration of the highest total price, no length above its `left`: a bounded knapsack program."""
    best = np.zeros(capacity + 1)
    taken = []
    open_ = np.flatnonzero(left)
    if len(open_) > priced:
        # Neighbours in length: of each group, the one of the highest price per token.
        worth = price[open_] / lengths[open_]
        group = np.arange(len(open_)) * priced // len(open_)
        order = np.lexsort((-worth, group))
        open_ = np.sort(open_[order[np.searchsorted(group, np.arange(priced))]])
    for k in open_.tolist():
        length, copies, n = int(lengths[k]), min(int(left[k]), capacity // int(lengths[k])), 1
        # 1, 2, 4 and so on of a length, and what remains: any number is a sum of some of them.
        while copies:
            n = min(n, copies)
            room = n * length
            worth = best[:-room] + n * price[k]
            better = worth > best[room:]
            np.copyto(best[room:], worth, where=better)
            taken.append((k, n, room, better))
            copies, n = copies - n, 2 * n
    counts: dict[int, int] = {}
    free = capacity
    for k, n, room, better in reversed(taken):
        if room <= free and better[free - room]:
            counts[k] = counts.get(k, 0) + n
            free -= room
    return _config(counts)


def _config(counts: dict[int, int]) -> Config:
    held = sorted(counts)
    return np.array(held, np.int64), np.array([counts[k] for k in held], np.int64)


def solve_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, power: float = POWER, rounds: int = ROUNDS, rate: float = RATE) -> Iterator[tuple[Used, Used]]:
    """Configurations and how often each is used: those of the program so far and best fit's of the rest, each `rounds` rounds; at last the program's alone."""
    chosen: Used = []
    left = demand.copy()
    most = max(1, fewest(lengths, demand, capacity) * 4 // rounds)
    while left.any():
        # Worth a share of the sequence while it is uncovered; exponentially less as it is covered.
        price = (lengths / capacity) ** power * np.exp(-rate * (1 - left / demand))
        held, n = price_configuration(lengths, price, left, capacity)
        times = min(int((left[held] // n).min()), most)
        chosen.append(((held, n), times))
        left[held] -= times * n
        if len(chosen) % rounds == 0 and left.any():
            yield chosen, best_fit(lengths, left, capacity)
    yield chosen, []


def fewest(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> int:
    """A bound that no plan is below: all tokens in full sequences."""
    return -(-int((lengths * demand).sum()) // capacity)


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Used:
    """Fill sequences from the longest piece on, each time with the longest that still fits, as often as counts allow."""
    out: Used = []
    left = left.copy()
    while left.any():
        counts: dict[int, int] = {}
        room = capacity
        open_ = np.flatnonzero(left)
        at = len(open_)
        while at:
            # The longest that is left and fits; what is taken wholly doesn't come again.
            at = min(at, int(np.searchsorted(lengths[open_], room, "right")))
            if at:
                k = int(open_[at - 1])
                n = min(int(left[k]), room // int(lengths[k]))
                counts[k] = n
                room -= n * int(lengths[k])
                at -= 1
        held, n = _config(counts)
        times = int((left[held] // n).min())
        out.append(((held, n), times))
        left[held] -= times * n
    return out


@dataclass
class Plan:
    """Segments by (length, first number): where the pieces of a length go. At most a few per configuration."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The first plan that the program has made half of within the gap, or else that of the fewest sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    bound, sequences = fewest(lengths, demand, capacity), lambda used: sum(n for _, n in used)
    best: Used | None = None
    for program, rest in solve_configurations(lengths, demand, capacity):
        if best is None or sequences(program) + sequences(rest) < sequences(best):
            best = program + rest
        if 2 * sequences(program) >= bound and sequences(best) <= bound + bound // GAP:
            return _plan(lengths, best)
    rest = best_fit(lengths, demand, capacity)  # all of it: seldom better than any the program has a part in
    return _plan(lengths, rest if best is None or sequences(rest) < sequences(best) else best)


def _plan(lengths: np.ndarray, chosen: Used) -> Plan:
    rows, given, base = [], np.zeros(len(lengths), np.int64), 0
    for (held, each), times in chosen:
        offset = 0
        for k, n in zip(held[::-1].tolist(), each[::-1].tolist(), strict=True):
            rows.append((int(lengths[k]), int(given[k]), base, n, offset))
            given[k] += times * n
            offset += n * int(lengths[k])
        base += times
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 5)
    return Plan((t[:, 0] << 44) + t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4], base)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence_id and offset; sequences are filled from 0 without gaps."""
    cut = stash(pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    per_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(per_length, capacity)
    shared = cut.sparkSession.sparkContext.broadcast(plan)

    buckets = max(64, math.ceil(max(per_length.values(), default=0) / BUCKET_PIECES))
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(order) - 1).join(bases, ["length", "bucket"])
    ready = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, number = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            k = np.searchsorted(p.key, (length << 44) + number, "right") - 1
            q = number - p.first[k]
            sequence, offset = p.sequence[k] + q // p.each[k], p.offset[k] + q % p.each[k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ready.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
