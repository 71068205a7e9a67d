"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers (floor of a scale times each component) and are grouped by length into
buckets: blocks of a range partitioning by length, longest first. Every query starts from a
lower bound of its k-th score, which the longest vectors give. At a bucket that bound over the
query's and the bucket's largest length (its smallest, if the bound is negative) is a local cosine
threshold: above 1 the bucket is left out; if it is high, candidates are pruned by single
coordinates (a vector within the threshold's angle of the query can't be far from it in the
query's largest coordinates); else by their own length. What is left is verified by exact integer
products: doubles where no sum of products can leave 2**52, 64-bit integers elsewhere.

Queries are a stated set against all rows, in blocks. A query's bound over its length is the
least length that a result can have; queries are grouped by it, and a group of query blocks
meets only the groups of bucket blocks that hold such lengths (`LengthClasses`), a task each. So
what can't hold a result isn't sent. Each task hands on at most k rows a query.

Defined results: vectors that are null, or hold a null or non-finite component, or have no id
take no part; nor do those whose integers are longer than `LONGEST`, since their products may
leave 64 bits (this is told of each vector by itself, and changes nothing for others). Vectors are
compared with those of equal dimension. A row repeated with its id and vector counts once; rows
of the query's own id are never its results. Ties go to the smaller vec_id. An empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import discard, stash, tidy

K = 10
SCALE = 1024
#: Vectors in a bucket's block, queries in a block, blocks in a group of either.
BLOCK, QUERIES, GROUP = 1024, 512, 8
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.7
FOCUS = 2
#: Two vectors of this length have a product within 64 bits.
LONGEST = 2.0**31
#: Sums of products of vectors whose lengths' product is below this are exact in doubles.
EXACT = 2.0**52
#: Below any product.
NO_BOUND = -(1 << 63)
#: Length classes by factors of two.
PER_OCTAVE = 8


def _vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column without nulls in it, by dimension: their numbers, and a matrix."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    at = np.cumsum(size) - size
    flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[valid]).tolist():
        rows = np.flatnonzero(valid & (size == dim))
        yield rows, flat[at[rows][:, None] + np.arange(dim)]


def _integers(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, norm2 and the integer vector as bytes (little-endian doubles) of each row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for rows, x in _vectors(b.column(1)):
                with np.errstate(over="ignore", invalid="ignore"):
                    w = np.floor(scale * x)
                    norm2 = (w * w).sum(1)
                keep = known[rows] & np.isfinite(x).all(1) & (norm2 < LONGEST * LONGEST)
                raw = [r.tobytes() for r in w[keep].astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[keep]], pa.int64()), pa.array(np.full(keep.sum(), w.shape[1]), pa.int32()), pa.array(norm2[keep]), pa.array(raw, pa.binary())], names=["vec_id", "dim", "norm2", "raw"])

    return df.mapInArrow(tidy(run), "vec_id long, dim int, norm2 double, raw binary").dropDuplicates(["vec_id", "raw"])


_BLOCK_SCHEMA = "dim int, n int, longest double, least double, ids binary, mat binary, bounds binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, dim, norm2, raw, bound) in their order within each partition as blocks of at most `size` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            norm = [r[2] ** 0.5 for r in held]
            need = [needed_length(np.array([r[4] for r in held]), np.array(norm)).min()]
            blobs = [np.array([r[0] for r in held], "<i8").tobytes(), b"".join(r[3] for r in held), np.array([r[4] for r in held], "<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([held[0][1]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([max(norm)]), pa.array(need), *(pa.array([x], pa.binary()) for x in blobs)], names=["dim", "n", "longest", "least", "ids", "mat", "bounds"])

        held: list = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (len(held) >= size or held[0][1] != r[1]):
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return rows.select("vec_id", "dim", "norm2", "raw", "bound").mapInArrow(tidy(run), _BLOCK_SCHEMA)


def needed_length(bound: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The least length of a vector whose product with a query of length `norm` can reach `bound`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(bound > 0, np.where(norm > 0, bound / norm, np.inf), 0.0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two matrices of integers, as 64-bit integers."""
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


class Searcher:
    """The running best of a group of queries against buckets that come one by one."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.mat, self.k = ids, mat, k
        self.norm = np.sqrt((mat * mat).sum(1))
        self.bound = bound.astype(np.int64)
        self.q, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tally = {"left out": 0, "by length": 0, "by coordinate": 0, "verified": 0}

    def bucket(self, ids: np.ndarray, mat: np.ndarray) -> None:
        norm = np.sqrt((mat * mat).sum(1))
        order = np.argsort(-norm, kind="stable")
        ids, mat, norm = ids[order], mat[order], norm[order]
        bound = self.bound.astype(np.float64)
        # What no vector's cosine may fall below: a negative bound asks least of the shortest.
        reach = self.norm * np.where(bound < 0, norm[-1], norm[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, bound / reach, np.where(bound > 0, np.inf, -np.inf))
        live = np.flatnonzero(local <= 1 + 1e-9)
        self.tally["left out"] += len(local) - len(live)
        if not len(live):
            return
        # Doubles may be off by so much; what comes near a bound is worked out in integers.
        largest = float(self.norm[live].max() * norm[0])
        exact = largest < EXACT
        off = 0.0 if exact else largest * (mat.shape[1] + 2) * 2.0**-51
        if np.median(local[live]) >= COORDINATE_FROM:
            self.tally["by coordinate"] += len(live)
            unit = mat / np.maximum(norm, 1e-300)[:, None]
            found = []
            for i in live.tolist():
                q, t = self.mat[i] / max(self.norm[i], 1e-300), max(-1.0, min(1.0, local[i]))
                near = np.ones(len(ids), bool)
                for f in np.argsort(-np.abs(q))[:FOCUS].tolist():
                    slack = math.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + 1e-9
                    # The angle to the query is at most arccos t: beyond the query's own angle to the axis the bound is 1.
                    low = -1.0 if -q[f] >= t else q[f] * t - slack
                    high = 1.0 if q[f] >= t else q[f] * t + slack
                    near &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
                at = np.flatnonzero(near)
                score = mat[at] @ self.mat[i]
                self.tally["verified"] += len(at)
                hit = (score >= bound[i] - off) & (ids[at] != self.ids[i])
                found.append((np.full(hit.sum(), i), at[hit], score[hit]))
            q, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            self.tally["by length"] += len(live)
            shortest = needed_length(bound[live], self.norm[live]).min()
            n = int(np.searchsorted(-norm, -shortest * (1 - 1e-9) if shortest > 0 else np.inf, "right"))
            score = self.mat[live] @ mat[:n].T
            self.tally["verified"] += score.size
            a, b = np.nonzero((score >= bound[live][:, None] - off) & (self.ids[live][:, None] != ids[None, :n]))
            q, s = live[a], score[a, b]
        s = s.astype(np.int64) if exact else np.concatenate([products(self.mat[q[i : i + 65536]], mat[b[i : i + 65536]]) for i in range(0, max(1, len(q)), 65536)])
        sure = s >= self.bound[q]
        q, c, s = np.concatenate([self.q, q[sure]]), np.concatenate([self.c, ids[b[sure]]]), np.concatenate([self.s, s[sure]])
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.c, self.s = q[keep], c[keep], s[keep]
        full = self.q[rank[keep] == self.k - 1]
        self.bound[full] = np.maximum(self.bound[full], self.s[rank[keep] == self.k - 1])


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(n, dim)


def start_bounds(ids: np.ndarray, mat: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score: its k-th score among the seed, less what doubles may be off."""
    out = np.full(len(ids), NO_BOUND)
    if len(seed_ids) < k:
        return out
    score = mat @ seed.T
    score[ids[:, None] == seed_ids[None, :]] = -np.inf
    low = -np.partition(-score, k - 1, 1)[:, k - 1]
    off = np.sqrt((mat * mat).sum(1)) * np.sqrt((seed * seed).sum(1).max()) * (mat.shape[1] + 2) * 2.0**-51
    has = np.isfinite(low)
    out[has] = np.floor(low[has] - np.where(off[has] < 0.5, 0, off[has])).astype(np.int64)
    return out


class LengthClasses:
    """Which groups of queries meet which groups of buckets, told by classes of length; at most a few hundred classes.

    Places of buckets come longest first, those of queries by the length they need; so those that
    a group must meet are the places from 0 up to some number.
    """

    @staticmethod
    def of(length: Column) -> Column:
        return F.when(length >= 1, F.floor(F.log2(length) * PER_OCTAVE).cast("int")).otherwise(F.lit(-1))

    def __init__(self, blocks: DataFrame, queries: DataFrame):
        # A need is rounded down a little: lengths are square roots.
        last = lambda df, length: {r["c"]: r["m"] for r in df.groupBy(self.of(length).alias("c")).agg(F.max("place").alias("m")).collect()}
        self.need = self.of(F.col("least") * (1 - 1e-9))
        self.blocks, self.queries = last(blocks, F.col("longest")), last(queries, F.col("least") * (1 - 1e-9))

    def _up_to(self, length_class: Column, table: dict[int, int], fits) -> Column:
        known = sorted({*self.blocks, *self.queries})
        most = {c: max([table[d] for d in table if fits(c, d)], default=-1) for c in known}
        pairs = [x for c, m in most.items() for x in (F.lit(c), F.lit(m))]
        upto = F.element_at(F.create_map(*pairs), length_class) if pairs else F.lit(-1)
        return F.explode(F.when(upto >= 0, F.sequence(F.lit(0), upto)).otherwise(F.array().cast("array<int>")))

    def bucket_places(self) -> Column:
        """For a query block: the places of buckets that may be long enough."""
        return self._up_to(self.need, self.blocks, lambda c, d: d >= c)

    def query_places(self) -> Column:
        """For a bucket's block: the places of queries that it may be long enough for."""
        return self._up_to(self.of(F.col("longest")), self.queries, lambda c, d: d <= c)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", sent: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` highest integer products of each query with all other rows.

    `sent`, if given, gets the number of blocks sent to tasks and of all pairs of groups.
    """
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    rows = stash(_integers(picked, scale), "topk-vectors")
    n = rows.count()
    parts = max(1, math.ceil(n / (BLOCK * GROUP)))
    ranged = rows.repartitionByRange(parts, F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.asc("dim"), F.desc("norm2"), F.asc("vec_id"))
    buckets = stash(_blocks(ranged.withColumn("bound", F.lit(NO_BOUND)), BLOCK).withColumn("place", F.spark_partition_id()), "topk-buckets")

    # The longest BLOCK vectors: one block, whatever the table's size.
    seed: dict[int, list] = {}
    for r in rows.orderBy(F.desc("norm2"), "vec_id").limit(BLOCK).collect():
        seed.setdefault(r["dim"], []).append((r["vec_id"], bytes(r["raw"])))
    first = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x]), _matrix(b"".join(raw for _, raw in x), len(x), d)) for d, x in seed.items()})

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raws, bound = b.column(3).to_pylist(), np.full(len(ids), NO_BOUND)
            for dim in np.unique(dims).tolist():
                for at in np.array_split(np.flatnonzero(dims == dim), math.ceil((dims == dim).sum() / QUERIES)):
                    if dim in first.value:
                        bound[at] = start_bounds(ids[at], _matrix(b"".join(raws[i] for i in at.tolist()), len(at), dim), *first.value[dim], k)
            need = needed_length(bound.astype(np.float64), np.sqrt(b.column(2).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bound), pa.array(need)], names=["vec_id", "dim", "norm2", "raw", "bound", "need"])

    asked = rows.where(is_query).select("vec_id", "dim", "norm2", "raw").mapInArrow(tidy(bounded), "vec_id long, dim int, norm2 double, raw binary, bound long, need double")
    groups = max(1, math.ceil(rows.where(is_query).count() / (QUERIES * GROUP)))
    asked = asked.repartitionByRange(groups, "need", "vec_id").sortWithinPartitions("dim", "need", "vec_id")
    queries = stash(_blocks(asked, QUERIES).withColumn("place", F.spark_partition_id()), "topk-queries")

    classes = LengthClasses(buckets, queries)
    both = queries.select(F.lit(0).alias("kind"), "*", F.col("place").alias("h"), classes.bucket_places().alias("g")).unionByName(
        buckets.select(F.lit(1).alias("kind"), "*", F.col("place").alias("g"), classes.query_places().alias("h"))
    )
    if sent is not None:
        sent |= {"blocks": both.where("kind = 1").count(), "all": buckets.count() * (queries.agg(F.max("place")).first()[0] or 0) + buckets.count()}
    met = both.repartition("g", "h").sortWithinPartitions("g", "h", "kind", F.desc("longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(searchers: list[Searcher]) -> Iterator[pa.RecordBatch]:
            for x in searchers:
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.q]), pa.array(x.c), pa.array(x.s)], names=["query_id", "vec_id", "score"])

        key, searchers = None, []
        for b in batches:
            for g, h, kind, dim, n, ids, mat, bound in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (g, h) != key:
                    yield from out(searchers)
                    key, searchers = (g, h), []
                ids, m = np.frombuffer(ids, "<i8"), _matrix(mat, n, dim)
                if kind == 0:
                    searchers.append(Searcher(ids, m, np.frombuffer(bound, "<i8"), k))
                    continue
                for x in searchers:
                    if x.mat.shape[1] == dim:
                        x.bucket(ids, m)
        yield from out(searchers)

    found = met.select("g", "h", "kind", "dim", "n", "ids", "mat", "bounds").mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    out = stash(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-result")
    discard(rows, buckets, queries)
    return out
