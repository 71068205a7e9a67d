"""Helpers that the curation operators share: folds, stashed tables, bounded samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word everywhere in this package: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold_of(col: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A deterministic double in (0, 1) made of the given columns, with 52 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="typeloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if all runs in this process, and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{_own_folder()}").rstrip("/")


#: Texts in one Arrow batch take no more than so many bytes, but for a single longer text.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, as both sides of a Python worker hold several of one at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < have <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the Python worker, which Spark keeps for other tasks, gives back the memory that is free in it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, computes `df` once however often it is read, and survives lost
    executors since every executor reads the same files. `discard` deletes them.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    out.stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete the files of stashed tables that nothing reads any more."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(rows: DataFrame, per_class: int, by: str, *identity: str | Column) -> DataFrame:
    """About `per_class` rows of `rows` of each non-null value of `by`, or all where no class has more than 1.2 * `per_class` + 60.

    A row is taken if the hash of `identity` (what makes it this row) is below its class's share, or
    is the least of its class: so the choice depends neither on the partitioning nor on any order,
    no class is lost, and no class is gathered in one task. Never more than 1.2 * `per_class` + 60
    rows of a class are taken: where rows of equal identity would make it more, those of
    the smallest hashes are.
    """
    h = unit_hash(*identity, seed=17)
    most = per_class * 6 // 5 + 60
    known = rows.where(F.col(by).isNotNull())
    told = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("least")).collect()
    if max((r["n"] for r in told), default=0) <= most:
        return known
    limits = [x for r in sorted(told, key=lambda r: r[by]) for x in (F.lit(r[by]), F.lit(max(per_class / r["n"], r["least"])))]
    some = known.where(h <= F.element_at(F.create_map(*limits), F.col(by)))
    if max(r["n"] for r in some.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()) <= most:
        return some
    place = F.row_number().over(Window.partitionBy(by).orderBy(h, *identity))
    return some.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, most_chars: int | None = None) -> tuple[DataFrame, float]:
    """doc_id, text and y of a bounded sample of labelled documents whose crc32(doc_id) mod 3 is not 1; and the share of label 1 among such labels.

    Labels other than 0 and 1 are left out, repeated equal ones count once, and an id that has both is
    a sample of both. Texts that are null or longer than `most_chars` teach nothing.
    """
    known = labels.where(F.col(column).isin(0, 1) & (fold_of("doc_id", 3) != 1)).select("doc_id", F.col(column).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.where(F.col("text").isNotNull() if most_chars is None else F.length("text") <= most_chars).select("doc_id", "text")
    # At most 1.2 * per_class + 60 ids of each of two labels: small enough to broadcast whatever the corpus.
    chosen = bounded_sample(known, per_class, "y", "doc_id")
    return bounded_sample(texts.join(F.broadcast(chosen), "doc_id"), per_class, "y", "doc_id", F.xxhash64("text")), share


def in_order(sample: DataFrame, *more: str) -> list[Row]:
    """The rows of a bounded sample, in an order that only their content makes."""
    return sorted(sample.collect(), key=lambda r: ((r["doc_id"] * 0x9E3779B1) % (1 << 32), *(r[c] for c in ("doc_id", *more))))


def null_safe_key(col: str) -> Column:
    """A non-null string key that keeps null apart from every string."""
    return F.when(F.col(col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(col).cast("string")))


def refuse_clashes(carried: Iterable[str], *added: str) -> None:
    """Carried columns can't have the name (in any case) of one that an operator adds."""
    taken = {a.lower() for a in added}
    if bad := [c for c in carried if c.lower() in taken]:
        raise ValueError(f"rename {', '.join(map(repr, bad))} first: columns of that name are added")
