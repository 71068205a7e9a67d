"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is spent in complete epochs first; what is left over is a weighted sample
without replacement: each document draws an exponential key divided by its quality weight,
and documents are taken in the order of their keys while the prefix sum of their sizes stays
within the budget. The document at the boundary is taken in part, so the words taken meet
the target to within one word.

The order within a source is found without gathering it: keys fall into bins of the logarithm
of the key, `PER_OCTAVE` to a factor of two, whatever the source's size and weights; bins are summed, and
only then are documents ordered within their bin. Whatever the weights, a bin holds less than
one in a thousand of a source's documents, but for its smallest keys, so a hot source is spread evenly.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own, ordered last; a null quality counts as none; rows with equal keys are ordered by doc_id and size;
repeated rows count each for itself; an empty table gives an empty result; other columns are
ignored unless carried, and a carried name that is added (in any case) is refused. One row a source
reaches the driver, where the targets are worked out: sources are terms of a mixture, not hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import WORD, null_safe_key, refuse_clashes, stash, unit_hash

#: Bins of keys to a factor of two.
PER_OCTAVE = 1024
#: The weight of a document of quality 0; that of quality 1 is 1.
LEAST_WEIGHT = 0.1


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source.

    Sources in code-point order (null last) get `weights` in turn and divide `share` times all
    words; a target stops at `most` times its source's words and the excess is shared again by
    weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    left, open_ = share * sum(size.values()), list(size)
    while open_:
        total = sum(weigh[s] for s in open_)
        full = [s for s in open_ if left * weigh[s] / total >= most * size[s]]
        if not full:
            out |= {s: left * weigh[s] / total for s in open_}
            break
        # One at a time would give the same: what a full source leaves only raises the others.
        for s in full:
            out[s] = most * size[s]
        left = max(0.0, left - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in out]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20, carry: tuple[str, ...] = (), quality: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted), and columns named in `carry`.

    `quality` names a column of scores from 0 to 1, by which documents are weighted; without it all weigh 1.
    """
    refuse_clashes(carry, "size", "source_size", "target", "taken", "__key", "__source", "__bin")
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.lit(1.0) if quality is None else LEAST_WEIGHT + (1 - LEAST_WEIGHT) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(quality), F.lit(0.0))))
    key = -F.log(unit_hash(F.col("doc_id"), seed=seed)) / weight
    named = [F.col(c) for c in dict.fromkeys(carry) if c not in ("doc_id", "source")]
    sized = stash(docs.select("doc_id", F.col("source"), *named, size.alias("size"), key.alias("__key")), "mix-sizes")

    per_source = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    aim = targets([(r["source"], r["size"]) for r in per_source], weights, share, most)
    budgets = spark.createDataFrame(
        [("0" if r["source"] is None else "1" + r["source"], r["size"], float(aim[r["source"]])) for r in per_source],
        "__source string, source_size long, target double",
    )
    keyed = sized.withColumns({"__source": null_safe_key("source"), "__bin": F.floor(F.log2("__key") * PER_OCTAVE).cast("int")})

    sums = keyed.groupBy("__source", "__bin").agg(F.sum("size").alias("words"))
    before = sums.withColumn("base", F.sum("words").over(Window.partitionBy("__source").orderBy("__bin")) - F.col("words"))
    starts = before.join(budgets, "__source").select("__source", "__bin", F.col("base").alias("__base"), "source_size", "target")

    within = Window.partitionBy("__source", "__bin").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["__source", "__bin"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("__base") - F.col("__ahead")))
    taken = (epochs * F.col("size") + part).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(c for c in dict.fromkeys(carry) if c != "doc_id"))
