"""Quality classifier by compression: a text is likened to the corpus whose dictionary packs it better.

Two zstandard dictionaries are trained, of good and of bad labelled texts. A text is cut into
blocks, each block is compressed with either dictionary on its own (so a long text is judged
by all of its parts), and the differences in compressed size, per byte, become features of
a logistic calibration.

Labels are learned from a bounded sample: at most `PER_CLASS` documents a class, of at most
`TRAIN_CHARS` characters each. Every text is scored whole.

Defined results: a null or empty text scores the share of label 1 among the labels learned
from; without labels of both classes every score is that share (0.5 without any label).
Repeated rows score alike; equal labels of one id count once, labels other than 0 and 1 not at
all. An empty table gives an empty result; other columns are ignored unless carried, and a
carried `score` or `predicted` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import bound_batches, in_order, labelled_sample, refuse_clashes, tidy

PER_CLASS = 1500
TRAIN_CHARS = 20_000
DICT_BYTES = 48 << 10
BLOCK = 512
LEVEL = 1


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients (intercept first) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


class CompressionClassifier:
    """Two dictionaries and a calibration; `None` dictionaries mean that only the prior is known."""

    def __init__(self, good: bytes | None, bad: bytes | None, prior: float = 0.5):
        self.good, self.bad, self.prior = good, bad, prior
        self.calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def _pack(self) -> tuple:
        if not hasattr(self, "_packers"):
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self._packers = tuple(made)
        return self._packers

    def features(self, text: bytes) -> list[float]:
        """The size difference per byte, of the whole text, and of the blocks that differ most to either side.

        A last block counts by a whole block's size, so the shorter it is, the less it can say.
        """
        good, bad = self._pack()
        total, most, least = 0, -1.0, 1.0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            d = len(good(block)) - len(bad(block))
            total += d
            most, least = max(most, d / BLOCK), min(least, d / BLOCK)
        return [total / len(text), most, least]

    def fit(self, texts: list[str], y: np.ndarray, share: float) -> None:
        """`share`: label 1 among all labelled rows that may be learned from, to undo the balanced sample."""
        x = np.array([self.features(t.encode()) for t in texts])
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        self.calibration = fit_logistic(x, y, weight)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        rows = [i for i, t in enumerate(texts) if t]
        if rows and self.calibration is not None:
            mean, scale, w = self.calibration
            x = (np.array([self.features(texts[i].encode()) for i in rows]) - mean) / scale
            out[rows] = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
        return out


def _dictionary(texts: list[str]) -> bytes:
    blocks = [raw[at : at + BLOCK] for raw in (t.encode() for t in texts) for at in range(0, len(raw), BLOCK)]
    total = sum(map(len, blocks))
    if len(blocks) < 16 or total < 8 * 1024:
        return b"".join(blocks)[-DICT_BYTES:] or b" "
    try:
        return zstandard.train_dictionary(max(2048, min(DICT_BYTES, total // 8)), blocks).as_bytes()
    except zstandard.ZstdError:  # too uniform to train from: the texts themselves are a dictionary too
        return b"".join(blocks)[-DICT_BYTES:]


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> CompressionClassifier:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    sample, share = labelled_sample(docs, labels, column, PER_CLASS, TRAIN_CHARS)
    rows = in_order(sample, "text", "y")
    # Two thirds of a class make the dictionary, the rest the calibration, which so sees texts that are new to it.
    of = {y: [r["text"] for r in rows if r["y"] == y and r["text"]] for y in (0, 1)}
    if min(len(of[0]), len(of[1])) < 4:
        return CompressionClassifier(None, None, share)
    cut = {y: max(2, 2 * len(of[y]) // 3) for y in of}
    model = CompressionClassifier(_dictionary(of[1][: cut[1]]), _dictionary(of[0][: cut[0]]), share)
    rest = of[0][cut[0] :] + of[1][cut[1] :]
    model.fit(rest, np.repeat([0, 1], [len(of[0]) - cut[0], len(of[1]) - cut[1]]), share)
    return model


def score_documents(docs: DataFrame, model: CompressionClassifier, carry: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """The columns `carry`, score and predicted for each row of `docs`."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES
    keep = list(dict.fromkeys(carry))
    refuse_clashes(keep, "score", "predicted")
    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            cols = [b.column(b.schema.get_field_index(n)) for n in keep]
            score = np.concatenate([shared.value.score(text.slice(at, 256).to_pylist()) for at in range(0, len(text), 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64())], names=[*keep, "score"])

    scored = picked.mapInArrow(tidy(run), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
