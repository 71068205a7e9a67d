"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams, its edges included. The embeddings of a bag are
averaged and go through a linear softmax; embeddings and softmax are trained jointly in numpy. A
misspelt word, or a new one of a known stem, shares most n-grams with words that were seen, and so most of
their embedding. Labels are known of documents and not of words: in training a word's target is the share of
the mass that label 1 gives it, each class's words weighing the same on the whole. What the softmax
says of a document's words is averaged in two ways: how many of them are beyond what words of clean
documents get (many slight ones), and their odds to the power of `SHARP` (a single strong
one). The logarithms of both averages are calibrated on documents kept from the training.

Labels are learned from a bounded sample: at most 1.2 * `PER_CLASS` + 60 documents a class, of at most
`TRAIN_CHARS` characters each. Every text is scored whole.

Defined results: a null text, or one without a word, scores as a text of which no word says
anything; without labels of both classes (four of each) every score is the share of label 1 among
the labels that may be learned from (0.5 without any). Repeated rows score alike; equal labels of one id
count once; an empty table gives an empty result; other columns are ignored unless carried, and a
carried `score` or `predicted` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm import bytewords as bw
from typeloom.llm import subwords as sw
from typeloom.llm.common import bound_batches, in_order, labelled_sample, refuse_clashes, tidy
from typeloom.llm.compressor import fit_logistic

PER_CLASS = 1500
TRAIN_CHARS = 20_000
ORDERS = (3, 4, 5, 6, 7)
BITS = 20
DIMS = 8
EPOCHS, STEPS, RATE = 5, 32, 0.3
#: Documents of either class that a word is taken to be in besides those it is in.
DOUBT = 0.2
#: Of the words of clean documents, the share whose logits stay below the edge; and how sharply the averages tell words apart.
EDGE, SHARP = 0.9999, 4.0
#: Added to the first average before its logarithm is taken: one word in so many.
LITTLE = 1e-4
THRESHOLD = 0.7

#: White space and the marks that end words; digits and other marks stand for letters in misspellings.
SEPARATORS = bw.SPACE.copy()
SEPARATORS[list(b".,;:?\"()[]{}|<>/\\")] = True


class ToxicityModel:
    """One number per n-gram (its embedding times the softmax direction), a bias, an edge and a calibration."""

    def __init__(self, share: float):
        self.share = share
        self.pull: np.ndarray | None = None
        self.bias, self.edge = 0.0, 0.0
        self.slopes, self.shift = np.ones(2), 0.0

    def word_logits(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The softmax's log-odds of each word, and the row it is in."""
        stream, s, _, row = sw.stream(col, SEPARATORS)
        total = np.zeros(len(stream) - 8, np.float32)
        n = np.zeros(len(stream) - 8, np.int32)
        for order in ORDERS:
            b = sw.ngrams(stream, order, BITS)
            total += self.pull[b]
            n += b > 0
        return self.bias + sw.per_word(total, s) / np.maximum(1, sw.per_word(n, s)), row

    def averaged(self, logits: np.ndarray, row: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
        """For each row, the logarithms of two averages over its words (which weigh `weight`): of how far they are beyond the edge, from 0 to 1, and of their odds to a power."""
        weight = np.ones(len(row)) if weight is None else weight
        mean = lambda x: np.bincount(row, weights=x * weight, minlength=rows) / np.maximum(1, np.bincount(row, weights=weight, minlength=rows))
        beyond = 1 / (1 + np.exp(-SHARP * np.clip(logits - self.edge, -7, 7)))
        odds = np.exp(np.clip(SHARP * logits, -60, 60))
        return np.column_stack([np.log(mean(beyond) + LITTLE), np.log(mean(odds) + np.exp(SHARP * (self.edge - 7)))])

    def score(self, col: pa.Array) -> np.ndarray:
        if self.pull is None:
            return np.full(len(col), self.share)
        average = self.averaged(*self.word_logits(col), len(col))
        return 1 / (1 + np.exp(-np.clip(average @ self.slopes + self.shift, -30, 30)))


class _Bags:
    """Distinct words of the training texts, the n-grams of each, and which document holds which how often."""

    def __init__(self, texts: list[str]):
        hashes, docs, grams, sizes = [], [], [], []
        known: dict[int, int] = {}
        for at in range(0, len(texts), 400):
            stream, s, e, row = sw.stream(pa.array(texts[at : at + 400], pa.large_string()), SEPARATORS)
            h = bw.span_hashes(stream, s, e)
            hashes.append(h)
            docs.append(row + at)
            _, first = np.unique(h, return_index=True)
            fresh = [i for i in first.tolist() if int(h[i]) not in known]
            for i in fresh:
                known[int(h[i])] = len(known)
            if not fresh:
                continue
            a, b = s[fresh] - 1, e[fresh]
            length = b - a
            where = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a, length)
            owner = np.repeat(np.arange(len(fresh)), length)
            g = np.concatenate([sw.ngrams(stream, o, BITS)[where] for o in ORDERS])
            owner = np.tile(owner, len(ORDERS))
            order = np.argsort(owner, kind="stable")
            g, owner = g[order], owner[order]
            grams.append(g[g > 0])
            sizes.append(np.bincount(owner[g > 0], minlength=len(fresh)))
        self.gram = np.concatenate(grams).astype(np.int64) if grams else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.bound = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        number = np.fromiter((known[x] for x in h.tolist()), np.int64, len(h))
        pair, self.often = np.unique((np.concatenate(docs) if docs else np.zeros(0, np.int64)) * max(1, len(known)) + number, return_counts=True)
        self.doc, self.word = pair // max(1, len(known)), pair % max(1, len(known))

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of the given words one after another, the row of each, and how many each word has."""
        size = self.bound[words + 1] - self.bound[words]
        row = np.repeat(np.arange(len(words)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bound[words], size)
        return self.gram[at], row, size


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = 5) -> ToxicityModel:
    """Learn from texts with labels 0 and 1; every fifth text calibrates. `share`: of label 1 among all labels."""
    model = ToxicityModel(share)
    rng = np.random.default_rng(seed)
    bags = _Bags(texts)
    if not len(bags.gram):
        return model
    n_words = len(bags.bound) - 1
    kept = np.arange(len(y)) % 5 == 0
    distinct = np.bincount(bags.doc, minlength=len(y))

    # The mass of a word in a class: its documents, each weighing less the more words it has.
    mass, typical = np.zeros((2, n_words)), np.zeros((2, 1))
    for c in (0, 1):
        mine = ~kept[bags.doc] & (y[bags.doc] == c)
        each = distinct[bags.doc[mine]] ** -0.5
        mass[c] = np.bincount(bags.word[mine], weights=each, minlength=n_words) / max(each.sum(), 1e-9)
        typical[c] = 1 / max(len(each), 1)
    words = np.flatnonzero((mass.sum(0) > 0) & (np.diff(bags.bound) > 0))
    # A word of few documents says little: as if so many more of either class had held it.
    doubt = DOUBT * typical.max()
    target = (mass[1] + doubt) / (mass.sum(0) + 2 * doubt)
    weight = np.minimum(mass.sum(0) / max(mass.sum(0)[words].mean(), 1e-30), 50) if len(words) else mass.sum(0)

    emb = rng.normal(0, 1e-3, (1 << BITS, DIMS)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out = np.full((1 << BITS, DIMS), 1e-3, np.float32), np.full((DIMS, 2), 1e-6, np.float32)
    sums = lambda at, x, n: np.column_stack([np.bincount(at, weights=x[:, j], minlength=n) for j in range(DIMS)]).astype(np.float32)
    for _ in range(EPOCHS):
        order = words[rng.permutation(len(words))]
        for pick in filter(len, np.array_split(order, STEPS)):
            g, row, size = bags.take(pick)
            bag = sums(row, emb[g], len(pick)) / size[:, None]
            z = bag @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= np.column_stack([1 - target[pick], target[pick]])
            p *= weight[pick, None]
            d_out, d_bag = bag.T @ p, (p @ out.T) / size[:, None]
            g_out += d_out**2
            out -= 0.1 * d_out / np.sqrt(g_out)
            bias -= 0.02 * p.mean(0)
            u, inv = np.unique(g, return_inverse=True)
            step = sums(inv, d_bag[row], len(u))
            g_emb[u] += step**2
            emb[u] -= RATE * step / np.sqrt(g_emb[u])

    pull = emb @ (out[:, 1] - out[:, 0])
    pull[0] = 0
    model.pull, model.bias = pull.astype(np.float32), float(bias[1] - bias[0])
    held = np.flatnonzero(np.diff(bags.bound))
    logit = np.full(n_words, model.bias)
    logit[held] += np.add.reduceat(pull[bags.gram], bags.bound[held]) / np.diff(bags.bound)[held]
    clean = ~kept[bags.doc] & (y[bags.doc] == 0)
    order = np.argsort(logit[bags.word[clean]], kind="stable")
    below = np.cumsum(bags.often[clean][order])
    if len(below):
        model.edge = float(logit[bags.word[clean]][order][min(len(below) - 1, np.searchsorted(below, EDGE * below[-1]))])

    average = model.averaged(logit[bags.word], bags.doc, len(y), bags.often.astype(float))
    use = kept if len(set(y[kept].tolist())) > 1 else np.ones(len(y), bool)
    # Classes weigh as the square roots of their shares: a rare class isn't shut out, nor common words let in.
    part = share**0.5 / (share**0.5 + (1 - share) ** 0.5)
    each = np.where(y[use] == 1, part / max(y[use].mean(), 1e-9), (1 - part) / max(1 - y[use].mean(), 1e-9))
    # A text with more toxic words never scores lower: an average that would count against it is left out.
    columns = [0, 1]
    while True:
        mean, scale, w = fit_logistic(average[use][:, columns], y[use], each, ridge=1e-3)
        if w[1:].min() >= 0 or len(columns) == 1:
            break
        columns = [columns[int(w[1:].argmax())]]
    model.slopes = np.zeros(2)
    model.slopes[columns] = np.maximum(0, w[1:] / scale)
    model.shift = float(w[0] - model.slopes[columns] @ mean)
    return model


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    sample, share = labelled_sample(docs, labels, column, PER_CLASS, TRAIN_CHARS)
    rows = in_order(sample, "text", "y")
    y = np.array([r["y"] for r in rows], np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return ToxicityModel(share)
    return fit([r["text"] for r in rows], y, share)


def score_documents(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, score and predicted (1 from `threshold` on) of each row's text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB: one number per n-gram bucket
    refuse_clashes(carry, "score", "predicted")
    schema = docs.select(*carry).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bw.ranges(whole, budget=2 << 20):
                score = shared.value.score(b.column(b.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carry), pa.array(score, pa.float64())], names=[*carry, "score"])

    scored = docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
