"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language by forward-backward over a chain. A word's
emission has affix and character n-gram features (hashed; a word's edge is a character) and a
lexicon feature (a word seen often in training has weights of its own); transitions between the
languages of neighbouring words are learned with them, by the gradient of the chain likelihood,
so that code-switched text is labelled word by word. A chain is a line, however long: messages
cross a long line in blocks of `BLOCK` words, whose transfer matrices are multiplied out first, which
changes nothing but the time. A text's language is the one of the highest mean probability over its
words; that mean is its score.

Training takes a bounded sample: about `PER_LANG` documents a language, of at most
`TRAIN_CHARS` characters each. Of its words `TRAIN_WORDS`, drawn evenly, fit the emissions, and
lines of about twice as many an epoch make the chains, half of them in runs of one language drawn
evenly over the languages; for training, lines are cut after `TRAIN_LINE` words. The `LEXICON` words that
the sample holds most often, three times at least, have weights of their own. A document's language labels its lines at first; a first fit of
the emissions then moves lines that are plainly in another language, and training chains join
lines of several languages. Every text is labelled whole.

Defined results: a text that is null or holds no letter is ``und`` with score 0, and so is every
text if no language was learned. Repeated rows are labelled alike; an empty table gives an empty
result; other columns are ignored unless carried, and a carried `lang_pred` or `score` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm import bytewords as bw
from typeloom.llm import subwords as sw
from typeloom.llm.common import bound_batches, bounded_sample, fold_of, refuse_clashes, tidy

PER_LANG = 300
TRAIN_CHARS = 20_000
#: Words of the sample that fit the emissions; chains take about twice as many an epoch.
TRAIN_WORDS = 120_000
#: (order, bits) of the n-gram tables; a table's buckets follow the one before.
TABLES = ((2, 16), (3, 17))
LEXICON = 20_000
#: Words of a block of a long line, and of a line that training draws.
BLOCK, TRAIN_LINE = 128, 32
EPOCHS = 2
UNKNOWN = "und"

#: Every ASCII byte that isn't a letter separates words.
SEPARATORS = np.ones(256, bool)
SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False
_SIZE = sum(1 << b for _, b in TABLES)


def chains_of(data: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray, most: int | None = None) -> np.ndarray:
    """First word of each chain: of each line, or of each `most` words of it."""
    if not len(s):
        return np.zeros(0, np.int64)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (lines[s[1:]] > lines[e[:-1]])
    begin = np.flatnonzero(new)
    return begin if most is None else cut_chains(begin, len(s), most)


def cut_chains(begin: np.ndarray, n: int, most: int) -> np.ndarray:
    """First word of each piece of at most `most` words of chains that begin at `begin`."""
    place = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
    return np.flatnonzero(place % most == 0)


def forward_backward(emission: np.ndarray, begin: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Word marginals, summed transition marginals and log-likelihood normaliser of chains laid end to end.

    All chains step together, the longest first, so a step works on those that are still going.
    """
    n, k = emission.shape
    size = np.diff(begin, append=n)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size.max(initial=0))
    going = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    top = emission.max(1, keepdims=True)
    em = np.exp(emission - top)
    a = np.exp(transition)
    alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty(n)
    state = np.exp(start)[None, :].repeat(len(begin), 0)
    for t in range(steps):
        at = begin[: going[t]] + t
        state = (state[: going[t]] @ a if t else state) * em[at]
        total = state.sum(1)
        state = state / total[:, None]
        alpha[at], scale[at] = state, total
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        at = begin[: going[t + 1]] + t
        ahead = em[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        pairs += alpha[at].T @ ahead * a
        beta[at] = ahead @ a.T
    marginal = alpha * beta
    return marginal / marginal.sum(1, keepdims=True), pairs, float(np.log(scale).sum() + top.sum())


def _normal(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / x.sum(axis, keepdims=True)


def marginals(emission: np.ndarray, begin: np.ndarray, transition: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Word marginals of chains laid end to end, as `forward_backward` gives them, in time that depends little on the longest.

    Chains are cut into blocks. What enters a block from either side comes from the products of
    the blocks' transfer matrices along their chain; then all blocks step together.
    """
    n, k = emission.shape
    em, a = np.exp(emission - emission.max(1, keepdims=True)), np.exp(transition)
    cut = cut_chains(begin, n, block)
    size = np.diff(cut, append=n)
    chain = np.searchsorted(begin, cut, "right") - 1
    place = np.arange(len(cut)) - np.searchsorted(chain, chain)
    enter = np.tile(np.exp(start), (len(cut), 1))
    leave = np.ones((len(cut), k))

    long = np.flatnonzero(np.bincount(chain, minlength=len(begin))[chain] > 1)
    if len(long):
        move = np.where(place[long, None, None] == 0, np.eye(k), a) * em[cut[long]][:, None, :]
        for t in range(1, block):
            on = np.flatnonzero(size[long] > t)
            move[on] = _normal(move[on] @ a * em[cut[long[on]] + t][:, None, :], (1, 2))
        of = np.full(len(cut), -1)
        of[long] = np.arange(len(long))
        for j in range(1, int(place.max()) + 1):
            at = long[place[long] == j]
            enter[at] = _normal(np.einsum("bi,bij->bj", enter[at - 1], move[of[at - 1]]))
        for j in range(int(place.max()), 0, -1):
            at = long[place[long] == j]
            leave[at - 1] = _normal(np.einsum("bij,bj->bi", move[of[at]], leave[at]))

    order = np.argsort(-size, kind="stable")
    cut, size, enter, leave, first = cut[order], size[order], enter[order], leave[order], place[order] == 0
    steps = int(size.max(initial=0))
    going = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    alpha, beta = np.empty_like(em), np.empty_like(em)
    state = np.where(first[:, None], enter, enter @ a)
    for t in range(steps):
        at = cut[: going[t]] + t
        state = _normal((state[: going[t]] @ a if t else state) * em[at])
        alpha[at] = state
    beta[cut + size - 1] = leave
    for t in range(steps - 2, -1, -1):
        at = cut[: going[t + 1]] + t
        beta[at] = _normal((em[at + 1] * beta[at + 1]) @ a.T)
    return _normal(alpha * beta)


class LanguageModel:
    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.gram = np.zeros((_SIZE, k), np.float32)
        self.lexicon = np.zeros(0, np.uint64)
        self.word = np.zeros((1, k), np.float32)  # row 0: not in the lexicon
        self.transition, self.start = np.zeros((k, k)), np.zeros(k)

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at + 1, 0)

    def emissions(self, stream: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        total = np.zeros((len(stream) - 8, len(self.labels)), np.float32)
        n = np.zeros(len(stream) - 8, np.int32)
        base = 0
        for order, bits in TABLES:
            b = sw.ngrams(stream, order, bits)
            total += self.gram[b + np.where(b > 0, base, 0)]
            n += b > 0
            base += 1 << bits
        mean = sw.per_word(total, s) / np.maximum(1, sw.per_word(n, s))[:, None]
        return mean + self.word[self.find(bw.span_hashes(stream, s, e))]

    def label(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        stream, s, e, row, data = sw.stream_and_bytes(col, SEPARATORS)
        rows, k = len(col), len(self.labels)
        latin = np.zeros(rows, bool)
        latin[row[data[s] < 128]] = True
        latin |= np.isin(np.arange(rows), row[(data[e - 1] < 128)])
        lettered = latin.copy()
        for i in np.flatnonzero(~latin).tolist():
            lettered[i] = any(ch.isalpha() for ch in col[i].as_py() or "")
        out, score = np.full(rows, -1), np.zeros(rows)
        if k and len(s):
            marginal = marginals(self.emissions(stream, s, e).astype(np.float64), chains_of(data, s, e, row), self.transition, self.start)
            words = np.bincount(row, minlength=rows)
            share = np.column_stack([np.bincount(row, weights=marginal[:, j], minlength=rows) for j in range(k)]) / np.maximum(1, words)[:, None]
            seen = (words > 0) & lettered
            out[seen], score[seen] = share[seen].argmax(1), share[seen].max(1)
        return [self.labels[i] if i >= 0 else UNKNOWN for i in out.tolist()], np.clip(score, 0, 1)


class _Words:
    """Training words: n-gram buckets of the distinct ones, and the lines that the texts are made of."""

    def __init__(self, texts: list[str]):
        stream, s, e, row, data = sw.stream_and_bytes(pa.array(texts, pa.large_string()), SEPARATORS)
        self.hash, first, self.type = np.unique(bw.span_hashes(stream, s, e), return_index=True, return_inverse=True)
        self.row = row
        self.begin = chains_of(data, s, e, row, TRAIN_LINE)
        a, b = s[first] - 1, e[first]
        length = b - a
        where = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a, length)
        owner = np.repeat(np.arange(len(first)), length)
        grams, owners, base = [], [], 0
        for order, bits in TABLES:
            g = sw.ngrams(stream, order, bits)[where]
            grams.append(g[g > 0].astype(np.int64) + base)
            owners.append(owner[g > 0])
            base += 1 << bits
        order_ = np.argsort(np.concatenate(owners), kind="stable")
        self.gram = np.concatenate(grams)[order_]
        self.bound = bw.counts_to_bounds(np.concatenate(owners)[order_], len(first))

    def take(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.bound[types + 1] - self.bound[types]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bound[types], size)
        return self.gram[at], np.repeat(np.arange(len(types)), size), size


def fit(texts: list[str], langs: list[str], seed: int = 3) -> LanguageModel:
    labels = sorted(set(langs))
    model = LanguageModel(labels)
    k, rng = len(labels), np.random.default_rng(seed)
    w = _Words(texts)
    if not k or not len(w.type):
        return LanguageModel([]) if not k else model
    y = np.array([labels.index(x) for x in langs])[w.row]

    often = np.bincount(w.type)
    common = np.flatnonzero(often >= 3)
    common = common[np.argsort(-often[common], kind="stable")][:LEXICON]
    model.lexicon = np.sort(w.hash[common])
    model.word = np.zeros((len(common) + 1, k), np.float32)
    lex = model.find(w.hash)
    g_gram, g_word = np.full_like(model.gram, 1e-6), np.full_like(model.word, 1e-6)
    g_tran, g_start = np.full((k, k), 1e-6), np.full(k, 1e-6)

    def score(types: np.ndarray) -> tuple[np.ndarray, tuple]:
        g, owner, size = w.take(types)
        bag = np.column_stack([np.bincount(owner, weights=model.gram[g, j], minlength=len(types)) for j in range(k)])
        return bag / np.maximum(1, size)[:, None] + model.word[lex[types]], (g, owner, size)

    def descend(types: np.ndarray, grad: np.ndarray, taken: tuple) -> None:
        g, owner, size = taken
        each = (grad / np.maximum(1, size)[:, None])[owner]
        u, inv = np.unique(g, return_inverse=True)
        step = np.column_stack([np.bincount(inv, weights=each[:, j], minlength=len(u)) for j in range(k)]).astype(np.float32)
        g_gram[u] += step**2
        model.gram[u] -= 0.3 * step / np.sqrt(g_gram[u])
        u, inv = np.unique(lex[types], return_inverse=True)
        step = np.column_stack([np.bincount(inv, weights=grad[:, j], minlength=len(u)) for j in range(k)]).astype(np.float32)
        step[u == 0] = 0
        g_word[u] += step**2
        model.word[u] -= 0.2 * step / np.sqrt(g_word[u])

    # Emissions alone, words labelled by their document.
    order = rng.permutation(len(w.type))[:TRAIN_WORDS]
    for at in range(0, len(order), 4096):
        pick = order[at : at + 4096]
        z, taken = score(w.type[pick])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        descend(w.type[pick], p, taken)

    # A line that is plainly in another language gets that label.
    z, _ = score(np.arange(len(w.hash)))
    z = z[w.type]
    z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
    line = np.add.reduceat(z, w.begin)
    size = np.diff(w.begin, append=len(w.type))
    own = y[w.begin]
    best = line.argmax(1)
    moved = line[np.arange(len(line)), best] - line[np.arange(len(line)), own] > 6.0
    of_line = np.where(moved, best, own)

    # Chains of one to four lines; every other one mixes languages as the lines come.
    for _ in range(EPOCHS):
        lines = chain_lines(of_line, size, 2 * TRAIN_WORDS, rng)
        cut = np.concatenate([[0], np.cumsum(rng.integers(1, 5, len(lines)))])
        cut = cut[cut < len(lines)]
        groups = [lines[a:b] for a, b in zip(cut, [*cut[1:], len(lines)], strict=True)]
        groups = [groups[i] for i in rng.permutation(len(groups)).tolist()]
        for at in range(0, len(groups), 64):
            batch = groups[at : at + 64]
            flat = np.concatenate(batch)
            words = np.concatenate([np.arange(w.begin[i], w.begin[i] + size[i]) for i in flat.tolist()])
            target = np.repeat(of_line[flat], size[flat])
            length = np.array([size[b].sum() for b in batch])
            begin = np.cumsum(length) - length
            types = w.type[words]
            z, taken = score(types)
            marginal, pairs, _ = forward_backward(z, begin, model.transition, model.start)
            grad = marginal.copy()
            grad[np.arange(len(words)), target] -= 1
            inner = np.ones(len(words), bool)
            inner[begin] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (target[:-1][inner[1:]], target[1:][inner[1:]]), 1)
            d_tran = pairs - seen
            d_start = marginal[begin].sum(0) - np.bincount(target[begin], minlength=k)
            descend(types, grad, taken)
            g_tran += d_tran**2
            model.transition -= 0.2 * d_tran / np.sqrt(g_tran)
            g_start += d_start**2
            model.start -= 0.1 * d_start / np.sqrt(g_start)
    model.gram[0] = 0
    return model


def chain_lines(of_line: np.ndarray, size: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Lines of about `words` words at most: half as they come, half in runs of one language, shuffled before the cut."""
    drawn = rng.permutation(len(of_line))
    half = len(drawn) // 2
    mixed, rest = drawn[:half], drawn[half:]
    of_one = [rest[of_line[rest] == k] for k in np.unique(of_line[rest])]
    runs = [run for x in of_one for run in np.split(x, range(4, len(x), 4))]
    plain = np.concatenate([runs[i] for i in rng.permutation(len(runs)).tolist()]) if runs else rest

    def upto(lines: np.ndarray, most: int) -> np.ndarray:
        return lines[: np.searchsorted(np.cumsum(size[lines]), most) + 1]

    return np.concatenate([upto(mixed, words // 2), upto(plain, words // 2)])


def train(docs: DataFrame) -> LanguageModel:
    """Learn from documents with a language whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", 4) != 2) & (F.length("text") <= TRAIN_CHARS))
    chosen = bounded_sample(known.select("doc_id", "lang", "text"), PER_LANG, "lang", "doc_id", F.xxhash64("text"))
    rows = sorted(chosen.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else LanguageModel([])


def label_documents(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score of each row's text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded tables: n-gram buckets and a lexicon, by language
    refuse_clashes(carry, "lang_pred", "score")
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bw.ranges(whole, budget=1 << 20):
                pred, score = shared.value.label(b.column(b.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carry), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), schema)
