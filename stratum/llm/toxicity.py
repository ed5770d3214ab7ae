"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first: a word of a toxic training
document counts as toxic where its document frequency is far higher in toxic
than in clean training documents (log odds of `MIN_ODDS`); all other words are
clean.  On these labelled words a two-state chain is trained: weights for a
word, the word before it and the word after it, weights of state pairs and of
the first state, by gradients of the log likelihood from forward-backward
passes (node and pair marginals).  A document is cut to chains of `CHAIN`
words; the neighbours that weigh on a word are read across the cuts.  Marginals
of all its words (their sum, largest and mean) give the document's score
through a logistic fit on training documents that the chain has not seen; words
with a marginal of 0.5 or more are the offending offsets.

For two states one number per word suffices each way, the ratio of the states'
messages, so whole slabs are passed over at once.

Training takes about `TRAIN_DOCS` labelled documents of at most `TRAIN_CHARS`
characters, those whose ids hash under a bound that follows from the number of
labels, outside the held-out fold; near copies among them count once.  Scoring
reads every word of every text.  Inputs of a score are the text's words alone.
Null and empty texts have no words and get the base score; without labels of
both kinds every score is 0.  Rows with a null id are scored; an id that the
labels repeat counts as toxic if any of its labels says so.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import mapped, sampled

#: Labelled documents that training takes, about, and their length in code points at most.
TRAIN_DOCS = 4000
TRAIN_CHARS = 40_000
#: Words in one chain.
CHAIN = 64
#: A toxic word: in so many toxic documents at least, and so much likelier there (log).
MIN_DOCS = 4
MIN_ODDS = 2.5
EPOCHS = 30
#: Words that one pass of training takes at a time.
TRAIN_WORDS = 1 << 16

SCHEMA = "doc_id bigint, score double, predicted int, spans array<struct<byte_start:bigint,byte_end:bigint,marginal:double>>"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the word itself, the one before and the one after: by word number, 0 for others and the last for none
    pairs: np.ndarray  # 2 x 2 log weights of (state, next state)
    start: float
    calibration: np.ndarray

    def odds(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of words from their own and their neighbours' weights."""
        return unaries(self.weights, neighbours(self.numbers(h), first, self.weights.shape[1] - 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """1 and up for words that training has met, else 0."""
        if not len(self.words):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0).astype(np.int32)


def neighbours(number: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """The numbers of each word, the one before and the one after it in its row."""
    out = np.full((3, len(number)), none, np.int32)
    out[0], out[1, 1:], out[2, :-1] = number, number[:-1], number[1:]
    inner = first[(first > 0) & (first < len(number))]
    out[1, first[first < len(number)]] = none
    out[2, inner - 1] = none
    return out


def unaries(weights: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return weights[0][numbers[0]] + weights[1][numbers[1]] + weights[2][numbers[2]]


def _chains(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Column and step of each of n words, and how many columns: a row's words fill columns of CHAIN steps."""
    count = np.diff(first)
    columns = -(-count // CHAIN)
    base = np.cumsum(columns) - columns
    within = np.arange(n) - np.repeat(first[:-1], count)
    return np.repeat(base, count) + within // CHAIN, within % CHAIN, int(columns.sum())


@dataclass
class Messages:
    """What forward and backward passes leave, by step and chain: odds of the toxic state."""

    used: np.ndarray  # whether a chain has the step
    own: np.ndarray  # the words' own odds
    ahead: np.ndarray  # from the chain's beginning up to the word, itself included
    back: np.ndarray  # from its end down to the word, itself left out

    def nodes(self) -> np.ndarray:
        odds = self.ahead * self.back
        return odds / (1 + odds)

    def pairs(self, a: np.ndarray) -> np.ndarray:
        """Expected numbers of each (state, next state)."""
        before, after = self.ahead[:-1], (self.own * self.back)[1:]
        joint = np.stack([np.full_like(before, a[0, 0]), a[0, 1] * after, a[1, 0] * before, a[1, 1] * before * after])
        return ((joint / joint.sum(axis=0)) * self.used[1:]).sum(axis=(1, 2)).reshape(2, 2)


def messages(unary: np.ndarray, first: np.ndarray, pairs: np.ndarray, start: float) -> tuple[Messages, np.ndarray, np.ndarray]:
    """The passes over all chains, and each word's step and chain; unary are the words' log odds."""
    n = len(unary)
    col, step, width = _chains(first, n)
    length = min(CHAIN, int(np.diff(first).max()))
    e, used = np.ones((length, width)), np.zeros((length, width), bool)
    e[step, col], used[step, col] = np.exp(np.clip(unary, -30, 30)), True
    a = np.exp(pairs)
    ahead, back = np.empty_like(e), np.empty_like(e)
    ahead[0] = e[0] * np.exp(start)
    for t in range(1, length):
        ahead[t] = e[t] * (a[0, 1] + a[1, 1] * ahead[t - 1]) / (a[0, 0] + a[1, 0] * ahead[t - 1])
    # behind a chain's end nothing weighs on it
    back[-1] = 1.0
    for t in range(length - 2, -1, -1):
        m = e[t + 1] * back[t + 1]
        back[t] = np.where(used[t + 1], (a[1, 0] + a[1, 1] * m) / (a[0, 0] + a[0, 1] * m), 1.0)
    return Messages(used, e, ahead, back), step, col


def marginals(unary: np.ndarray, first: np.ndarray, pairs: np.ndarray, start: float) -> np.ndarray:
    """Probability of the toxic state for each word."""
    if not len(unary):
        return np.zeros(0)
    got, step, col = messages(unary, first, pairs, start)
    return got.nodes()[step, col]


def log_likelihood(unary: np.ndarray, first: np.ndarray, y: np.ndarray, pairs: np.ndarray, start: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Log likelihood of states y, and its gradients by the unaries, the pairs and the start."""
    got, step, col = messages(unary, first, pairs, start)
    a = np.exp(pairs)
    # what normalises a chain: the clean state's forward messages, then both states at its end
    ends = np.append(step[1:] == 0, True)
    log_z = np.log1p(got.ahead[step[ends], col[ends]]).sum() + np.log(a[0, 0] + a[1, 0] * got.ahead[:-1])[got.used[1:]].sum()
    follow = np.flatnonzero(step > 0)
    seen = np.bincount(2 * y[follow - 1].astype(np.int64) + y[follow], minlength=4).reshape(2, 2)
    begins = step == 0
    score = (unary * y).sum() + (pairs * seen).sum() + start * y[begins].sum()
    p = got.nodes()[step, col]
    return float(score - log_z), y - p, seen - got.pairs(a), float((y - p)[begins].sum())


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: 1, log of expected toxic words, the largest marginal, their share."""
    rows = len(first) - 1
    out = np.zeros((rows, 4))
    out[:, 0] = 1
    count = np.diff(first)
    some = np.flatnonzero(count)
    if len(some):
        total = np.add.reduceat(p, first[some])
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.maximum.reduceat(p, first[some])
        out[some, 3] = np.minimum(1, 20 * total / count[some])
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's first."""
    hashes, firsts, n = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offs in tx.slabs(pa.array(texts, pa.string())):
        low = tx.LOWER[data]
        starts, ends, first = tx.word_spans(low, offs, tx.ALNUM)
        hashes.append(tx.word_hashes(low, starts, ends))
        firsts.append(first[1:] + n)
        n += len(starts)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(firsts)


def _fit_chain(h: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> Model:
    row = tx.row_of(first, len(h))
    words, number = np.unique(h, return_inverse=True)
    seen = np.unique(row * len(words) + number)
    bad = toxic[seen // len(words)]
    a = np.bincount(seen[bad] % len(words), minlength=len(words))
    b = np.bincount(seen[~bad] % len(words), minlength=len(words))
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    marked = (a >= MIN_DOCS) & (odds >= MIN_ODDS)
    y = marked[number] & toxic[row]
    # weights for words in several documents; the others share one
    known = (a + b >= 3) | marked
    own = np.where(known, np.cumsum(known), 0)[number].astype(np.int32)
    size = int(known.sum()) + 2
    around = neighbours(own, first, size - 1)
    del own, number, seen, h
    y = y.astype(np.int8)
    # runs of whole documents
    edges = [0]
    while edges[-1] < len(first) - 1:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(first, first[edges[-1]] + TRAIN_WORDS, "right")) - 1))
    runs = [(first[i : j + 1] - first[i], slice(first[i], first[j])) for i, j in zip(edges[:-1], edges[1:], strict=True) if first[j] > first[i]]
    w, pairs, start = np.zeros((3, size)), np.zeros((2, 2)), -2.0
    w[0, 0] = -2.0
    # a weight's step is taken over the root of how often it is met
    scale = np.stack([1 / np.sqrt(np.bincount(k, minlength=size) + 1) for k in around]).ravel()
    words_seen, chains = max(len(y), 1), max(int((-(-np.diff(first) // CHAIN)).sum()), 1)
    moment, speed = np.zeros(3 * size + 5), np.zeros(3 * size + 5)
    for k in range(1, EPOCHS + 1):
        g, gp, gs = -0.05 * w, np.zeros((2, 2)), 0.0
        for own, at in runs:
            _, u, p, s = log_likelihood(unaries(w, around[:, at]), own, y[at], pairs, start)
            for j in range(3):
                g[j] += np.bincount(around[j, at], weights=u, minlength=size)
            gp, gs = gp + p, gs + s
        g = np.concatenate([g.ravel() * scale, gp.ravel() / words_seen * 100 - 0.05 * pairs.ravel(), [gs / chains]])
        moment = 0.9 * moment + 0.1 * g
        speed = 0.99 * speed + 0.01 * g * g
        move = 0.3 * (moment / (1 - 0.9**k)) / (np.sqrt(speed / (1 - 0.99**k)) + 1e-6)
        w += move[: 3 * size].reshape(3, size)
        pairs += 0.2 * move[3 * size : -1].reshape(2, 2)
        start += 0.2 * float(move[-1])
    return Model(words[known], w.astype(np.float32), pairs, start, np.zeros(4))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * beta)
    return beta


def fit(texts: list[str], toxic: list[bool]) -> Model | None:
    """A model, or none without both kinds.  Of near copies (equal least shingle) the first counts."""
    least, keep = set(), []
    k = 0
    for _, _, data, offs in tx.slabs(pa.array(texts, pa.string())):
        for s in tx.shingle_sets(data, offs, 5):
            mark = (int(s[0]) if len(s) else 0, toxic[k])
            if mark not in least:
                least.add(mark)
                keep.append(k)
            k += 1
    y = np.array([toxic[i] for i in keep], bool)
    if not y.any() or y.all():
        return None
    fresh = np.arange(len(keep)) % 4 == 3
    own = [texts[i] for i in keep]
    model = _fit_chain(*_words([t for t, f in zip(own, fresh, strict=True) if not f]), y[~fresh])
    h, first = _words([t for t, f in zip(own, fresh, strict=True) if f])
    x = document_features(marginals(model.odds(h, first), first, model.pairs, model.start), first)
    model.calibration = _fit_logistic(x, y[fresh].astype(float))
    calibration = model.calibration
    # the chain is fitted again on all of them; the logistic fit stays
    model = _fit_chain(*_words(own), y)
    model.calibration = calibration
    return model


def train(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Model | None:
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, train_docs / max(known.count(), 1))
    sample = known.where(sampled(F.xxhash64("doc_id"), share))
    # of an id that documents repeat one text counts
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= TRAIN_CHARS)
    got = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    @tx.released
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows], [y == 1 for _, _, y in rows]))], pa.binary())], ["model"])

    # trained in one task, away from the driver; the sample does not grow with the table
    row = mapped(got.select("doc_id", "text", "toxic").coalesce(1), learn, "model binary").first()
    return pickle.loads(row[0]) if row else None


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document (`SCHEMA`): score, prediction and the offending words' bytes."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(own, labels, train_docs=train_docs))  # bounded by the training sample

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        span = pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64()), ("marginal", pa.float64())])
        for b in batches:
            for lo, hi, data, offs in tx.slabs(b.column(1)):
                scores, spans = score_slab(data, offs, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(span))], ["doc_id", "score", "predicted", "spans"])

    return mapped(own, run, SCHEMA)


def score_slab(data: np.ndarray, offs: np.ndarray, model: Model | None) -> tuple[np.ndarray, list[list[dict]]]:
    rows = len(offs) - 1
    spans: list[list[dict]] = [[] for _ in range(rows)]
    if model is None:
        return np.zeros(rows), spans
    low = tx.LOWER[data]
    starts, ends, first = tx.word_spans(low, offs, tx.ALNUM)
    p = marginals(model.odds(tx.word_hashes(low, starts, ends), first), first, model.pairs, model.start)
    scores = 1 / (1 + np.exp(-np.clip(document_features(p, first) @ model.calibration, -30, 30)))
    hot = np.flatnonzero(p >= 0.5)
    for g, r in zip(hot.tolist(), (np.searchsorted(first, hot, "right") - 1).tolist(), strict=True):
        spans[r].append({"byte_start": int(starts[g] - offs[r]), "byte_end": int(ends[g] - offs[r]), "marginal": float(p[g])})
    return scores, spans


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5; each row is judged by its text where it stands."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score_slab(data, offs, sent.value)[0] for _, _, data, offs in tx.slabs(b.column(at))]
            if scores:
                yield b.filter(pa.array(np.concatenate(scores) < 0.5))

    return mapped(docs, run, docs.schema)
