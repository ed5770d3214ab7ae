r"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from fixed patterns (with their checks).  The network is trained
in numpy on windows of a bounded sample, labelled by base spans and by typical
written forms that the patterns miss (`SYNTHETIC`).  Windows are laid,
overlapping, over the whole of every text.  Each is decoded by Viterbi; where
windows overlap, each character takes its tag from the window in which it lies
furthest from an edge, and spans are read from the joined tags of the whole
text.  Spans that touch no base span are added.

A span that is read holds a digit, an @ or an "(at)" (`TRIGGER`).  So windows
that give no such character its tag are decoded only where a span reaches into
them; the spans are those that decoding every window gives.

Null and empty texts have no spans.  Without labelled spans in the sample the
synthetic ones remain.  Training is seeded: equal inputs give equal models.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import mapped, sampled

# The base patterns, kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Documents (about) and windows (at most) that training takes, and its batches.
TRAIN_DOCS, TRAIN_WINDOWS, BATCHES, BATCH = 2000, 2000, 320, 64
EMBED, HIDDEN = 8, 16
#: What every span that `_read` accepts holds.
TRIGGER = re.compile(r"[0-9@]|\([Aa][Tt]\)")
#: 0: outside; 1 + 2k: the first character of kind k; 2 + 2k: a later one.
TAGS = 1 + 2 * len(KINDS)

SCHEMA = "doc_id bigint, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"

# digits are one class, as are lower-case, upper-case and non-ASCII letters; other ASCII stands for itself
_CLASS = np.zeros(129, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128] = 1, 2, 3, 4
_rest = [c for c in range(128) if not _CLASS[c] and c != 0]
_CLASS[_rest] = 5 + np.arange(len(_rest))
CLASSES = 5 + len(_rest)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; places in code points."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches; a match begins in the run of local-part characters that ends at an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and (text[s - 1].isascii() and text[s - 1].isalnum() or text[s - 1] in "._%+-"):
            s -= 1
        m = EMAIL.match(text, s) if s < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def encode(text: str) -> np.ndarray:
    """Classes of the code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of a text, and the classes of its characters."""
    x = encode(text)
    return np.arange(0, max(1, len(x) - (WINDOW - STRIDE)) if len(x) else 0, STRIDE), x


def owner(at: np.ndarray, n: int) -> np.ndarray:
    """Of n windows the one in which a character lies furthest from an edge; ends of the text count as no edges."""
    return np.clip((at - (WINDOW - STRIDE) // 2) // STRIDE, 0, n - 1)


def cut_windows(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(x), x[np.minimum(at, max(len(x) - 1, 0))], x.dtype.type(0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


class Tagger:
    """Embedding, an LSTM each way, emissions, CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"E": f(CLASSES, EMBED), "Wo": f(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p[f"Wx{d}"], self.p[f"Wh{d}"] = f(EMBED, 4 * HIDDEN), f(HIDDEN, 4 * HIDDEN)
            self.p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states in text order; x is steps x windows x EMBED."""
        steps, n, _ = x.shape
        z0 = x @ self.p[f"Wx{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, memo = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z0[t] + h @ self.p[f"Wh{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                memo.append((t, i, f, o, g, tc, *before))
        return out, memo

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """steps x windows x TAGS, for windows x steps classes."""
        e = self.p["E"][x.T]
        hf, mf = self._lstm(e, "f", keep)
        hb, mb = self._lstm(e, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["Wo"] + self.p["bo"], (e, h, mf, mb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y and its gradients."""
        em, (e, h, mf, mb) = self.emissions(x, keep=True)
        steps, n, _ = em.shape
        yt = y.T
        trans, start = self.p["T"].astype(np.float64), self.p["S"].astype(np.float64)
        em64 = em.astype(np.float64)
        expt = np.exp(trans)
        a, scale = np.empty((steps, n, TAGS)), np.empty((steps, n, 1))
        for t in range(steps):
            v = np.exp(em64[t]) * (np.exp(start) if t == 0 else a[t - 1] @ expt)
            scale[t] = v.sum(axis=1, keepdims=True)
            a[t] = v / scale[t]
        b = np.ones((steps, n, TAGS))
        for t in range(steps - 2, -1, -1):
            b[t] = (np.exp(em64[t + 1]) * b[t + 1]) @ expt.T / scale[t + 1]
        post = a * b
        post /= post.sum(axis=2, keepdims=True)
        rows = np.arange(n)
        gold = sum(em64[t][rows, yt[t]].sum() + (start[yt[0]].sum() if t == 0 else trans[yt[t - 1], yt[t]].sum()) for t in range(steps))
        loss = (np.log(scale).sum() - gold) / n
        de = post.copy()
        de[np.arange(steps)[:, None], rows, yt] -= 1
        de = (de / n).astype(np.float32)
        g = {"S": de[0].sum(axis=0)}
        expected = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            expected += a[t - 1].T @ (np.exp(em64[t]) * b[t] / scale[t]) * expt
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (yt[:-1], yt[1:]), 1)
        g["T"] = ((expected - seen) / n).astype(np.float32)
        g["Wo"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        g["bo"] = de.sum(axis=(0, 1))
        dh = de @ self.p["Wo"].T
        dx = np.zeros_like(e)
        for d, memo, part in (("f", mf, dh[:, :, :HIDDEN]), ("b", mb, dh[:, :, HIDDEN:])):
            wh = self.p[f"Wh{d}"]
            dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
            next_h, next_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            gwh = np.zeros_like(wh)
            for t, i, f, o, gg, tc, h0, c0 in reversed(memo):
                cur = part[t] + next_h
                dc = cur * o * (1 - tc * tc) + next_c
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), cur * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                next_h, next_c = dz @ wh.T, dc * f
                gwh += h0.T @ dz
                dz_all[t] = dz
            g[f"Wh{d}"] = gwh
            g[f"Wx{d}"] = e.reshape(-1, EMBED).T @ dz_all.reshape(-1, 4 * HIDDEN)
            g[f"b{d}"] = dz_all.sum(axis=(0, 1))
            dx += dz_all @ self.p[f"Wx{d}"].T
        ge = np.zeros_like(self.p["E"])
        np.add.at(ge, x.T, dx)
        g["E"] = ge
        return loss, g

    def states(self, x: np.ndarray) -> np.ndarray:
        """Emissions as steps x TAGS x windows, without a memo; both directions run in one loop, and inputs come from a table of the classes."""
        n, steps = x.shape
        table = np.stack([self.p["E"] @ self.p[f"Wx{d}"] + self.p[f"b{d}"] for d in "fb"]).transpose(0, 2, 1).copy()
        wh = np.stack([self.p[f"Wh{d}"].T for d in "fb"]).copy()
        xt = np.ascontiguousarray(x.T)
        h, c = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
        out = np.empty((2, steps, HIDDEN, n), np.float32)
        for t in range(steps):
            z = wh @ h
            z[0] += table[0][:, xt[t]]
            z[1] += table[1][:, xt[steps - 1 - t]]
            z[:, : 3 * HIDDEN] *= 0.5
            np.tanh(z, out=z)
            gates = z[:, : 3 * HIDDEN]
            gates += 1
            gates *= 0.5
            c *= z[:, HIDDEN : 2 * HIDDEN]
            c += z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
            h = z[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            out[0, t], out[1, steps - 1 - t] = h
        wo = self.p["Wo"].T
        return wo[:, :HIDDEN] @ out[0] + wo[:, HIDDEN:] @ out[1] + self.p["bo"][:, None]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags, windows x steps."""
        em = self.states(x)
        steps, _, n = em.shape
        v = em
        v[0] += self.p["S"][:, None]
        trans = self.p["T"][:, :, None]
        for t in range(1, steps):
            v[t] += (v[t - 1][:, None] + trans).max(axis=0)
        out = np.empty((n, steps), np.int8)
        out[:, -1] = v[-1].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = (v[t - 1] + self.p["T"][:, out[:, t]]).argmax(axis=0)
        return out


# Written forms of each kind that the base patterns miss; # stands for a digit.
SYNTHETIC = [
    (0, "{word} (at) {word}.com"), (0, "{word}@{word}"), (0, "{word} @ {word}.org"), (1, "###.##.###.# "), (2, "#### #### #### ####"), (2, "####-####-####-####"),
    (3, "(###) ###-####"), (3, "###-###-####"), (3, "+# (###) ###-####"), (3, "##.##.##.##.##"),
]


def _tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for k, s, e in spans:
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return y


def train(texts: list[str], seed: int = 7, batches: int = BATCHES) -> Tagger:
    """A tagger from the base spans of some texts and from synthetic forms set into them."""
    r = random.Random(seed)
    xs, ys = [], []
    order = list(range(len(texts)))
    r.shuffle(order)
    for k in order:
        t = texts[k]
        if len(xs) >= TRAIN_WINDOWS:
            break
        starts, x = windows(t)
        if not len(starts):
            continue
        y = _tags(len(x), sorted(base_spans(t), reverse=True))
        own = cut_windows(x, starts)
        tags = np.where(starts[:, None] + np.arange(WINDOW) < len(x), y[np.minimum(starts[:, None] + np.arange(WINDOW), len(x) - 1)], 0)
        # half from windows with a digit or @, which most spans hold, half from the others
        near = ((own == 1) | (own == _CLASS[64])).any(axis=1)
        some, rest = np.flatnonzero(near).tolist(), np.flatnonzero(~near).tolist()
        pick = r.sample(some, min(4, len(some))) + r.sample(rest, min(4, len(rest)))
        xs += list(own[pick])
        ys += list(tags[pick])
    words = [w for t in texts[:200] for w in t[:400].split() if w.isalpha()] or ["name"]
    for _ in range(max(200, len(xs) // 4)):
        kind, form = r.choice(SYNTHETIC)
        form = re.sub("#", lambda _: str(r.randrange(10)), form)
        form = re.sub(r"\{word\}", lambda _: r.choice(words).lower(), form).strip()[:40]
        head = " ".join(r.choice(words) for _ in range(4))[: r.randrange(4, 16)] + " "
        line = head + form + " " + " ".join(r.choice(words) for _ in range(8))
        xs.append(cut_windows(encode(line), np.array([0]))[0])
        ys.append(np.pad(_tags(len(line), [(kind, len(head), len(head) + len(form))]), (0, WINDOW))[:WINDOW])
    x, y = np.array(xs, np.int64), np.array(ys)
    model, rng = Tagger(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for k in range(1, batches + 1):
        at = rng.integers(0, len(x), min(BATCH, len(x)))
        _, g = model.gradients(x[at], y[at])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for name, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * v
            s[name] = 0.99 * s[name] + 0.01 * v * v
            model.p[name] -= (0.02 if k < 0.7 * batches else 0.005) * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.99**k)) + 1e-8)
    return model


def _read(tags: np.ndarray, origin: int, text: str) -> list[tuple[int, int, int]]:
    """Spans of a run of tags, without blanks at their ends; a span must hold what its kind needs."""
    out, k = [], 0
    n = len(tags)
    for at in np.flatnonzero(tags).tolist():
        if at < k:
            continue
        k = at
        kind, e = (int(tags[k]) - 1) // 2, k + 1
        while e < n and tags[e] == 2 + 2 * kind:
            e += 1
        s, z = origin + k, min(origin + e, len(text))
        while s < z and text[s].isspace():
            s += 1
        while z > s and text[z - 1].isspace():
            z -= 1
        body = text[s:z]
        count = len(_digits(body))
        if (kind == 0 and ("@" in body or "(at)" in body.lower()) and len(body) >= 5) or (kind == 1 and count >= 4 and body.count(".") == 3) or (kind == 2 and 13 <= count <= 19) or (kind == 3 and 7 <= count <= 15):
            out.append((kind, s, z))
        k = e
    return out


def reconcile(starts: np.ndarray, tags: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Spans of a whole text from its windows' tags."""
    at = np.arange(len(text))
    own = owner(at, len(starts))
    return _read(tags[own, at - starts[own]], 0, text)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document (`SCHEMA`): base spans and the spans that the tagger adds, in code points."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal texts hash alike, so copies count once; the bound on the hash follows from how many there are
    fit = own.where("text is not null and length(text) between 1 and 4000 and text rlike '[0-9@]'").withColumn("h", F.xxhash64("text"))
    share = min(1.0, train_docs / max(fit.agg(F.approx_count_distinct("h")).first()[0], 1))
    sample = fit.where(sampled(F.col("h"), share)).groupBy("h").agg(F.min("text").alias("text"))

    @tx.released
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for _, t in sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts).p)], pa.binary())], ["model"])

    # trained in one task, where numpy keeps to one core; the sample does not grow with the table
    learned = Tagger()
    row = mapped(sample.select("h", "text").coalesce(1), learn, "model binary").first()
    learned.p = pickle.loads(row[0]) if row else train([]).p  # an empty table may have no task
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # a few thousand numbers

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            for lo, hi, data, offs in tx.slabs(b.column(1)):
                base, added = find_slab(data, offs, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(list(map(as_rows, base)), pa.list_(span)), pa.array(list(map(as_rows, added)), pa.list_(span))], ["doc_id", "base", "added"])

    return mapped(own, run, SCHEMA)


def find_slab(data: np.ndarray, offs: np.ndarray, model: Tagger) -> tuple[list[list], list[list]]:
    """Base and added spans of each row; rows without a `TRIGGER` have none."""
    rows = len(offs) - 1
    base, added = [[] for _ in range(rows)], [[] for _ in range(rows)]
    work, first, want = [], 0, []
    for r in np.flatnonzero(np.diff(offs)).tolist():
        text = data[offs[r] : offs[r + 1]].tobytes().decode()
        hits = [p for m in TRIGGER.finditer(text) for p in range(*m.span())]
        if not hits:
            continue
        base[r] = base_spans(text)
        starts, x = windows(text)
        want.append(first + np.unique(owner(np.array(hits), len(starts))))
        work.append((r, text, starts, cut_windows(x, starts), first))
        first += len(starts)
    if not work:
        return base, added
    x = np.concatenate([w[3] for w in work])
    tags, done = np.zeros(x.shape, np.int8), np.zeros(len(x) + 1, bool)
    heads, tails = np.zeros(len(x), bool), np.zeros(len(x), bool)
    heads[[w[4] for w in work]] = tails[[w[4] + len(w[2]) - 1 for w in work]] = True
    todo, edge = np.concatenate(want), (WINDOW - STRIDE) // 2
    while len(todo):
        done[todo] = True
        for k in range(0, len(todo), 1024):
            tags[todo[k : k + 1024]] = model.decode(x[todo[k : k + 1024]])
        # a span at the end of what a window owns goes on in the next one, or comes from the one before
        left, right = (tags[todo, edge] > 0) & ~heads[todo], (tags[todo, WINDOW - 1 - edge] > 0) & ~tails[todo]
        more = np.unique(np.concatenate([todo[left] - 1, todo[right] + 1]))
        todo = more[~done[more]]
    for r, text, starts, _, at in work:
        mine = tags[at : at + len(starts)]
        spans = reconcile(starts, mine, text) if mine.any() else []
        added[r] = [s for s in spans if not any(s[1] < e and b < s[2] for _, b, e in base[r])]
    return base, added
