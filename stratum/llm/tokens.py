"""Tokenisation of whole texts, with each distinct piece merged once per worker.

A byte-level BPE splits a text into pre-tokens before it merges.  A space that
follows a non-space always begins a pre-token, so a text may be cut there: the
ids of the pieces, joined, are the ids of the text.  Runs of spaces are never
cut inside.  Pieces (mostly words) are found, hashed and looked up for a whole
slab at once; only pieces that a worker has not seen lately reach the merge loop,
which runs on the tokenizer file's own vocabulary.  A remembered piece is
compared byte by byte.  The equality with the `tokenizers` library on whole
texts is tested.

A byte-level vocabulary loses nothing, so token lengths in bytes give every
token's place in the text.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from . import text as tx

#: Places for pieces that a worker remembers (a newer piece takes an older one's place).
SLOTS = 1 << 20
#: Ids and bytes that are kept for them at most, and bytes of a piece that is remembered.
KEPT_IDS, KEPT_BYTES, LONGEST = 1 << 21, 1 << 23, 64

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14), *range(28, 32)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shown_bytes() -> dict[str, int]:
    """Byte-level files write bytes as letters: printable ones as themselves, the others from 256 up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level tokenizer file, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    shown = _shown_bytes()
    return {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}, added


class PieceTokenizer:
    """Encodes slabs; where a text has an added token's string, that token's id stands, as the library gives it."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self.added = vocabulary(path)
        coder = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.merge = functools.partial(coder.encode, allowed_special="all", disallowed_special=())
        self.size = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        for t, i in self.added.items():
            self.size[i] = len(t.encode())
        self.keys = np.zeros(SLOTS, np.uint64)
        self.begin, self.count, self.place, self.length = (np.zeros(SLOTS, np.int32) for _ in range(4))
        self._forget()

    def _forget(self) -> None:
        self.length[:] = 0  # no piece is empty
        self.flat, self.used = np.zeros(2 * KEPT_IDS, np.int32), 0
        self.raw, self.filled = np.zeros(2 * KEPT_BYTES + 8, np.uint8), 0

    @classmethod
    def shared(cls, path: str) -> PieceTokenizer:
        """One per worker process: what it has learned serves later tasks."""
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces, joined, and each one's count.  Pieces that begin with one space and end with none are merged as one text."""
        texts = [p.decode() for p in pieces]
        plain = np.array([t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace() for t in texts], bool)
        joined = np.array(self.merge("".join([t for t, on in zip(texts, plain.tolist(), strict=True) if on])), np.int32)
        count = np.zeros(len(pieces), np.int64)
        if plain.any():
            edges = np.cumsum(np.array([len(p) for p in pieces])[plain])
            count[plain] = np.diff(np.searchsorted(np.cumsum(self.size[joined]), edges, "left") + 1, prepend=0)
        odd = {k: self.merge(texts[k]) for k in np.flatnonzero(~plain).tolist()}
        for k, ids in odd.items():
            count[k] = len(ids)
        out = np.empty(int(count.sum()), np.int32)
        out[np.repeat(plain, count)] = joined
        out[np.repeat(~plain, count)] = [i for ids in odd.values() for i in ids]
        return out, count

    def _learn(self, pieces: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and count of new pieces; those that are not too long take their slots."""
        ids, count = self._merge_all(pieces)
        short = np.array([len(p) <= LONGEST for p in pieces], bool)
        kept = np.frombuffer(b"".join([p for p in pieces if len(p) <= LONGEST]), np.uint8)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(ids), np.int32)])
        if self.filled + len(kept) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw[: self.filled], np.zeros(len(kept) + 8, np.uint8)])
        begin = self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + len(ids)] = ids
        size = np.array([len(p) for p in pieces], np.int64)[short]
        place = self.filled + np.cumsum(size) - size
        self.raw[self.filled : self.filled + len(kept)] = kept
        self.used, self.filled = self.used + len(ids), self.filled + len(kept)
        slot = (h[short] & np.uint64(SLOTS - 1)).astype(np.int64)
        # of pieces that share a slot the last one holds it, in all columns alike
        slot, last = np.unique(slot[::-1], return_index=True)
        at = np.flatnonzero(short)[::-1][last]
        self.begin[slot], self.count[slot], self.keys[slot] = begin[at], count[at], h[at]
        self.place[slot], self.length[slot] = place[::-1][last], size[::-1][last]
        return begin, count

    def _known(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each piece is the one in its slot: its hash first, then every byte."""
        known = (self.keys[slot] == h) & (self.length[slot] == size)
        at, kept = tx.eights(data), np.ndarray(len(self.raw) - 7, "<u8", buffer=self.raw, strides=(1,))
        live, done = np.flatnonzero(known), 0
        while len(live):
            differ = (at[starts[live] + done] ^ kept[self.place[slot[live]] + done]) & tx._MASK[np.minimum(size[live] - done, 8)]
            known[live[differ != 0]] = False
            done += 8
            live = live[(size[live] > done) & (differ == 0)]
        return known

    def encode_slab(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slab's rows, joined, and each row's first token."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        if self.used > KEPT_IDS or self.filled > KEPT_BYTES:
            self._forget()
        space = data == 32
        blank, high = _BLANK[data], data >= 128
        cut = np.zeros(n, bool)
        cut[1:] = space[1:] & ~blank[:-1]
        # beyond ASCII the byte before may end a blank: then cut only before a space that a plain byte follows
        after = np.ones(n, bool)
        after[:-1] = blank[1:] | high[1:]
        cut[1:] &= ~(high[:-1] & after[1:])
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        h = tx.word_hashes(data, starts, ends)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        begin, count = self.begin[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(~self._known(data, starts, ends - starts, h, slot))
        if len(new):
            raw, own = data.tobytes(), {}
            back = [own.setdefault(raw[a:z], len(own)) for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            one = np.empty(len(own), np.int64)
            one[back] = new
            got = self._learn(list(own), h[one])
            begin[new], count[new] = got[0][back], got[1][back]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(begin - (upto - count), count) + np.arange(int(upto[-1]))]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, offs)]


_SHARED: dict[str, PieceTokenizer] = {}
