"""Token ids of whole texts with a public byte-level BPE tokenizer.

The tokenizer's pattern cuts a text into words before merging, and a word's ids
never depend on its neighbours. So a batch of texts is cut with numpy over code
points, each distinct word goes to the ``tokenizers`` library once per Python
worker, and the ids of all words are gathered from a bounded cache.

Texts with a code point whose class changed between Unicode versions go to the
library whole: there the cut is the library's own. Both ways give the same ids.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np

#: end of a document in the packed stream and in the token files
PACK_END, FILE_END = 1, 2
#: code points cut at a time
CUT = 1 << 20
#: words a worker remembers before it starts anew
CACHE = 1 << 21
#: new words given to the library at once
CHAIN = 256
OTHER, LETTER, NUMBER, SPACE, ASK = 0, 1, 2, 3, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_tokenizer() -> str:
    """Path of the byte-level BPE vocabulary (a parameter everywhere)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def char_classes() -> np.ndarray:
    """Class of each code point; ASK where it may depend on the Unicode version."""
    old = unicodedata.ucd_3_2_0
    kinds = np.full(0x110000, ASK, np.uint8)

    def kind(c: str) -> int:
        return LETTER if c[0] == "L" else NUMBER if c[0] == "N" else OTHER

    for i in range(0x3100):
        c = chr(i)
        a, b = unicodedata.category(c), old.category(c)
        if a != "Cn" and b != "Cn" and kind(a) == kind(b):
            kinds[i] = kind(a)
    # Unicode White_Space
    for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        kinds[i] = SPACE
    kinds[0x180E] = ASK
    return kinds


def word_starts(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in code points of texts put together; ``first`` marks each text's first."""
    n = len(cp)
    prev = np.r_[np.uint8(255), kind[:-1]]
    turn = first | (kind != prev)
    space = kind == SPACE
    ends = np.r_[turn[1:], True]
    text_ends = np.r_[first[1:], True]
    # the last white space before another character of the same text
    last = space & ends & ~text_ends
    start = turn.copy()
    start |= last
    glued = last & (cp == 0x20)
    after = np.r_[False, glued[:-1]]
    start &= ~after
    # 's 't 'm 'd 're 've 'll where an apostrophe starts a word of its own
    quote = np.flatnonzero((cp == 0x27) & start & ends & ~text_ends)
    if len(quote):
        def at(i):
            j = quote + i
            same = (j < n) & ~np.logical_or.reduce([first[np.minimum(quote + k, n - 1)] for k in range(1, i + 1)])
            return np.where(same, cp[np.minimum(j, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        rest = hit + size
        rest = rest[rest < n]
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids, with a cache of words; one per Python worker."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.kinds = char_classes()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(self.tok.get_vocab_size() + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(w) for w in vocab]  # one character stands for one byte
        self.pow = None
        self.clear()

    def clear(self):
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each key's word, -1 where unseen (linear probing)."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (h >> np.uint64(20)) & mask
        found = self.keys[at]
        out = np.where(found == h, self.slot[at], -1)
        todo = np.flatnonzero((found != h) & (found != 0))
        at = at[todo]
        while len(todo):
            at = (at + np.uint64(1)) & mask
            found, want = self.keys[at], h[todo]
            hit = found == want
            out[todo[hit]] = self.slot[at[hit]]
            go = ~hit & (found != 0)
            todo, at = todo[go], at[go]
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enter new distinct keys."""
        while (self.n + len(h)) * 2 > 1 << self.bits:
            old_k, old_s = self.keys[self.keys != 0], self.slot[self.keys != 0]
            self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.slot = np.zeros(1 << self.bits, np.int32)
            self._place(old_k, old_s)
        self._place(h, number)

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        at = (h >> np.uint64(20)) & mask
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = h[todo[free]]
            won = self.keys[at[todo]] == h[todo]
            self.slot[at[todo[won]]] = number[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + np.uint64(1)) & mask

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words put together, and the number of ids of each.

        The library gets a chain of words at once, as far as its pattern cuts
        the chain where the words meet (a line feed stands before a word without
        a space of its own); the lengths of the ids' bytes tell the words apart.
        """
        parts: list[np.ndarray] = [None] * len(words)
        safe = [i for i, w in enumerate(words) if (w[0] == " " or not w[0].isspace()) and not w.isspace()]
        groups = [safe[i:i + CHAIN] for i in range(0, len(safe), CHAIN)]
        text = ["".join(w if (w := words[i])[0] == " " else "\n" + w for i in g) for g in groups]
        done = set()
        for g, e in zip(groups, self.tok.encode_batch_fast(text, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.bytes[ids])
            glued = np.array([words[i][0] != " " for i in g])
            upto = np.cumsum(np.array([len(words[i].encode("utf-8", "surrogatepass")) for i in g]) + glued)
            hi = np.searchsorted(ends, upto)
            if ends[-1] != upto[-1] or not np.array_equal(ends[np.minimum(hi, len(ends) - 1)], upto):
                continue
            lo = np.r_[0, hi[:-1] + 1] + glued
            for i, a, b in zip(g, lo.tolist(), hi.tolist(), strict=True):
                parts[i] = ids[a:b + 1]
            done.update(g)
        rest = [i for i in range(len(words)) if i not in done]
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        size = np.fromiter(map(len, parts), np.int32, len(parts))
        return np.concatenate(parts), size

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        flat, size = self._ids(words)
        got = words
        lo, hi = self.n, self.n + len(got)
        while hi > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.start[lo:hi] = self.used + np.cumsum(size) - size
        self.size[lo:hi] = size
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self._put(h, np.arange(lo, hi, dtype=np.int32))
        self.n = hi

    def _keys(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64-bit key of each word: a polynomial over its code points, mixed with its length."""
        n = len(cp)
        if self.pow is None or len(self.pow) < n + 1:
            base, inv = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2 ** 64)
            self.pow = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
            self.inv = np.cumprod(np.r_[np.uint64(1), np.full(n, inv, np.uint64)])
        run = np.add.reduceat((cp.astype(np.uint64) + np.uint64(1)) * self.pow[:n], at)
        h = run * self.inv[at]
        h ^= np.diff(np.r_[at, n]).astype(np.uint64) * _MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h | np.uint64(1)

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return [np.zeros(0, np.uint32)] * len(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.r_[0, np.cumsum(size)]
        kind = self.kinds[cp]
        ask = kind == ASK
        first = np.zeros(len(cp), bool)
        first[off[:-1][size > 0]] = True
        whole = []
        if ask.any():
            whole = np.flatnonzero(np.add.reduceat(np.r_[ask, False], np.minimum(off[:-1], len(cp)))[:len(texts)] * (size > 0)).tolist()
        at = word_starts(cp, kind, first)
        h = self._keys(cp, at)
        if self.n > CACHE:
            self.clear()
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, pick = np.unique(h[new], return_index=True)
            pick = new[pick]
            stop = np.r_[at[1:], len(cp)]
            self._learn([joined[a:b] for a, b in zip(at[pick].tolist(), stop[pick].tolist(), strict=True)], keys)
            number[new] = self._find(h[new])
        n_ids = self.size[number].astype(np.int64)
        ends = np.cumsum(n_ids)
        flat = self.ids[np.repeat(self.start[number] - ends + n_ids, n_ids) + np.arange(int(ends[-1]))]
        word_of = np.searchsorted(at, off)
        bound = np.r_[0, ends][word_of]
        out = [flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        for i in whole:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; null counts as empty."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if part and size + len(t) > CUT:
                out += self._cut(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._cut(part) if part else out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
