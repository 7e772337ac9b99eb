"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a Jaccard signature of a whole
document says nothing about an item inside it. Both sides are partitioned by
size: an item of q shingles belongs to the class of the power of two Q >= q, and
for that class a document is a row of windows of 2Q shingles, one every Q, so
that a passage of the item's length lies whole in a window. There the Jaccard
similarity of an item and its copy is at least a fifth, and one agreeing bin of a
one-permutation MinHash signature makes a candidate.

Signatures are compared lazily: a bin of a window can only agree with an item
where the window holds the item's minimum of that bin, so only those bins are
computed. Candidates are verified by exact containment of the item's shingles,
as words, in the whole document.

Items are sent to the tasks in blocks of bounded size, a pass over the documents
for each block; documents are not shuffled at all.
"""
from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import table, tune

SHINGLE = 5
LEAST = 0.8
#: bins of a signature
BINS = 64
#: characters of items that go to the tasks at once
ITEM_CHARS = 16 << 20
#: code points worked on at a time
CUT = 1 << 20
_BASE = 0x5851F42D4C957F2D
_M = np.uint64(0xD6E8FEB86659FD93)

_tables: dict[str, np.ndarray] = {}


def _word_chars() -> np.ndarray:
    """True for letters and digits of any script."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)
    return _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        n = max(n, 1 << 16)
        _tables["pow"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
        _tables["inv"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 2 ** 64), np.uint64)])
    return _tables["pow"], _tables["inv"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _M
    return h ^ (h >> np.uint64(29))


class Words:
    """Lower-cased words of texts put together: runs of letters and digits."""

    def __init__(self, texts: list[str]):
        texts = [(t or "").lower() for t in texts]
        self.joined = "".join(texts)
        cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        word = _word_chars()[cp]
        first = np.zeros(len(cp) + 1, bool)
        first[off] = True
        before = np.r_[False, word[:-1]] if len(cp) else word
        self.at = np.flatnonzero(word & (~before | first[:-1]))
        after = np.r_[word[1:], False] if len(cp) else word
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        pow_, inv = _powers(len(cp) + 1)
        run = np.r_[np.uint64(0), np.cumsum(np.where(word, cp.astype(np.uint64) + np.uint64(1), np.uint64(0)) * pow_[:len(cp)])]
        self.hash = _mixed((run[self.end] - run[self.at]) * inv[self.at] + (self.end - self.at).astype(np.uint64))
        #: words before each text
        self.first = np.searchsorted(self.at, off)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the number of them before each text."""
        n = np.diff(self.first)
        per = np.maximum(n - k + 1, 0)
        total = max(len(self.hash) - k + 1, 0)
        h = np.zeros(total, np.uint64)
        for j in range(k):
            h = h * _M + self.hash[j:j + total]
        text = np.repeat(np.arange(len(n)), n)[:total]
        inside = np.arange(total) + k <= self.first[text + 1]
        return _mixed(h[inside]), np.r_[0, np.cumsum(per)]

    def words(self, i: int) -> list[str]:
        lo, hi = self.first[i], self.first[i + 1]
        return [self.joined[a:b] for a, b in zip(self.at[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def grams(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[j:] for j in range(k)), strict=False))


class Items:
    """Signatures of a block of items, by shingle length and size class."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, least: float = LEAST):
        self.least = least
        self.ids, self.grams, self.k, self.hashes = [], [], [], []
        w = Words([t for _, t in items])
        by_k = {k: w.shingles(k) for k in range(1, shingle + 1)}
        for i, (item, _) in enumerate(items):
            words = w.words(i)
            if not words:
                continue
            k = min(shingle, len(words))
            h, first = by_k[k]
            self.ids.append(item)
            self.k.append(k)
            self.grams.append(grams(words, k))
            self.hashes.append(np.unique(h[first[i]:first[i + 1]]))
        #: (shingle length, window half Q) -> (sorted minima, their items)
        self.classes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        found: dict[tuple[int, int], list] = {}
        for i, h in enumerate(self.hashes):
            bins = (h & np.uint64(BINS - 1)).astype(np.int64)
            low = h[np.unique(bins, return_index=True)[1]]  # hashes ascend: the first of a bin is its minimum
            q = max(1, 1 << int(len(self.grams[i]) - 1).bit_length())
            found.setdefault((self.k[i], q), []).append((low, np.full(len(low), i)))
        for key, parts in found.items():
            low, who = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
            order = np.argsort(low, kind="stable")
            self.classes[key] = (low[order], who[order])
        self.sieve = {}
        for (k, _), (low, _) in self.classes.items():
            bits = self.sieve.setdefault(k, np.zeros(1 << 20, bool))
            bits[(low >> np.uint64(6)).astype(np.int64) & 0xFFFFF] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, item number, shingles found) of every item contained in a text."""
        w = Words(texts)
        out = []
        exact: dict[tuple[int, int], set] = {}
        for k, sieve in self.sieve.items():
            s, first = w.shingles(k)
            hits = np.flatnonzero(sieve[(s >> np.uint64(6)).astype(np.int64) & 0xFFFFF])
            for (kk, q), (low, who) in self.classes.items():
                if kk != k or not len(hits):
                    continue
                pairs = self._candidates(s, first, hits, q, low, who)
                for text, item in pairs:
                    here = s[first[text]:first[text + 1]]
                    need = self.hashes[item]
                    if np.isin(need, here).sum() < self.least * len(need) - 1e-9:
                        continue
                    if (text, k) not in exact:
                        exact[text, k] = grams(w.words(text), k)
                    n = len(self.grams[item] & exact[text, k])
                    if n >= self.least * len(self.grams[item]) - 1e-9:
                        out.append((text, item, n))
        return out

    def _candidates(self, s, first, hits, q, low, who) -> list[tuple[int, int]]:
        """Texts and items that agree in a bin of a window of 2q shingles."""
        lo = np.searchsorted(low, s[hits], "left")
        n = np.searchsorted(low, s[hits], "right") - lo
        hits, lo, n = hits[n > 0], lo[n > 0], n[n > 0]
        if not len(hits):
            return []
        text = np.searchsorted(first, hits, "right") - 1
        block = (hits - first[text]) // q
        good = np.zeros(len(hits), bool)
        step = max(1, (1 << 20) // (2 * q))
        for part in range(0, len(hits), step):
            h, t, b = hits[part:part + step], text[part:part + step], block[part:part + step]
            for shift in (0, 1):  # the windows that start at the hit's block and at the one before
                at = first[t] + np.maximum(b - shift, 0) * q
                to = np.minimum(at + 2 * q, first[t + 1])
                cell = at[:, None] + np.arange(2 * q)
                v = s[np.minimum(cell, len(s) - 1)]
                less = (cell < to[:, None]) & (((v ^ s[h][:, None]) & np.uint64(BINS - 1)) == 0) & (v < s[h][:, None])
                good[part:part + step] |= ~less.any(axis=1)
        text, lo, n = text[good], lo[good], n[good]
        row = np.repeat(np.arange(len(text)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        pairs = np.unique(np.stack([text[row], who[at]], axis=1), axis=0)
        return [tuple(p) for p in pairs.tolist()]


_known: list = [None, None]


def _items(block: list[tuple], shingle: int = SHINGLE, least: float = LEAST) -> Items:
    """Signatures of a broadcast block; the worker's last one is kept."""
    if _known[0] is not block:
        _known[:] = [block, Items(block, shingle, least)]
    return _known[1]


def _found(items: Items, texts: list[str | None]):
    """Matches of a batch, a bounded number of characters at a time."""
    part, size, base = [], 0, 0
    for i, t in enumerate([*texts, None]):
        t = t or ""
        if part and (size + len(t) > CUT or i == len(texts)):
            for row, item, n in items.search(part):
                yield base + row, item, n
            part, size, base = [], 0, i
        part.append(t)
        size += len(t)


def item_blocks(items: DataFrame, chars: int = ITEM_CHARS, id_col: str = "item_id", text_col: str = "text"):
    """The items as lists of (item_id, text), each of about ``chars`` characters at most."""
    items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n = -(-int(total) // chars)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, least: float = LEAST,
              item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found) of every item contained in a document.

    Words are runs of letters and digits, lower-cased. An item is contained if at
    least ``least`` of its distinct shingles of ``shingle`` words occur in the
    document. An item of fewer words is one shingle of its own length; one without
    words is never found. Null texts hold nothing. Repeated documents and items
    give repeated rows; a null doc_id or item_id is returned as null. Extra columns
    are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for block in item_blocks(items, item_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            known = _items(sent.value, shingle, least)
            for b in batches:
                found = list(_found(known, b.column(1).to_pylist()))
                doc = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc[r] for r, _, _ in found], pa.int64()), pa.array([known.ids[i] for _, i, _ in found], pa.int64()),
                     pa.array([len(known.grams[i]) for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                    ["doc_id", "item_id", "n_shingles", "n_found"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_found long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return rows.select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("item_id", "n_shingles", "n_found"))).limit(0)
    return out


def op10_decontam(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with the share of its shingles."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "*", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` that contain no benchmark item, as they are."""
    tune(spark)
    for block in item_blocks(table(spark, sf_dir, "benchmark")):
        sent = spark.sparkContext.broadcast(block)
        text = docs.columns.index("text")

        def run(batches, sent=sent):
            known = _items(sent.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _, _ in _found(known, b.column(text).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
ig as (select distinct item_id, least(5, len(w)) as k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g
       from (select *, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from iw where len(w) > 0)),
size as (select item_id, count(*) as n_shingles from ig group by item_id),
dg as (select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as g
       from (select *, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from ig) where len(w) >= k)),
hit as (select doc_id, item_id, count(*) as n_found from dg join ig using (k, g) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment
from hit join size using (item_id) where n_found >= 0.8 * n_shingles - 1e-9
"""
