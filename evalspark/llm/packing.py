"""Packing by lexical retrieval: windows filled with BM25 neighbours of a seed.

Documents become ids (one end id each). The tokens of a document that fill whole
windows are cut off at once; what is left of each document, its rest, waits for
retrieval. The rests of the whole input are counted (their number, mean length and
each term's document frequency), then sorted by a range shuffle so that rests of
the same heavy terms stand together, see :func:`near`; the order ends in the row
itself, so that a hot term or many copies are split like anything else.

Every task of the sorted rests is a stream of shards, each with an inverted index of
its own in BM25 weights under the counts of the whole input. A window starts with an
unused rest as its seed, asks the index for the seed's neighbours and takes unused
ones in order of their score: whole where they fit; the window's last gap is filled
by a cut of the best one that is too long, whose remainder stays in the pool. What
is less than a window at a shard's end passes on to the next one, so that only the
last sequence of a task is short. Neighbours that the order leaves in other shards
are not found; the README gives the recall.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table, tune
from evalspark.llm.tokens import PACK_END, default_tokenizer, encoder

#: tokens of a sequence
WINDOW = 2048
#: rests indexed at a time
SHARD = 1024
K1, B = 1.2, 0.75
#: terms that more than one in this many of a shard's rests hold are kept as rows
DENSE = 8
#: sequence ids of whole windows have this bit, those of filled ones do not
WHOLE = 1 << 62
#: rows of the statistics that are no term: number of rests, and of their ids
RESTS, IDS = -1, -2
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Stats(NamedTuple):
    """Counts of all rests: their number, their mean length, and the rests that hold each term."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


def _distinct(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest, term, how often), sorted by rest and term."""
    doc = np.repeat(np.arange(len(rests)), [len(r) for r in rests])
    key, tf = np.unique(doc << 32 | np.concatenate(rests).astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


def near(rests: list[np.ndarray], stats: Stats) -> list[bytes]:
    """Sort key of each rest: its heaviest term of those that at least a quarter of all
    rests hold, of those that an eighth hold, and so on down to two rests.

    Rests that agree in more of these terms stand nearer to each other. The heaviest
    of all terms would not do: few or no other rests hold it.
    """
    doc, term, tf = _distinct(rests)
    size = np.fromiter(map(len, rests), np.int64, len(rests))
    weight = stats.idf(term) * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / stats.mean))[doc])
    code = (weight * (1 << 20)).astype(np.int64) << 32 | term
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    df = stats.df[term]
    least = stats.n / 4
    keys, best = [], np.full(len(rests), -1, np.int64)
    while least > 1:
        here = (df >= max(least, 2)) & (df < 2 * least if keys else True)
        best = np.maximum(best, np.maximum.reduceat(np.where(here, code, -1), first))
        keys.append(np.where(best < 0, 0, (best & 0xFFFFFFFF) + 1))
        least /= 2
    flat = np.stack(keys, 1).astype(">u4") if keys else np.zeros((len(rests), 0), ">u4")
    return [row.tobytes() for row in flat]


class Index:
    """BM25 inverted index of a shard's rests; terms are token ids.

    Without ``stats`` the shard counts as the whole input.
    """

    def __init__(self, rests: list[np.ndarray], stats: Stats | None = None):
        self.n = len(rests)
        size = np.fromiter(map(len, rests), np.int64, self.n)
        doc = np.repeat(np.arange(self.n), size)
        terms = np.concatenate(rests).astype(np.int64)
        bits = max(int(self.n - 1).bit_length(), 1)
        key, tf = np.unique(terms << bits | doc, return_counts=True)
        self.doc, term = key & ((1 << bits) - 1), key >> bits
        first = np.r_[True, term[1:] != term[:-1]]
        self.lo = np.flatnonzero(first)
        self.hi = np.r_[self.lo[1:], len(key)]
        df_here = self.hi - self.lo
        if stats is None:
            df = np.zeros(int(term[-1]) + 1, np.int64)
            df[term[first]] = df_here
            stats = Stats(self.n, size.mean(), df)
        idf = stats.idf(term[first])
        number = np.cumsum(first) - 1
        norm = K1 * (1 - B + B * size / stats.mean)
        self.weight = idf[number] * tf * (K1 + 1) / (tf + norm[self.doc])
        # a common term's weights as a row for all rests: adding rows is cheaper than adding postings
        common = df_here * DENSE > self.n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        held = common[number]
        self.rows = np.zeros((int(common.sum()), self.n))
        self.rows[self.row[number[held]], self.doc[held]] = self.weight[held]
        by_doc = np.lexsort((-self.weight, self.doc))
        self.terms = number[by_doc]
        self.at = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))

    def scores(self, i: int, query_terms: int | None = None) -> np.ndarray:
        """Score of every rest against all terms of rest ``i`` (or only its heaviest ones)."""
        terms = self.terms[self.at[i]:self.at[i + 1]][:query_terms]
        rare = terms[self.row[terms] < 0]
        out = self.rows[self.row[terms[self.row[terms] >= 0]]].sum(0)
        if len(rare):
            runs = [slice(a, b) for a, b in zip(self.lo[rare].tolist(), self.hi[rare].tolist(), strict=True)]
            out += np.bincount(np.concatenate([self.doc[r] for r in runs]),
                               weights=np.concatenate([self.weight[r] for r in runs]), minlength=self.n)
        return out


class Packing:
    """Windows of one task: whole ones of long documents, and those filled by retrieval."""

    def __init__(self, window: int, first: int, stats: Stats | None = None):
        self.window, self.next, self.stats = window, first, stats
        self.out: list[tuple] = []

    def whole(self, doc, ids: np.ndarray) -> tuple | None:
        """Cuts off the windows that a document fills alone; returns its rest, if any."""
        total, w = len(ids), self.window
        for start in range(0, total - w + 1, w):
            self.out.append((doc, start, ids[start:start + w], total, self.next, 0))
            self.next += 1
        rest = total % w
        return (doc, total - rest, ids[total - rest:], total) if rest else None

    def shard(self, pool: list[tuple], last: bool) -> list[tuple]:
        """Fills windows from a pool of rests; returns what is less than a window, unless ``last``."""
        index = Index([p[2] for p in pool], self.stats)
        left, unused = list(pool), np.ones(len(pool), bool)
        size = np.fromiter((len(p[2]) for p in pool), np.int64, len(pool))
        remaining, seed = int(size.sum()), 0
        while remaining >= self.window or (last and remaining):
            while not unused[seed]:
                seed += 1
            score = index.scores(seed)
            score[seed] = np.inf
            free = np.flatnonzero(unused)
            room = self.window
            chosen, cut = [], None
            order = free[np.argsort(-score[free], kind="stable")]
            sizes, at = size[order], 0
            while room and at < len(order):
                fits = sizes[at:] <= room
                k = int(fits.argmax())
                if cut is None and (k or not fits[0]):
                    cut = int(order[at])
                if not fits[k]:
                    break
                chosen.append((int(order[at + k]), int(sizes[at + k])))
                room -= chosen[-1][1]
                at += k + 1
            if room and cut is not None:
                chosen.append((cut, room))
            at = 0
            for j, n in chosen:
                doc, start, ids, total = left[j]
                self.out.append((doc, start, ids[:n], total, self.next, at))
                at += n
                if n == size[j]:
                    unused[j] = False
                else:
                    left[j] = (doc, start + n, ids[n:], total)
                size[j] -= n
            remaining -= at
            self.next += 1
        return [p for p, u in zip(left, unused.tolist(), strict=True) if u]

    def flush(self) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*self.out, strict=True)
        self.out = []
        cols = [doc, start, [len(x) for x in ids], [x.tobytes() for x in ids], total, sequence, offset]
        kinds = [pa.binary() if i == 3 else pa.int64() for i in range(7)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          [c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = PACK_END,
         shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows.

    ``ids`` is little-endian uint32. Sequences hold ``window`` tokens; the last
    one of each task may be shorter and is the only one to pad. Null and empty
    texts are their end id alone. Repeated rows and null ids are packed like any
    other; extra columns are ignored; an empty table gives no pieces.
    """
    tune(docs.sparkSession)
    cut = stored(encoded(docs, tokenizer or default_tokenizer(), window, end, id_col, text_col), "packing", "snappy")
    rests = cut.where("sequence_id is null")
    stats = docs.sparkSession.sparkContext.broadcast(counted(rests))

    def keys(batches):
        for b in batches:
            found = near([np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()], stats.value) if len(b) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, "near"])

    def run(batches):
        from pyspark import TaskContext
        packer, pool = Packing(window, TaskContext.get().partitionId() << 40, stats.value), []
        for b in batches:
            for doc, start, ids, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                pool.append((doc, start, np.frombuffer(ids, "<u4"), total))
                if len(pool) >= shard:
                    pool = packer.shard(pool, False)
                if len(packer.out) >= 512:
                    yield packer.flush()
        if pool:
            packer.shard(pool, True)
        if packer.out:
            yield packer.flush()

    keyed = rests.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(
        keys, "doc_id long, start long, ids binary, doc_tokens long, near binary")
    order = ["near", "doc_id", F.crc32("ids")]
    filled = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("near").mapInArrow(run, SCHEMA)
    return cut.where("sequence_id is not null").unionByName(filled)


def encoded(docs: DataFrame, tokenizer: str, window: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Whole windows as pieces, and each document's rest as a piece without a sequence."""
    def run(batches):
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        packer = Packing(window, WHOLE | TaskContext.get().partitionId() << 40)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                rest = packer.whole(doc, np.append(ids, np.uint32(end)))
                if rest:
                    packer.out.append((*rest, None, None))
                if len(packer.out) >= 512:
                    yield packer.flush()
        if packer.out:
            yield packer.flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def counted(rests: DataFrame) -> Stats:
    """Statistics of all rests; no more rows come to the driver than the vocabulary has."""
    def run(batches):
        df, n, ids = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            found = [np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()]
            if found:
                more = np.bincount(_distinct(found)[1])
                if len(more) > len(df):
                    df = np.r_[df, np.zeros(len(more) - len(df), np.int64)]
                df[:len(more)] += more
                n, ids = n + len(found), ids + sum(map(len, found))
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[terms, RESTS, IDS]), pa.array(np.r_[df[terms], n, ids])], ["term", "n"])

    sums = rests.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = dict(map(tuple, sums.collect()))
    n, ids = got.pop(RESTS, 0), got.pop(IDS, 0)
    df = np.zeros(max(got, default=0) + 1, np.int64)
    df[list(got)] = list(got.values())
    return Stats(n, ids / max(n, 1), df)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed; each piece with a checksum of its ids."""
    return pieces(pack(table(spark, sf_dir, "documents")))


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
