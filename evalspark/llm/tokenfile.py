"""Token files: frequency-ranked ids, byte-aligned codes, control bytes apart.

File format (a folder that Spark writes and commits, so a lost task leaves
nothing half written; Parquet carries the byte blocks):

* ``vocab``: (rank, id, n). Rank 0 is the most frequent id, ties by id.
* ``blocks``: one row per block of whole documents, in ascending doc_id order
  (nulls first, equal ids by content) by (shard, block):
  ``start`` ids of the shard before the block, ``n_tokens``, ``doc_ids`` and
  ``doc_tokens`` (little-endian int64, eight FF bytes apart from a null flag in
  ``doc_null``), ``control`` and ``data``.
* ``control`` holds two bits per rank, four to a byte from the low end: its
  length in bytes less one. ``data`` holds the ranks' low bytes, little-endian.

Frequent ids get ranks below 256 and take one byte. The reader turns a control
byte into four lengths by a 256-row table, sums them up to offsets and gathers
all ranks of a block at once.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table, tune, width_for
from evalspark.llm.tokens import FILE_END, default_tokenizer, encoder

#: ids of a block, at least (a block ends with a document)
BLOCK = 1 << 18
#: ids of a shard, about
SHARD = 8 << 20

#: lengths of the four codes of each control byte
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
LOW = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_codes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[:len(ranks)] = more
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    four = np.lib.stride_tricks.as_strided(raw[:4].view("<u4"), (max(len(raw) - 3, 0),), (1,)) if len(raw) > 3 else np.zeros(0, np.uint32)
    return four[at] & LOW[size]


def encode(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids, in one pass: (doc_id, h, n, ids, counts).

    A document's row has its ids with ``end`` (zstd over little-endian uint32 or,
    where they fit, uint16); each task adds rows with the counts of the ids it
    wrote, as (id, n) pairs.
    """

    def run(batches):
        enc = encoder(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        counts = np.zeros(1 << 16, np.int64)
        for b in batches:
            got = enc.encode(b.column(1).to_pylist())
            rows, n = [], []
            for ids in got:
                ids = np.append(ids, np.uint32(end))
                n.append(len(ids))
                rows.append(squeeze(ids.astype("<u2") if ids.max() < 1 << 16 else ids))
            every = np.concatenate([*got, np.full(len(got), end, np.uint32)]) if got else np.zeros(0, np.uint32)
            c = np.bincount(every, minlength=len(counts))
            counts = np.r_[counts, np.zeros(len(c) - len(counts), np.int64)] + c
            nulls = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(rows, pa.binary()), nulls],
                                             ["doc_id", "n", "ids", "counts"])
        some = np.flatnonzero(counts)
        if len(some):
            pairs = np.stack([some, counts[some]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                              pa.array([pairs], pa.binary())], ["doc_id", "n", "ids", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, ids binary, counts binary")


def ids_of(packed: bytes, n: int) -> np.ndarray:
    """Ids of a row of :func:`encode`."""
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=4 * n)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _counted(encoded: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for pairs in b.column(0).to_pylist():
                ids, n = np.frombuffer(pairs, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    rows = encoded.where("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, tokenizer: str | None = None, end: int = FILE_END, shard_tokens: int = SHARD,
          block_tokens: int = BLOCK) -> dict[str, DataFrame]:
    """Write the documents as a token file; returns its tables ``vocab`` and ``blocks``, reread.

    Null and empty texts have the end id alone. A null doc_id stays null and
    comes first. Repeated rows are kept. Extra columns are ignored. An empty
    table gives empty tables. The vocabulary (at most 2**32 ids, 50,257 here)
    bounds what goes to every task.
    """
    tune(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    encoded = stored(encode(docs, tokenizer, end), "ids", "uncompressed")
    ranked = sorted(((r["n"], r["id"]) for r in _counted(encoded).collect()), key=lambda x: (-x[0], x[1]))  # the vocabulary at most
    vocab = stored(docs.sparkSession.createDataFrame(
        [(i, t, n) for i, (n, t) in enumerate(ranked)], "rank long, id long, n long").coalesce(1), "vocab")
    rank = np.zeros(max([t for _, t in ranked], default=0) + 1, np.uint32)
    rank[[t for _, t in ranked]] = np.arange(len(ranked))
    shards = width_for(sum(n for n, _ in ranked), shard_tokens)
    rank_of = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        from pyspark import TaskContext
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held, held_n = [], 0

        def flush():
            nonlocal block, start, held, held_n
            ids = rank_of.value[np.concatenate([x for _, x in held])]
            control, data = pack_codes(ids)
            row = [shard, block, start, len(ids), np.array([d or 0 for d, _ in held], "<i8").tobytes(),
                   bytes(d is None for d, _ in held), np.array([len(x) for _, x in held], "<i8").tobytes(), control, data]
            block, start, held, held_n = block + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for b in batches:
            for d, n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held.append((d, ids_of(packed, n)))
                held_n += n
                if held_n >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = encoded.where("ids is not null").select("doc_id", "n", "ids", F.xxhash64("ids").alias("h"))
    ordered = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "n", "ids")
    return {"vocab": vocab, "blocks": stored(ordered.mapInArrow(run, BLOCK_SCHEMA), "blocks", "uncompressed")}


BLOCK_SCHEMA = ("shard long, block long, start long, n_tokens long, doc_ids binary, doc_null binary, "
                "doc_tokens binary, control binary, data binary")


def read(tables: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, read back from the blocks.

    ``ids`` is little-endian uint32. Only one number per shard goes through the
    driver.
    """
    blocks, vocab = tables["blocks"], tables["vocab"]
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for shard, n in totals:
        base[shard] = at
        at += n
    id_of = np.array([r["id"] for r in sorted(vocab.collect(), key=lambda r: r["rank"])], "<u4")  # the vocabulary at most
    ctx = blocks.sparkSession.sparkContext
    bases, table_of = ctx.broadcast(base), ctx.broadcast(id_of)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = table_of.value[unpack_codes(row["control"], row["data"], row["n_tokens"])]
                n = np.frombuffer(row["doc_tokens"], "<i8")
                ends = np.cumsum(n)
                first = bases.value[row["shard"]] + row["start"]
                null = np.frombuffer(row["doc_null"], np.uint8).astype(bool)
                raw = [ids[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), pa.array(first + ends - n), pa.array(n),
                     pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document written and read back, with a checksum of its ids."""
    back = read(write(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
