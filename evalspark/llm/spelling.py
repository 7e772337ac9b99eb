"""Spelling variants: words one edit apart, grouped under much more frequent forms.

1. Words are counted in each task and summed. A word costs one row per task.
2. Two words one edit apart have a common prefix of c and a common suffix of s letters
   with c + s >= M - 1, M the longer length. Of three parts of the word, the edit lies
   in one; the other two agree. So every word is filed, for M its own length and one
   more, under three keys: its end (edit in the first part), both ends (in the second),
   its beginning (in the third). A pair is taken only under the key of the part in which
   its common prefix stops, so it is found exactly once.
3. The words of a key are compared densely, as padded matrices of code points: a tile of
   words against a tile of words, the longest common prefix and suffix of each pair by
   one comparison each of the matrices aligned left and right. Keys with more than ``TILE``
   words are cut into blocks, and pairs of blocks are dealt to different tasks.
4. Tasks send, for each word, how many words are near and the best of them; forms are
   followed to their root by pointer doubling.
"""
from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import release, stored, table, tune

#: a word: letters, occurrences; a form: times the word's occurrences; one run in so many loses a letter
LEAST_LETTERS, LEAST_N, TIMES, EVERY = 7, 2, 10, 31
#: words of a block, at most about
TILE = 2048
#: code points compared at a time, and held of a batch of small groups
CELLS = 1 << 22
#: words that a task counts before it sends them on
HELD = 500_000
ROWS = 20_000

#: Latin-1 bytes: A-Z lowered, a-z and U+00C0 to U+00FF as they are, all else a separator
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def spelled(doc_id, text: str) -> Counter:
    """Words of a document (Latin-1 bytes) with their occurrences."""
    found = Counter(w for w in text.encode("latin-1", "replace").translate(LETTERS).split(b" ") if len(w) >= LEAST_LETTERS)
    start = crc32(b"%d:" % doc_id if doc_id is not None else b":")
    lost = []
    for w in found:
        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if not h % EVERY:
            lost.append((w, h % len(w)))
    moved = [(w[:at] + w[at + 1:], found.pop(w)) for w, at in lost]
    for w, n in moved:
        if len(w) >= LEAST_LETTERS:
            found[w] += n
    return found


def words(docs: DataFrame, held: int = HELD, least: int = LEAST_N) -> DataFrame:
    """(word, n): the words of all texts that occur at least ``least`` times."""

    def sent(total: dict):
        every = list(total)
        for i in range(0, len(every), ROWS):
            part = every[i:i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([total[w] for w in part], pa.int64())], ["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    seen = total.get
                    for w, n in spelled(doc_id, text).items():
                        total[w] = seen(w, 0) + n
                    if len(total) > held:
                        yield from sent(total)
                        total = {}
        yield from sent(total)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def filed(found: DataFrame) -> DataFrame:
    """(m, part, key, word, n): every word under its keys, for pairs whose longer word has m letters.

    With a = (m - 1) div 3 and b = 2 (m - 1) div 3 (places of the edit, from 0): part 0
    is an edit at a or before, part 1 up to b, part 2 after b.
    """
    d = found.withColumn("l", F.length("word")).withColumn("m", F.explode(F.array("l", F.col("l") + 1)))
    d = d.withColumn("a", F.expr("(m - 1) div 3")).withColumn("b", F.expr("2 * (m - 1) div 3"))
    keys = F.array(F.expr("right(word, cast(m - 1 - a as int))"),
                   F.expr("concat(left(word, cast(a + 1 as int)), right(word, cast(m - 1 - b as int)))"),
                   F.expr("left(word, cast(b + 1 as int))"))
    d = d.select("m", "word", "n", F.posexplode(keys).alias("part", "text"))
    return d.select("m", "part", F.xxhash64("m", "part", "text").alias("key"), "word", "n")


class Matrix:
    """Words as rows of code points, aligned left and right."""

    def __init__(self, words: list[bytes], n: np.ndarray, m: np.ndarray, part: np.ndarray):
        self.words, self.n, self.m, self.part = words, n, m, part
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.wide = wide = int(self.length.max(initial=0))
        self.left = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        self.right = np.frombuffer(b"".join(w[::-1].ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """True where words i and j are one edit apart and this key is the one to say so."""
        out = np.zeros(len(i), bool)
        step = max(1, CELLS // max(self.wide, 1))
        for lo in range(0, len(i), step):
            x, y = i[lo:lo + step], j[lo:lo + step]
            m, longer = self.m[x], np.maximum(self.length[x], self.length[y])
            fits = np.flatnonzero((longer == m) & (m == self.m[y]) & (self.part[x] == self.part[y]))
            if not len(fits):
                continue
            x, y, m = x[fits], y[fits], m[fits]
            shorter = np.minimum(self.length[x], self.length[y])
            c = np.minimum(_run(self.left[x] == self.left[y]), shorter)
            s = np.minimum(_run(self.right[x] == self.right[y]), shorter)
            part = (c > (m - 1) // 3).astype(np.int64) + (c > 2 * (m - 1) // 3)
            out[lo + fits] = (c + s >= m - 1) & (part == self.part[x]) & ((c < m) | (shorter < m))
        return out


def _run(same: np.ndarray) -> np.ndarray:
    """Length of the run of True that each row begins with."""
    if not same.shape[1]:
        return np.zeros(len(same), np.int64)
    first = np.argmin(same, axis=1)
    return np.where(same[np.arange(len(same)), first], same.shape[1], first)


def _pairs(size: np.ndarray, most: int):
    """Index pairs (i < j) of rows of the same group, groups in a row of the given sizes; about ``most`` at a time."""
    end = np.repeat(np.cumsum(size), size)
    other = end - 1 - np.arange(len(end))  # rows after this one in its group
    total = np.cumsum(other)
    lo = 0
    while lo < len(other):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        k = other[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi


_FOUND = "word string, n_near long, best_n long, best string"


def _compare(cells: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): what each cell finds for its words."""

    def tally(mat: Matrix, i: np.ndarray, j: np.ndarray):
        if not len(i):
            return
        a, b = np.r_[i, j], np.r_[j, i]
        order = np.lexsort((-mat.n[b], a))
        a, b = a[order], b[order]
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        top = mat.n[b[cut]]
        best = [mat.words[x] for x in b[cut].tolist()]
        owner = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
        for k in np.flatnonzero(mat.n[b] == top[owner]).tolist():  # of equally frequent ones the smallest
            best[owner[k]] = min(best[owner[k]], mat.words[b[k]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([mat.words[x].decode("latin-1") for x in a[cut].tolist()], pa.string()), pa.array(np.diff(np.r_[cut, len(a)])),
             pa.array(top), pa.array([w.decode("latin-1") for w in best], pa.string())], ["word", "n_near", "best_n", "best"])

    def small(rows: list[tuple]):
        """Whole groups of one block, together."""
        if len(rows) < 2:
            return
        mat = matrix(rows)
        cell = np.fromiter((r[2] for r in rows), np.int64, len(rows))
        cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (mat.m[1:] != mat.m[:-1])])
        hits = [(i[k], j[k]) for i, j in _pairs(np.diff(np.r_[cut, len(rows)]), CELLS // max(mat.wide, 1)) for k in [mat.near(i, j)]]
        if hits:
            yield from tally(mat, *(np.concatenate(x) for x in zip(*hits, strict=True)))

    def across(rows: list[tuple]):
        """A block against another block of its group, or against itself."""
        mat = matrix(rows)
        one = np.fromiter((r[5] for r in rows), np.int64, len(rows))
        if rows[0][3] == rows[0][4]:
            yield from small(rows)
            return
        x, y = np.flatnonzero(one == rows[0][3]), np.flatnonzero(one == rows[0][4])
        hits = []
        step = max(1, CELLS // max(mat.wide, 1) // max(len(y), 1))
        for lo in range(0, len(x), step):
            i, j = np.repeat(x[lo:lo + step], len(y)), np.tile(y, len(x[lo:lo + step]))
            k = mat.near(i, j)
            hits.append((i[k], j[k]))
        if hits:
            yield from tally(mat, *(np.concatenate(x) for x in zip(*hits, strict=True)))

    def matrix(rows: list[tuple]) -> Matrix:
        m, part, n = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in (0, 1, 7))
        return Matrix([r[6] for r in rows], n, m, part)

    def run(batches):
        held: list[tuple] = []  # whole small groups
        now: list[tuple] = []  # the present cell

        def closed():
            nonlocal held
            if now[0][3] == now[0][4] == 0:
                if (len(held) + len(now)) * now[0][0] > CELLS:  # words come in order of length
                    yield from small(held)
                    held = []
                held += now
            else:
                yield from across(now)

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            texts = [w.encode("latin-1") for w in b.column(6).to_pylist()]
            for row in zip(*cols, texts, b.column(7).to_pylist(), strict=True):
                if now and row[:5] != now[0][:5]:
                    yield from closed()
                    now = []
                now.append(row)
        if now:
            yield from closed()
        yield from small(held)

    cell = ["m", "part", "key", "i", "j"]
    rows = cells.select(*cell, "own", "word", "n").repartition(*cell).sortWithinPartitions(*cell)
    return rows.mapInArrow(run, _FOUND)


def near(found: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a word one edit away."""
    rows = filed(found)
    group = ["m", "part", "key"]
    most = F.expr(f"greatest(2L, least({tile}L, {CELLS} div m))")  # of very long words fewer
    large = rows.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = stored(large.select(*group, F.ceil(F.col("size") / most).alias("blocks")), "spelling-large")
    rows = rows.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")))
    # a block meets itself and every other block of its group in a cell (i, j), i <= j
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = rows.select(*group, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "word", "n")
    each = _compare(cells)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.k")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the form's form, and so on, by pointer doubling.

    A form occurs ten times as often as its word, so chains are short and have no cycle.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        after = stored(now.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("w").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.drop("moved")


def group(docs: DataFrame, least: int = LEAST_N, times: int = TIMES, tile: int = TILE, held: int = HELD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` with at least ``least`` occurrences.

    Null texts have no words; a null doc_id enters the check sum as nothing before the
    colon. Repeated rows count again. Ties between forms go to the smaller word in
    code-point order. Runs of any length are words. Extra columns are ignored; an empty
    table gives an empty one.
    """
    tune(docs.sparkSession)
    found = stored(words(docs, held, least), "spelling-words")
    release(docs.sparkSession)
    known = stored(near(found, tile), "spelling-near")
    release(docs.sparkSession)
    out = found.join(known, "word", "left")
    takes = F.col("best_n") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Contract query: the words of all documents with their forms and roots."""
    return group(table(spark, sf_dir, "documents"))
