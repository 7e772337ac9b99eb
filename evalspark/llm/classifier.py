"""Quality classifier: a regularised quadratic discriminant over document statistics.

1. Every whole text is measured once (``STATISTICS``): word and line counts, word
   length, shares of upper case, digits, punctuation and symbols, repeated words,
   phrases and lines, sentence ends. Counts enter as logarithms, shares as arcsines of
   their square roots, so that both have steadier variances.
2. The classes' means and covariances are aggregates over all labelled rows outside
   the held-out fold: sufficient statistics, so no sample is drawn. Each covariance is
   shrunk towards the pooled one and then towards a multiple of the identity.
3. The Cholesky factors of the two covariances, inverted once, go with the tasks; a
   score is the logistic of the difference of the two log densities (half the
   squared Mahalanobis distance and the log determinant) plus the log odds of the labels.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table, tune

#: share of the pooled covariance, and of the multiple of the identity, in a class's covariance
POOLED, ROUND = 0.1, 0.02
#: score from which a document counts as label 1
THRESHOLD = 0.3
#: words of a repeated phrase
PHRASE = 3

#: kinds of bytes: 0 other letters, 1 a-z, 2 A-Z, 3 digits, 4 punctuation, 5 symbols, 6 white space, 7 inside a character
_PUNCTUATION = b".,;:!?'\"()-"
KINDS = 8
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _kinds() -> np.ndarray:
    t = np.full(256, 5, np.uint8)
    t[0xC0:] = 0
    t[0x80:0xC0] = 7
    t[97:123] = 1
    t[65:91] = 2
    t[48:58] = 3
    t[list(_PUNCTUATION)] = 4
    t[[32, *range(9, 14)]] = 6
    return t


_KIND = _kinds()

STATISTICS = ("words", "word_length", "words_a_line", "upper", "digits", "punctuation", "symbols", "exclamations",
              "repeated_words", "commonest_word", "repeated_phrases", "repeated_lines", "sentence_ends")
D = len(STATISTICS)


def _phrases(words: list[str]) -> tuple[int, int]:
    """(phrases, different phrases), by a hash of the words' numbers."""
    n = len(words) - PHRASE + 1
    if n < 1:
        return 0, 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        code = (code ^ ids[k:n + k]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    return n, len(np.unique(code))


def _arc(part: float, whole: float) -> float:
    return math.asin(math.sqrt(min(part / whole, 1.0))) if whole else 0.0


def measure(text: str) -> list[float]:
    """The transformed statistics of a whole text (an empty one: zeros)."""
    raw = text.encode("utf-8", "surrogatepass")
    kind = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=KINDS)
    words = [w for w in _SPACE.split(text) if w]
    if not words:
        return [0.0] * D
    n, chars = len(words), int(kind[:6].sum())
    letters = int(kind[:3].sum())
    often: dict[str, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    phrases, different = _phrases(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(w[-1] in ".?!" for w in words)
    return [math.log1p(n), math.log(chars / n + 1), math.log(n / max(len(lines), 1)), _arc(int(kind[2]), letters), _arc(int(kind[3]), chars),
            _arc(int(kind[4]), chars), _arc(int(kind[5]), chars), _arc(raw.count(b"!"), chars), _arc(n - len(often), n), _arc(max(often.values()), n),
            _arc(phrases - different, phrases), _arc(len(lines) - len(set(lines)), len(lines)), _arc(ends, n)]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches):
        for b in batches:
            x = [measure(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def held_out(col: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, modulo five, is 0 (a null id too)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """label -> (n, sums, sums of products) of ``rows`` (label, x): one row a class comes to the driver."""
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    flat = rows.select("label", *(F.col("x")[i].alias(f"x{i}") for i in range(D)))
    sums = flat.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(D)),
                                     *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs))
    out = {}
    for r in sums.collect():
        q = np.zeros((D, D))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(D)]), q)
    return out


class Discriminant:
    """Means, inverted Cholesky factors and log determinants of the two classes, and the log odds of the labels."""

    def __init__(self, found: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, around: float = ROUND):
        n = [found[k][0] if k in found else 0 for k in (0, 1)]
        self.odds = math.log((n[1] + 1) / (n[0] + 1))
        self.both = all(n)
        if not self.both:
            return
        self.mean = [found[k][1] / n[k] for k in (0, 1)]
        own = [found[k][2] / n[k] - np.outer(self.mean[k], self.mean[k]) for k in (0, 1)]
        shared = (n[0] * own[0] + n[1] * own[1]) / sum(n)
        self.back, self.log_det = [], []
        for c in own:
            c = (1 - pooled) * c + pooled * shared
            c = (1 - around) * c + around * max(np.trace(c) / D, 1e-6) * np.eye(D)
            lower = np.linalg.cholesky(c)
            self.back.append(np.linalg.inv(lower))
            self.log_det.append(2 * float(np.log(np.diag(lower)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of statistics. Without documents of both labels only the odds count."""
        z = np.full(len(x), self.odds)
        if self.both:
            density = []
            for k in (0, 1):
                y = (x - self.mean[k]) @ self.back[k].T
                density.append(-0.5 * ((y * y).sum(1) + self.log_det[k]))
            z += density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, around: float = ROUND) -> Discriminant:
    """The discriminant of the labelled rows outside the held-out fold; statistics alone are joined, no texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return Discriminant(moments(stats.join(known, "doc_id")), pooled, around)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, pooled: float = POOLED, around: float = ROUND) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts are scored like any other, by statistics of zero. Labels other
    than 0 and 1, of null ids, or of ids without a document teach nothing; an id with
    both labels counts as 1; of repeated rows each teaches. Without any label every
    score is 0.5; with labels of one kind all are (n1 + 1) / (n0 + n1 + 2). A null
    doc_id is held out. Repeated rows give repeated rows. Extra columns are ignored; an
    empty table gives an empty one.
    """
    tune(docs.sparkSession)
    stats = stored(statistics(docs), "classifier")
    model = fit(stats, labels, pooled, around)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's score, learned outside the held-out fold."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
