"""Toxicity over restored text: noisy-channel deobfuscation, then a trained score.

1. A character language model (four letters, counted over all texts) is summed up
   from partial counts of every task; its table is bounded by the alphabet.
2. Words with leetspeak, repeated letters or spaced-out letters become lattices:
   each sign offers the letters it may stand for, a run of letters one or two of
   them, a gap between single letters a join, punctuation inside a token a break
   between words. Viterbi decoding under the language model and the channel's costs
   picks the restored words; a long token is decoded in overlapping parts. Plain
   words are lattices of one path and stay as they are; numbers without a letter
   are no words. A hyphenated word counts whole and by its parts.
3. Restored words and their beginnings are scored by their log-odds in labelled
   documents; a logistic regression over a document's strongest words gives the
   score.

The model is fitted on at most ``FIT_ROWS`` labelled documents (those of the
smallest hash of their id); everything else sees all rows.
"""
from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import table, text_bytes, tune

#: labelled documents the classifier is fitted on, at most
FIT_ROWS = 20_000
#: terms of the fitted lexicon, at most (by significance)
LEXICON = 5_000
#: letters of a word's beginning that are terms of their own
BEGINNINGS = (4, 5, 6)
#: a term needs these: toxic documents, significance, toxic share among the fitted documents with it
LEAST_DOCS, LEAST_Z, LEAST_SHARE = 4, 4.0, 0.6
#: words a worker remembers before it starts anew
CACHE = 1 << 20

#: symbols of the language model: 0 between words, a to z, any other letter
LETTERS = 28
OTHER = 27
#: channel costs in nats: a sign for a letter, a sign dropped, a letter repeated, letters spaced out
SIGN, DROP, REPEAT, JOIN = 1.0, 4.0, 0.5, 0.5

# Letters that a sign stands for in leetspeak (fixed values)
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "ß": "b", "µ": "u",
}
_EDGE = re.compile(r"^[^\w$@!|+€£¡]+|[^\w$@]+$")
#: signs at a token's end that may stand for a letter or end a sentence; both readings count
_TAIL = re.compile(r"[^\W\d_].*[|+]$|[^\W\d_].*[\d@$!|+€£¡].*!$", re.S)
_PARTS = re.compile(r"[-'’]+")
_PLAIN = re.compile(r"(?:[^\W\d_]|['’-])*\Z")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(.)\1*", re.S)
_APART = re.compile(r"(?<!\S)\S(?: +\S){2,}(?!\S)")
_DASHED = re.compile(r"(?:[^\W\d_][-'’]){2,}[^\W\d_]\Z")
#: runs of equal characters of the longest word; longer tokens are decoded in overlapping parts
LONGEST = 32


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else 0


def _byte_codes() -> np.ndarray:
    """Model symbol of each byte of lower- or upper-case UTF-8; 255 for bytes inside a character."""
    t = np.zeros(256, np.uint8)
    for i in range(26):
        t[97 + i] = t[65 + i] = i + 1
    t[0xC3:0xF5] = OTHER
    t[0x80:0xC0] = 255
    return t


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of four symbols in a row, over texts that do not touch each other."""
    codes = np.insert(_byte_codes()[data], off[:-1], 0)
    codes = codes[codes != 255]
    codes = np.r_[0, 0, codes[(codes != 0) | np.r_[False, codes[:-1] != 0]], 0].astype(np.int64)
    grams = ((codes[:-3] * LETTERS + codes[1:-2]) * LETTERS + codes[2:-1]) * LETTERS + codes[3:]
    return np.bincount(grams, minlength=LETTERS ** 4)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | three symbols before it), smoothed by shorter histories."""

    def run(batches):
        total = np.zeros(LETTERS ** 4, np.int64)
        for b in batches:
            data, off = text_bytes(b.column(0))
            for lo in range(0, len(off) - 1, 200):
                part = off[lo:lo + 201]
                total += gram_counts(data[part[0]:part[-1]], part - part[0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    counts = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(LETTERS ** 4)
    for r in counts.collect():  # at most 28**4 rows whatever the input
        n[r["gram"]] = r["n"]
    n = n.reshape([LETTERS] * 4)
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + LETTERS)
    for c in (n.sum((0, 1)), n.sum(0), n):
        p = (c + 8 * p) / (c.sum(-1, keepdims=True) + 8)
    return np.log(p).astype(np.float32).reshape(-1)


class Restorer:
    """Decodes noisy words; keeps what it has decoded."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.seen: dict[str, tuple[str, ...]] = {}

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """Alternatives (letters, cost) of each run of equal characters."""
        out = []
        for m in _RUN.finditer(text):
            c, n = m[1], len(m[0])
            if c == " ":
                out.append([("", -JOIN), (" ", 0.0)])
            elif c in SIGNS and not c.isalpha():
                every = [(x, -SIGN) for x in SIGNS[c]]
                if n > 1:
                    every += [(x + x, -SIGN - REPEAT) for x in SIGNS[c]]
                out.append([*every, ("", -DROP)])
            elif not c.isalpha():
                out.append([("", -REPEAT), (" ", 0.0)])
            elif n == 1:
                out.append([(c, 0.0)] + [(x, -DROP) for x in SIGNS.get(c, "")])
            else:
                out.append([(c + c, 0.0 if n == 2 else -REPEAT), (c, -REPEAT)])
        return out

    def decode(self, text: str) -> str:
        """The best path: language model plus channel."""
        model, states = self.model, {(0, 0, 0): (0.0, "")}
        for column in self.lattice(text):
            after: dict[tuple[int, int, int], tuple[float, str]] = {}
            for (a0, b0, c0), (score, done) in states.items():
                for letters, cost in column:
                    s, a, b, c = score + cost, a0, b0, c0
                    for x in letters:
                        d = 0 if x == " " else code(x)
                        if d or c:
                            s += model[((a * LETTERS + b) * LETTERS + c) * LETTERS + d]
                            a, b, c = b, c, d
                    key = (a, b, c)
                    if key not in after or s > after[key][0]:
                        after[key] = (s, done + letters)
            states = after
        ends = [(s + (model[((a * LETTERS + b) * LETTERS + c) * LETTERS] if c else 0.0), t) for (a, b, c), (s, t) in states.items()]
        return max(ends, key=lambda x: (x[0], x[1]))[1]

    def whole(self, core: str) -> list[str]:
        """Words of a token that is no plain word: decoded, in overlapping parts if it is long."""
        runs = [m[0] for m in _RUN.finditer(core)]
        if len(runs) <= LONGEST:
            return self.decode(core).split()
        out = []
        for i in range(0, len(runs), LONGEST):
            out += self.decode("".join(runs[i:i + 2 * LONGEST])).split()
        return out

    def readings(self, core: str, token: str) -> list[str]:
        """Words of a token and its core without punctuation, of every reading that it has."""
        if _DASHED.match(core):
            found = [self.decode(core)]
        elif _PLAIN.match(core) and not _THRICE.search(core):
            parts = _PARTS.split(core)
            found = [core, *(x for x in parts if len(x) > 1)] if len(parts) > 1 else parts
        elif not any(c.isalpha() for c in core):
            found = [core]
        else:
            found = self.whole(core)
        return found + self.whole(token) if token[-1:] in "!|+" and _TAIL.search(token) else found

    def word(self, token: str) -> tuple[str, ...]:
        """The words that a lower-cased token restores to; none if nothing of it is a word."""
        got = self.seen.get(token)
        if got is None:
            core = _EDGE.sub("", token)
            if core.isalpha() and token[-1] not in "!|+" and not _THRICE.search(core):
                got = (core,)
            else:
                got = tuple(x for x in self.readings(core, token) if x)
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[token] = got
        return got

    def apart(self, text: str) -> list[str]:
        """Words restored from runs of single characters."""
        out = []
        for m in _APART.finditer(text):
            for i in range(0, len(m[0]), 4 * LONGEST):  # a long run is decoded in overlapping parts
                out += self.decode(m[0][max(0, i - 2 * LONGEST):i + 4 * LONGEST]).split()
        return out

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text."""
        low = text.lower()
        return set(chain(self.apart(low), chain.from_iterable(map(self.word, set(low.split())))))


def terms(word: str) -> list[str]:
    """The word, its beginnings, and the word without doubled letters (restored words may lack one)."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n), "~" + _RUN.sub(r"\1", word)]


def features(words: set[str], lexicon: dict[str, float], cache: dict) -> list[float]:
    """A document's strongest words: best weight, sum of the three best, words found, their share."""
    weights = []
    for w in words:
        v = cache.get(w)
        if v is None:
            v = cache[w] = max((lexicon.get(t, 0.0) for t in terms(w)), default=0.0)
            if len(cache) > CACHE:
                cache.clear()
        if v:
            weights.append(v)
    weights.sort(reverse=True)
    n = len(weights)
    return [weights[0] if n else 0.0, sum(weights[:3]) / 3, math.log1p(n), 10 * n / max(len(words), 10)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    hold = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + hold * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def held_out(col="doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, modulo five, is 0 (a null id too)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, fit_rows: int = FIT_ROWS) -> tuple[dict, np.ndarray]:
    """(lexicon, weights of the logistic regression) from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # fit_rows at most
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "label")
    sent = spark.sparkContext.broadcast(model)

    def count(batches):
        restorer, n = Restorer(sent.value), {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n.setdefault("", [0, 0])[label] += 1
                for t in {t for w in restorer.words(text) for t in terms(w)}:
                    n.setdefault(t, [0, 0])[label] += 1
        every = list(n)
        for lo in range(0, len(every), 20_000):
            part = every[lo:lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[t][0] for t in part], pa.int64()),
                                              pa.array([n[t][1] for t in part], pa.int64())], ["term", "fine", "bad"])

    counted = rows.mapInArrow(count, "term string, fine long, bad long").groupBy("term").agg(
        F.sum("fine").alias("fine"), F.sum("bad").alias("bad"))
    counted = counted.where(f"term = '' or (bad >= {LEAST_DOCS} and bad >= {LEAST_SHARE} * (bad + fine))")
    total = {"fine": 0, "bad": 0}
    found = []
    for r in counted.orderBy(F.col("term") != "", F.desc("bad"), "term").limit(20 * LEXICON).collect():
        if r["term"] == "":
            total = r.asDict()
        else:
            odds = math.log((r["bad"] + .5) / (total["bad"] + 1)) - math.log((r["fine"] + .5) / (total["fine"] + 1))
            z = odds / math.sqrt(1 / (r["bad"] + .5) + 1 / (r["fine"] + .5))
            z = max(z, odds * math.sqrt(r["bad"]) / 2) if not r["fine"] else z
            if z >= LEAST_Z:
                found.append((z, r["term"], odds))
    found.sort(key=lambda x: (-x[0], x[1]))
    lexicon = {t: w for _, t, w in found[:LEXICON]}

    def vectors(batches):
        restorer, cache = Restorer(sent.value), {}
        for b in batches:
            x = [features(restorer.words(t), lexicon, cache) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    got = sorted((tuple(r["x"]), r["label"]) for r in rows.mapInArrow(vectors, "x array<double>, label int").collect())
    x = np.array([v for v, _ in got]).reshape(-1, 4)
    y = np.array([v for _, v in got], float)
    return lexicon, logistic(x, y) if len(y) else np.array([0, 0, 0, 0, -3.0])


def scorer(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """A function from texts to scores, for the tasks; language model, lexicon and weights are broadcast."""
    model = language_model(docs)
    lexicon, weights = fit(docs, labels, model, fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model, lexicon, weights))

    def scores(batches_of_texts):
        model, lexicon, weights = sent.value
        restorer, cache = Restorer(model), {}
        for texts in batches_of_texts:
            x = np.array([features(restorer.words(t or ""), lexicon, cache) for t in texts]).reshape(-1, 4)
            yield 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))

    return scores


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of a document without a toxic word. Labels
    other than 0 and 1, of null ids, or of ids without a document teach nothing;
    an id with both labels counts as 1. Without any label every score is low.
    Repeated rows give repeated rows. Extra columns are ignored.
    """
    tune(docs.sparkSession)
    scores = scorer(docs, labels, fit_rows)

    def run(batches):
        ids = []

        def texts():
            for b in batches:
                ids.append(b.column(0))
                yield b.column(1).to_pylist()

        for s in scores(texts()):
            yield pa.RecordBatch.from_arrays([ids.pop(), pa.array(s)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's score, learned outside the held-out fold."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that are not predicted toxic, as they are."""
    tune(spark)
    scores = scorer(docs, table(spark, sf_dir, "labels"))
    text = docs.columns.index("text")

    def run(batches):
        held = []

        def texts():
            for b in batches:
                held.append(b)
                yield b.column(text).to_pylist()

        for s in scores(texts()):
            yield held.pop().filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
