"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Every document is measured in one scan; a few plain rules reject the hopeless.
For the others four statistics are transformed (mean word length, share of
symbols, repeated lines, share of repeated words), and for each language and
source a minimum-covariance-determinant estimate is found: from four deterministic
starts (medians and absolute deviations, plain moments, hyperbolic tangents and
spatial signs of the standardised rows), concentration steps keep the three quarters
of the rows nearest to the present mean and covariance and estimate anew; after two
steps the start of the least determinant goes on until nothing changes. Its reweighted
estimate gives the Mahalanobis distances by which documents are rejected.

Steps are partial aggregates over a narrow table, joined with one row per group.
The quantile of a step comes from a histogram of the distances' logarithms, so a
group with a third of all rows is never gathered anywhere.
"""
from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table, tune

#: rules: fewer words, and a larger percentage of words in repeated windows, fail
LEAST_WORDS, MOST_REPEATED = 50, 50
#: rows that a group needs for an estimate of its own
GROUP = 50
#: share of the rows that a concentration step keeps
KEPT = 0.75
#: concentration steps of all starts; further steps of the best one, at most (then ``settled`` is false)
FIRST, STEPS = 2, 30
#: consistency factor of the covariance of the nearest three quarters, four normal statistics
CONSISTENT = 1.485
#: squared distances, quantiles of chi-squared with four degrees: 0.975 counts for the reweighted
#: estimate, beyond 0.999 a document is rejected
WEIGHTED, CUTOFF = 11.143, 18.467
#: statistics: expression, and a harmless difference from the group's centre. A standard deviation is at least
#: so large that the statistic alone rejects only beyond it: a quarter of the mean word length, 1.5 symbols in
#: a hundred characters, 6 repeated lines, a quarter of the words repeated.
STATS = {
    "x0": ("ln(word_chars / n_words)", math.log(1.25)),
    "x1": ("ln(1 + 100 * n_symbols / word_chars)", math.log(1 + 1.5)),
    "x2": ("ln(1 + n_dup_lines)", math.log(1 + 6)),
    "x3": ("ln(1 + 100 * n_repeat_words / n_words)", math.log(1 + 25)),
}
LEAST = [harmless / math.sqrt(CUTOFF) for _, harmless in STATS.values()]
X = list(STATS)
PAIRS = list(combinations_with_replacement(range(len(X)), 2))
#: bits of a packed window hash that hold its position
PLACE = 28
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are found within the row: the hashes of all three-word
    windows, each with its place in the low bits, are sorted; neighbours of the
    same hash are compared word by word, and the places of repeated windows are
    summed up to covered words.
    """
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "source",
                 F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"),
                 F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
                 (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    here, size = f"{(1 << PLACE) - 1}L", "size(w)"
    d = d.select("*", F.expr(f"""
        case when {size} < 3 then cast(array() as array<bigint>) else
        sort_array(transform(sequence(0, {size} - 3), i ->
            shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {PLACE}) | cast(i as bigint))) end""").alias("s"))

    def same(other: str) -> str:
        p, q = f"cast(x & {here} as int)", f"cast(get(s, {other}) & {here} as int)"
        words = " and ".join(f"w[{p} + {k}] = w[{q} + {k}]" for k in range(3))
        return f"(shiftright(get(s, {other}), {PLACE}) = shiftright(x, {PLACE}) and {words})"

    repeated = " or ".join(same(o) for o in ("j - 1", "j + 1", "j - 2", "j + 2"))
    d = d.select("*", F.expr(f"sort_array(transform(filter(s, (x, j) -> {repeated}), x -> x & {here}))").alias("p")).drop("s")
    return d.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""case when size(p) = 0 then 0L else
            aggregate(sequence(1, size(p) - 1), 3L, (a, k) -> a + least(3L, p[k] - p[k - 1])) end""").alias("n_repeat_words"))


def ruled(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the transformed statistics and the document's group."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    d = stats.withColumn("base_failed", failed)
    return d.select("*", *(F.when(~F.col("base_failed"), F.expr(e)).alias(x) for x, (e, _) in STATS.items()),
                    F.to_json(F.struct("lang", "source")).alias("own"), F.to_json(F.struct("lang")).alias("pool"))


def grouped(rows: DataFrame, least: int = GROUP) -> DataFrame:
    """(own, key): the group whose estimate judges documents of ``own``.

    Languages and sources with fewer than ``least`` documents are pooled by
    language, and pools still smaller into one.
    """
    n = rows.groupBy("own", "pool").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < least).groupBy("pool").agg(F.sum("n").alias("m"))
    return n.join(small, "pool", "left").select("own", F.when(F.col("n") >= least, F.col("own")).when(
        F.col("m") >= least, F.concat(F.lit("pool "), "pool")).otherwise("rest").alias("key"))


def _estimate(rows: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Means and covariances of the rows, as one row per group."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)),
        *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS))
    return _cholesky(sums.select(
        *by, "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(X))),
        *(((F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")) * factor).alias(f"c{i}{j}")
          for i, j in PAIRS)), by)


def _cholesky(moments: DataFrame, by: list[str]) -> DataFrame:
    """m0.., l00.. (lower triangle) and the log-determinant.

    No variance is less than its least, given the statistics before it: rows on a line,
    such as clean ones and one kind of junk, are no small determinant.
    """
    d = moments
    for j in range(len(X)):
        for i in range(j, len(X)):
            v = F.col(f"c{j}{i}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(LEAST[i] ** 2))) if i == j else v / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(1, len(X))), F.log("l00"))
    names = [f"m{i}" for i in range(len(X))] + [f"l{i}{j}" for j, i in PAIRS]
    return d.select(*by, "n", *names, (2 * det).alias("det"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row to the estimate joined to it."""
    z: list[Column] = []
    for i, x in enumerate(X):
        v = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _near(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The rows of each group and start nearest to its estimate, at least KEPT of them."""
    far = rows.join(estimate.drop("n"), ["key", "start"]).withColumn(
        "bin", F.floor(F.log2(distance() + 1e-6) * 64).cast("int")).select("key", "start", "bin", *X)
    bins = far.groupBy("key", "start", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("key", "start")  # at most some thousand bins, however many rows
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    # stored: one row a group and start, so that the rows need no shuffle to meet it
    last = stored(bins.where(F.col("upto") >= F.col("all") * KEPT).groupBy("key", "start").agg(F.min("bin").alias("last")), "mcd-last")
    return far.join(last, ["key", "start"]).where("bin <= last")


def _starts(rows: DataFrame) -> DataFrame:
    """The four first estimates of each group."""
    by, n = ["key", "start"], len(X)
    median = rows.groupBy("key").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)))
    median = stored(median, "mcd-medians")
    spread = rows.join(median, "key").groupBy("key").agg(F.count("*").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(n)), *(
        F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, x in enumerate(X)))
    spread = stored(spread.select("key", "n", *(f"m{i}" for i in range(n)), *(
        F.greatest(F.col(f"a{i}") * 1.4826, F.lit(LEAST[i])).alias(f"a{i}") for i in range(n))), "mcd-spread")
    centre = ["key", *(f"m{i}" for i in range(n))]
    robust = spread.select(*centre, F.lit(0).alias("start"), "n", *(
        (F.pow(f"a{i}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    z = rows.join(spread, "key").select(*centre, "n", *(f"a{i}" for i in range(n)), *(
        ((F.col(x) - F.col(f"m{i}")) / F.col(f"a{i}")).alias(f"z{i}") for i, x in enumerate(X)))
    z = z.withColumn("norm", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, n)), F.col("z0") * F.col("z0")))
    shaped = z.groupBy(*centre, "n", *(f"a{i}" for i in range(n))).agg(
        *(F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS),
        *(F.avg(F.when(F.col("norm") > 0, F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).otherwise(0.0) * n).alias(f"g{i}{j}") for i, j in PAIRS))
    others = [shaped.select(*centre, F.lit(k).alias("start"), "n", *(
        (F.col(f"{c}{i}{j}") * F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i, j in PAIRS)) for k, c in ((2, "t"), (3, "g"))]
    shapes = _cholesky(robust.unionByName(others[0]).unionByName(others[1]), by)
    return shapes.unionByName(_estimate(rows.withColumn("start", F.lit(1)), by, 1.0))


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each ``key`` of rows (key, x0..).

    ``settled`` is false where the determinant still changed in the last step.
    """
    by = ["key", "start"]
    now = stored(_starts(rows), "mcd")
    every = rows.withColumn("start", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    for _ in range(FIRST):
        now = stored(_estimate(_near(every, now), by, 1.0), "mcd")
    best = now.groupBy("key").agg(F.min_by(F.struct(*(c for c in now.columns if c not in by)), F.struct("det", "start")).alias("b"))
    now = stored(best.select("key", F.lit(0).alias("start"), "b.*"), "mcd")
    one = rows.withColumn("start", F.lit(0))
    for _ in range(max(steps, 1)):
        before = now.select("key", F.col("det").alias("was"))
        now = _estimate(_near(one, now.drop("settled")), by, 1.0).join(before, "key")
        now = stored(now.withColumn("settled", F.abs(F.col("det") - F.col("was")) < 1e-6).drop("was"), "mcd")
        if now.where("not settled").isEmpty():
            break
    raw = now.select("key", "n", "settled", *(c for c in now.columns if c[0] == "m"), *(
        (F.col(c) * math.sqrt(CONSISTENT)).alias(c) for c in now.columns if c[0] == "l"))
    weighted = rows.join(raw.drop("n", "settled"), "key").where(distance() <= WEIGHTED).select("key", *X)
    return stored(_estimate(weighted, ["key"], 1.0).join(raw.select("key", "settled"), "key"), "mcd")


def judge(docs: DataFrame, least: int = GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, base_failed, distance and kept of every row of ``docs``.

    Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, distance (squared; null where the rules failed), kept, and
    settled (whether the estimate of the document's group no longer changed).
    Null texts have no words and fail. Null languages and sources are groups like
    any other; a null doc_id is kept as null; repeated rows give repeated rows.
    Groups under ``least`` rows are pooled, see :func:`grouped`; a pool that is
    small itself is judged by its own rows, under the least deviations of STATS, which
    also serve constant statistics. Extra columns are ignored; an empty table gives an
    empty one.
    """
    tune(docs.sparkSession)
    rows = stored(ruled(measured(docs)), "quality")
    good = rows.where("not base_failed")
    key = stored(grouped(good, least), "quality-groups")
    found = estimates(good.join(key, "own").select("key", *X))
    judged = key.join(found.drop("n", "det"), "key").drop("key")
    out = rows.join(judged, "own", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "settled",
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's statistics and verdict."""
    return judge(table(spark, sf_dir, "documents"))
