"""How far the sources of a language differ, in exact integers.

Tokenizer: one ``bytes.translate`` lowers A-Z and blanks every ASCII byte that is
no letter, ``bytes.split`` gives the terms, and a Counter of each document gives
its counts; every distinct term also counts one document. Tasks merge Counters and
send sparse partial counts, so a term costs a row per task and source however
often it occurs.

Terms in at least ``LEAST_DOCS`` documents of a language make its vocabulary of V
terms. A source gives a term p = 1 + floor(10^9 (count + 2) / (N + 2V)), and two
distributions differ by the sum of floor((p - q)^2 / (p + q)).

That sum runs over the whole vocabulary, yet only terms that occur are ever held:
with p0 the value of a term that a source lacks, and f the summand,

    sum f(p, q) = sum over a's terms of f(p, q0) + sum over b's terms of f(p0, q)
                + (V - |a| - |b|) f(p0, q0)
                + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first two sums come from counts of equal values of p, the last from the terms'
short lists of sources, summed up per pair of sources inside each task.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import release, stored, table, tune

#: documents of a language that hold a kept term, at least
LEAST_DOCS = 10
#: scale of the probabilities, and what is added to every count
SCALE, PRIOR = 1_000_000_000, 2
#: terms reported for each source
TOP = 10
#: terms, or pairs of sources, that a task holds before it sends partial counts
HELD = 400_000
#: rows of one batch that a task sends or works on
ROWS = 20_000

#: letters of any script stay, A-Z are lowered, all else is a separator
LOWER = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The lower-cased terms of UTF-8 text, in order."""
    return text.translate(LOWER).split()


def counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of ``docs`` (lang, source, text): many rows a term."""

    def sent(found: dict):
        for (lang, source), (n, docs) in found.items():
            every = list(n)
            for i in range(0, len(every), ROWS):
                part = every[i:i + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()),
                     pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        found: dict[tuple[str, str], tuple[dict, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                one = Counter(terms(text))
                group = found.get((lang, source))
                if group is None:
                    group = found[lang, source] = ({}, Counter())
                n, docs = group
                size -= len(n)
                seen = n.get
                for t, k in one.items():
                    n[t] = seen(t, 0) + k
                docs.update(one.keys())
                size += len(n)
                if size > held:
                    yield from sent(found)
                    found, size = {}, 0
        yield from sent(found)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _p(n: str | int, total: str) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR v)), exact at any count."""
    return F.expr(f"1 + (cast({n} + {PRIOR} as decimal(28, 0)) * {SCALE}) div cast({total} + {PRIOR} * v as decimal(28, 0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def profile(docs: DataFrame, least: int = LEAST_DOCS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(groups, kept): each source with N, V and p0; its kept terms with n, p and the language's q."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = counts(d, held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stored(found, "divergence-counts")
    release(docs.sparkSession)
    words = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least)
    kept = stored(found.select("lang", "source", "term", "n").join(words.select("lang", "term", "n_lang"), ["lang", "term"]), "divergence-kept")
    release(docs.sparkSession)
    size = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = d.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(size, "lang", "left").join(own, ["lang", "source"], "left")
    groups = stored(groups.na.fill(0, ["v", "total_lang", "total", "held"]).withColumn("p0", F.when(F.col("v") > 0, _p(0, "total"))), "divergence-groups")
    facts = groups.select("lang", "source", "v", "total", "total_lang", "p0")
    kept = kept.join(facts, ["lang", "source"]).select("lang", "source", "term", "n", _p("n", "total").alias("p"), "p0", _p("n_lang", "total_lang").alias("q"))
    return groups, stored(kept, "divergence-p")


def _shared(kept: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, a, b, c): over the terms that sources a < b share, the sum of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)."""

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        """True at the first row of each term."""
        other = pc.or_(pc.not_equal(rows.column(0)[1:], rows.column(0)[:-1]), pc.not_equal(rows.column(1)[1:], rows.column(1)[:-1]))
        return np.r_[True, other.to_numpy(zero_copy_only=False)]

    def solve(rows: pa.RecordBatch, total: dict):
        if not rows.num_rows:
            return
        lang, source = (rows.column(i).dictionary_encode() for i in (0, 2))
        which, code = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        langs, names = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        p, p0 = (rows.column(i).to_numpy() for i in (3, 4))
        group = np.cumsum(starts(rows))
        for d in range(1, int(np.bincount(group).max())):  # a term's sources in order: pairs at distance d
            i = np.flatnonzero(group[d:] == group[:-d])
            j = i + d
            c = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            pair, back = np.unique((which[i] * len(names) + code[i]) * len(names) + code[j], return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, back, c)
            for k, x in zip(pair.tolist(), sums.tolist(), strict=True):
                key = (langs[k // len(names) // len(names)], names[k // len(names) % len(names)], names[k % len(names)])
                total[key] = total.get(key, 0) + x

    def sent(total: dict):
        every = list(total)
        for i in range(0, len(every), ROWS):
            part = every[i:i + ROWS]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[x] for k in part], pa.string()) for x in range(3)), pa.array([total[k] for k in part], pa.int64())],
                                             ["lang", "a", "b", "c"])

    def run(batches):
        rest, total = None, {}
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            n = int(np.flatnonzero(starts(b))[-1])  # the next batch may go on with the last term
            solve(b.slice(0, n), total)
            rest = b.slice(n)
            if len(total) > held:
                yield from sent(total)
                total = {}
        if rest is not None:
            solve(rest, total)
        yield from sent(total)

    rows = kept.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = rows.mapInArrow(run, "lang string, a string, b string, c long")
    return found.groupBy("lang", "a", "b").agg(F.sum("c").alias("c"))


def pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every two sources of a language, both ways."""
    one = groups.select("lang", F.col("source").alias("a"), "v", F.col("held").alias("held_a"), F.col("p0").alias("a0"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("held").alias("held_b"), F.col("p0").alias("b0"))
    equal = kept.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))
    half = equal.join(two.select("lang", "b", "b0"), "lang").groupBy("lang", "a", "b").agg(F.expr(f"sum(m * {_f('p', 'b0')})").alias("s"))
    both = one.join(two, "lang").where("a < b")
    both = both.join(half.withColumnRenamed("s", "sa"), ["lang", "a", "b"], "left")
    both = both.join(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("s").alias("sb")), ["lang", "a", "b"], "left")
    both = both.join(_shared(kept), ["lang", "a", "b"], "left")
    value = F.expr(f"case when v = 0 then 0L else coalesce(sa, 0L) + coalesce(sb, 0L) + (v - held_a - held_b) * {_f('a0', 'b0')} + coalesce(c, 0L) end")
    both = both.select("lang", "a", "b", value.alias("value"))
    return both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others and from its language.

    Part ``pair``: every other source of the language with the divergence, all
    ranks. Part ``term``: the ``top`` terms that the source uses more than its
    language does. Null lang, source and text are read as ''. Every row counts as a
    document, repeated ones too; doc_id is not read, so null or repeated ids change
    nothing. Sources without any term differ like sources of zero counts; a language
    without kept terms has pairs of value 0 and no term rows; ties are ranked by item.
    Extra columns are ignored; an empty table gives an empty one. All values are exact
    integers: they do not depend on partitions.
    """
    tune(docs.sparkSession)
    groups, kept = profile(docs, least, held)
    over = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    apart = pairs(groups, kept).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return over.unionByName(apart.withColumn("rank", F.row_number().over(by)))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract query: the audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (
  select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
c as (select lang, source, term, count(*)::hugeint as n, count(distinct r) as docs from w group by all),
k as (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= {LEAST_DOCS}),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by all),
g as (select distinct lang, source from d),
gt as (select g.lang, g.source, k.term, k.n as n_lang, coalesce(c.n, 0)::hugeint as n
       from g join k using (lang) left join c using (lang, source, term)),
t as (select lang, source, sum(n)::hugeint as total from gt group by all),
p as (select gt.lang, gt.source, gt.term, gt.n, 1 + {SCALE}::hugeint * (gt.n + {PRIOR}) // (t.total + {PRIOR} * v.v) as p,
        1 + {SCALE}::hugeint * (gt.n_lang + {PRIOR}) // (v.total + {PRIOR} * v.v) as q
      from gt join t using (lang, source) join v using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
items as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from items)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
