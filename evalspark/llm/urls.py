"""URL filters: stated rules first, then association rules mined from labels.

Stated rules (host and path prefix) win by length. All other urls are judged by
rules that FP-growth finds in labelled urls: combinations of url tokens (host
labels, path segments with digits folded, query keys) that imply a bad label with
enough support and confidence. A rule that contains a shorter one of no less
confidence is pruned.

Matching goes through an inverted index: each mined rule stands under its rarest
token, the distinct token sets of all urls are joined to it by token and checked
for the rest of the rule. Urls share their token sets, so the work grows with the
distinct sets, and a host with a third of all urls is one row.

Everything is DataFrame operations and the JVM's FP-growth.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table, tune, width_for

#: labelled urls a rule must hold for (share of them, and number), and its least confidence
SUPPORT, LEAST_URLS, CONFIDENCE = 0.002, 20, 0.8
#: what FP-growth calls a bad label
BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Stated rules: host, path, verdict (fixed values of the contract)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def parts(urls: DataFrame) -> DataFrame:
    """Adds url_host and url_path: after the first '://', A-Z of the host lower-cased; else empty."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    d = urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
    d = d.withColumn("_raw", F.regexp_extract("_rest", "^[^/?#]*", 0))
    return d.withColumn("url_host", F.translate("_raw", UPPER, LOWER)).withColumn(
        "url_path", F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), "^[^?#]*", 0)).withColumn(
        "url_query", F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), r"\?([^#]*)", 1)).drop("_rest", "_raw")


def tokens() -> Column:
    """Sorted distinct tokens of a url: what FP-growth combines."""
    def marked(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    fold = F.regexp_replace(F.lower("url_path"), "[0-9]+", "0")
    return F.array_sort(F.array_distinct(F.concat(
        marked("site:", F.array("url_host")), marked("host:", F.split("url_host", r"\.")), marked("path:", F.split(fold, "/")),
        marked("key:", F.regexp_extract_all("url_query", F.lit("([^&=]+)="), 1)))))


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST_URLS, confidence: float = CONFIDENCE) -> DataFrame:
    """Mined rules (pattern, confidence, urls, token) from (tokens, bad); ``token`` is the rarest one.

    Rows with a null label teach nothing; without labelled urls there are no rules.
    """
    spark = labelled.sparkSession
    seen = stored(labelled.where("bad is not null").select(
        "tokens", "bad", F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "urls-labelled")
    n = seen.count()
    if not n:
        return seen.select(F.col("tokens").alias("pattern"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("urls"),
                           F.lit("").alias("token")).limit(0)
    share = min(1.0, max(support, least / n))
    parts_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), width_for(n, 1_000_000))
    # a rule needs its tokens in bad urls, so tokens of good ones alone need not be mined
    useful = seen.where("bad").select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(
        F.col("n") >= share * n * confidence).select("token")
    kept = seen.select(F.monotonically_increasing_id().alias("row"), "items")
    kept = stored(kept, "urls-items")
    one = kept.select("row", F.explode("items").alias("token"))
    one = one.join(useful.unionAll(spark.range(1).select(F.lit(BAD).alias("token"))), "token", "left_semi")
    items = stored(kept.select("row").join(one.groupBy("row").agg(F.collect_list("token").alias("items")), "row", "left").select(
        F.coalesce("items", F.array().cast("array<string>")).alias("items")), "urls-frequent")
    model = FPGrowth(itemsCol="items", minSupport=share * confidence, minConfidence=confidence, numPartitions=parts_).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("pattern"), "confidence", F.round(F.col("support") * n / F.col("confidence")).cast("long").alias("urls"))
    rules = stored(rules.where(F.col("urls") >= share * n - 1e-6), "urls-rules")
    # prune: a longer rule that a shorter one of no less confidence covers says nothing new
    by = rules.select(F.col("pattern").alias("short"), F.col("confidence").alias("sure"), F.col("pattern")[0].alias("token"))
    long = rules.select("pattern", "confidence", F.explode("pattern").alias("token"))
    covered = long.join(by, "token").where(
        (F.size("short") < F.size("pattern")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("short", "pattern")) == 0))
    rules = rules.join(covered.select("pattern").distinct(), "pattern", "left_anti")
    often = seen.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = rules.select("pattern", F.explode("pattern").alias("token")).join(often, "token").groupBy("pattern").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"))
    return stored(rules.join(rare, "pattern"), "urls-index")


def matched(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens, mined, confidence): the surest mined rule of each token set that has one."""
    each = sets.select("tokens", F.explode("tokens").alias("token"))
    hit = each.join(index, "token").where(F.size(F.array_except("pattern", "tokens")) == 0)
    return hit.groupBy("tokens").agg(
        F.max("confidence").alias("confidence"),
        F.max_by(F.array_join("pattern", " "), F.struct("confidence", "urls", F.array_join("pattern", " "))).alias("mined"))


def stated(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_host, rules): the stated rules that fit each distinct host, for its paths to choose from."""
    names = F.split("url_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    each = hosts.select("url_host", F.explode(ends).alias("host"))
    return each.join(rules, "host").groupBy("url_host").agg(F.collect_set(F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("rules"))


def judge(urls: DataFrame, labels: DataFrame, rules: DataFrame, default: str = "allow", support: float = SUPPORT,
          least: int = LEAST_URLS, confidence: float = CONFIDENCE) -> DataFrame:
    """Every row of ``urls`` with url_host, url_path, rule, verdict, mined, confidence.

    ``labels`` has (url, bad), any number of rows a url; ``rules`` has (host, path,
    verdict). ``rule`` is the longest stated rule that fits, null if none does; its
    verdict holds. Else a mined rule blocks, and all other urls get ``default``. A
    null url, or one without '://', has an empty host and path. Rows, ids and
    columns stay as they are, but columns named like the added ones are replaced.
    """
    tune(urls.sparkSession)
    added = ("url_host", "url_path", "url_query", "rule", "rules", "verdict", "mined", "confidence", "tokens", "_rest", "_raw", "_best")
    d = parts(urls.drop(*added)).withColumn("tokens", tokens())
    index = mine(parts(labels.select("url", "bad")).select(tokens().alias("tokens"), "bad"), support, least, confidence)
    hosts = stated(d.select("url_host").distinct(), rules.distinct())
    found = matched(d.select("tokens").distinct(), index)
    d = d.join(hosts, "url_host", "left").join(found, "tokens", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("url_path"), r["path"])))
    return d.withColumn("_best", best).select(
        *urls.drop(*added).columns, "url_host", "url_path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(F.col("mined").isNotNull(), "block"), F.lit(default)).alias("verdict"),
        "mined", "confidence")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Stated rules as a table (host, path, verdict)."""
    each = [F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def op1_urls(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page's url judged.

    A page shows the document whose number its url's path ends in; that
    document's label (low quality or toxic: bad) is the url's label.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#][^/]*)?$", 1)
    numbered = pages.where(number != "").select("url", number.cast("long").alias("doc_id"))
    marks = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules = rule_table(spark, RULES)
    out = judge(pages, numbered.join(marks, "doc_id"), rules)
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), "rule", "verdict", "mined", "confidence")
