"""Readers for chat-export files -> raw prompt records.

Each reader is two steps: ``read_documents`` (one row per file: path, text —
Spark lists and reads the files in parallel; one task per file) and a
``parse_*`` function from that document DataFrame to raw prompt records
(content, source, source_ref, created_at, metadata, order). A document is cut
into its conversations first (``records``), so its size is no limit; parsing
uses Spark's VARIANT type so the lenient "try this key, then that one" rules are
plain column expressions. ``rejects`` lists every file that is not one JSON
value and every record too long to parse, with the reason.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.judges import strip_ws
from evalspark.functions.text import epoch_to_timestamp, parse_timestamp
from evalspark.sources.records import records

ARR = "array<variant>"


def rejects(docs: DataFrame, kind: str) -> DataFrame:
    """(path, record, reason) of what a reader of this kind cannot read."""
    return records(docs, kind).where("reject is not null").select("path", F.col("base").alias("record"), F.col("reject").alias("reason"))


def _records(docs: DataFrame, kind: str) -> DataFrame:
    return records(docs, kind).where("reject is null")


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Whole files under ``path`` (recursive) as (path, text)."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("path"),
                     F.col("value").alias("text"))


# ---------------------------------------------------------------- variant helpers

def _t(x: Column) -> Column:
    return F.schema_of_variant(x)


def field(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", "variant")


def is_object(x: Column) -> Column:
    return F.coalesce(_t(x).startswith("OBJECT"), F.lit(False))


def str_field(x: Column, key: str) -> Column:
    """Field value when it is a JSON string, else NULL."""
    f = field(x, key)
    return F.when(_t(f) == "STRING", F.try_variant_get(f, "$", "string"))


def truthy_text(x: Column, key: str) -> Column:
    """Python truthiness of a scalar field rendered as text ('' / 0 / null -> NULL)."""
    f = field(x, key)
    s = F.try_variant_get(f, "$", "string")
    falsy = (s == "") | (s == "0") | (s == "false") | (_t(f) == "VOID") | _t(f).startswith("ARRAY") \
        | _t(f).startswith("OBJECT")
    return F.when(~F.coalesce(falsy, F.lit(True)), s)


def is_truthy(f: Column) -> Column:
    """Python truthiness of a variant value (None, '', 0, false, [] and {} are falsy)."""
    t = _t(f)
    s = F.try_variant_get(f, "$", "string")
    arr = F.size(F.try_variant_get(f, "$", ARR))
    obj = F.size(F.try_variant_get(f, "$", "map<string,variant>"))
    return F.coalesce(F.when(t.startswith("ARRAY"), arr > 0)
                       .when(t.startswith("OBJECT"), obj > 0)
                       .when(t == "VOID", F.lit(False))
                       .otherwise(~((s == "") | (s == "0") | (s == "false") | (s == "0.0"))), F.lit(False))


def first_text(x: Column, *keys: str) -> Column:
    """``a or b or ...`` over scalar fields."""
    return F.coalesce(*[truthy_text(x, k) for k in keys])


def list_field(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", ARR)


def first_nonempty_list(x: Column, *keys: str) -> Column:
    return F.coalesce(*[F.when(F.size(list_field(x, k)) > 0, list_field(x, k)) for k in keys])


def ts_field(x: Column, *keys: str) -> Column:
    """First truthy of ``keys``: a number is epoch s (ms if > 1e10), a string ISO."""
    outs = []
    for k in keys:
        f = field(x, k)
        t = _t(f)
        num = t.isin("INT", "BIGINT", "DOUBLE", "FLOAT", "SMALLINT", "TINYINT") | t.startswith("DECIMAL")
        outs.append(F.when(num & (F.try_variant_get(f, "$", "double") != 0),
                           epoch_to_timestamp(F.try_variant_get(f, "$", "double")))
                     .when(t == "STRING", parse_timestamp(F.try_variant_get(f, "$", "string"))))
    # Python picks the first *truthy* value, then parses it (a bad string gives None)
    pick = None
    for k, o in reversed(list(zip(keys, outs))):
        truthy = truthy_text(x, k).isNotNull()
        pick = F.when(truthy, o) if pick is None else F.when(truthy, o).otherwise(pick)
    return pick


def iso_only_ts(x: Column, *keys: str) -> Column:
    """First truthy field parsed as ISO text only (numbers give NULL)."""
    pick = None
    for k in reversed(keys):
        f = field(x, k)
        v = F.when(_t(f) == "STRING", parse_timestamp(F.try_variant_get(f, "$", "string")))
        truthy = truthy_text(x, k).isNotNull()
        pick = F.when(truthy, v) if pick is None else F.when(truthy, v).otherwise(pick)
    return pick


def _raw(df: DataFrame, content: Column, source: str, ref: Column, created: Column,
         meta: Column, order: Column) -> DataFrame:
    return df.select(content.alias("content"), F.lit(source).alias("source"), ref.alias("source_ref"),
                     created.cast("timestamp").alias("created_at"), F.to_json(meta).alias("metadata"),
                     order.alias("order"))


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


# ---------------------------------------------------------------- Claude-style export

def parse_claude_export(docs: DataFrame) -> DataFrame:
    docs = _records(docs, "claude")
    v = F.try_parse_json("text")
    convs = F.coalesce(F.try_variant_get(v, "$", ARR), list_field(v, "conversations"),
                       F.array().cast(ARR))
    c = docs.select("path", F.col("base").alias("ci"), F.explode(convs).alias("conv")).filter(is_object(F.col("conv")))
    conv = F.col("conv")
    c = c.select("path", "ci",
                 F.coalesce(first_text(conv, "uuid", "id"), F.lit("unknown")).alias("conv_id"),
                 first_text(conv, "name", "title").alias("conv_name"),
                 first_nonempty_list(conv, "chat_messages", "messages").alias("msgs"))
    m = c.select("*", F.posexplode(F.coalesce("msgs", F.array().cast(ARR))).alias("idx", "msg"))
    msg = F.col("msg")
    sender = first_text(msg, "sender", "role")
    text = str_field(msg, "text")
    text_ok = F.when(strip_ws(text) != "", strip_ws(text))
    content_v = field(msg, "content")
    cstr = F.when(_t(content_v) == "STRING", F.nullif(strip_ws(F.try_variant_get(content_v, "$", "string")), F.lit("")))
    parts = F.try_variant_get(content_v, "$", ARR)
    part_texts = F.filter(F.transform(parts, lambda p: F.when(
        is_object(p) & (str_field(p, "type") == "text"), str_field(p, "text"))), lambda t: t.isNotNull())
    clist = F.nullif(strip_ws(F.array_join(part_texts, "\n")), F.lit(""))
    content = F.coalesce(text_ok, F.when(_t(content_v) == "STRING", cstr).otherwise(clist))
    m = m.filter(is_object(msg) & sender.isin("human", "user")).withColumn("content", content) \
         .filter(F.col("content").isNotNull())
    meta = F.struct(F.col("conv_name").alias("conversation_name"), F.col("conv_id").alias("conversation_id"))
    return _raw(m, F.col("content"), "claude_export",
                F.concat(F.col("conv_id"), F.lit(":"), F.col("idx").cast("string")),
                iso_only_ts(msg, "created_at", "timestamp"), meta,
                F.struct("path", "ci", "idx"))


def read_claude_export(spark: SparkSession, path: str) -> DataFrame:
    return parse_claude_export(read_documents(spark, path))


# ---------------------------------------------------------------- Grok-style export

def parse_grok_export(docs: DataFrame) -> DataFrame:
    docs = _records(docs, "grok")
    v = F.try_parse_json("text")
    top_list = F.try_variant_get(v, "$", ARR)
    first = F.try_element_at(top_list, F.lit(1))
    list_of_convs = is_object(first) & field(first, "messages").isNotNull()
    convs = (F.when(top_list.isNotNull(),
                    F.when(list_of_convs, top_list).otherwise(F.array(v)))
              .when(is_object(v) & list_field(v, "conversations").isNotNull(), list_field(v, "conversations"))
              .when(is_object(v) & field(v, "messages").isNotNull(), F.array(v))
              .otherwise(F.array().cast(ARR)))
    # a bare message list becomes one conversation whose messages are the list
    bare = top_list.isNotNull() & ~list_of_convs
    c = docs.select("path", F.col("base").alias("ci"), F.explode(convs).alias("conv"),
                    bare.alias("bare"), top_list.alias("top"))
    conv = F.col("conv")
    msgs = F.when(F.col("bare"), F.col("top")).otherwise(list_field(conv, "messages"))
    c = c.select("path", "ci",
                 F.coalesce(first_text(conv, "id", "conversation_id"), _stem(F.col("path"))).alias("conv_id"),
                 msgs.alias("msgs"))
    m = c.select("*", F.posexplode(F.coalesce("msgs", F.array().cast(ARR))).alias("idx", "msg"))
    msg = F.col("msg")
    role = first_text(msg, "role", "sender", "author")
    raw_content = F.coalesce(truthy_text(msg, "content"), truthy_text(msg, "text"))
    content_is_str = F.when(truthy_text(msg, "content").isNotNull(), _t(field(msg, "content")) == "STRING") \
                      .otherwise(_t(field(msg, "text")) == "STRING")
    content = F.when(content_is_str, F.nullif(strip_ws(raw_content), F.lit("")))
    m = m.filter(is_object(msg) & role.isin("user", "human")).withColumn("content", content) \
         .filter(F.col("content").isNotNull())
    meta = F.struct(F.col("path").alias("file"), F.col("conv_id").alias("conversation_id"))
    ref = F.concat(_name(F.col("path")), F.lit("#"), F.col("conv_id"), F.lit(":"), F.col("idx").cast("string"))
    return _raw(m, F.col("content"), "grok_export", ref, ts_field(msg, "timestamp", "created_at"), meta,
                F.struct("path", "ci", "idx"))


def read_grok_export(spark: SparkSession, path: str) -> DataFrame:
    return parse_grok_export(read_documents(spark, path))


# ---------------------------------------------------------------- LM Studio logs

def parse_lm_studio_logs(docs: DataFrame) -> DataFrame:
    docs = _records(docs, "lm_studio")
    v = F.try_parse_json("text")
    keys = ("messages", "turns", "history", "chat", "conversation")
    msgs = F.coalesce(F.try_variant_get(v, "$", ARR), *[list_field(v, k) for k in keys], F.array().cast(ARR))
    obj = is_object(v)
    conv_id = F.when(obj, F.coalesce(first_text(v, "id", "conversation_id"), _stem(F.col("path")))) \
               .otherwise(_stem(F.col("path")))
    model = F.when(obj, F.try_variant_get(v, "$.model", "string"))
    m = docs.filter(v.isNotNull()).select("path", conv_id.alias("conv_id"), model.alias("model"),
                                          F.posexplode(msgs).alias("idx", "msg"))
    msg = F.col("msg")
    role = first_text(msg, "role", "sender")
    cv = F.coalesce(*[F.when(is_truthy(field(msg, k)), field(msg, k)) for k in ("content", "text", "message")])
    cstr = F.when(_t(cv) == "STRING", F.nullif(strip_ws(F.try_variant_get(cv, "$", "string")), F.lit("")))
    parts = F.try_variant_get(cv, "$", ARR)
    ptxt = F.filter(F.transform(parts, lambda p: F.when(_t(p) == "STRING", F.try_variant_get(p, "$", "string"))
                                .when(is_object(p), F.coalesce(
                                    F.when(truthy_text(p, "text").isNotNull(), str_field(p, "text")),
                                    F.when(truthy_text(p, "text").isNull(), str_field(p, "content"))))),
                    lambda t: t.isNotNull())
    clist = F.nullif(strip_ws(F.array_join(ptxt, "\n")), F.lit(""))
    content = F.when(_t(cv) == "STRING", cstr).otherwise(clist)
    m = m.filter(is_object(msg) & (role == "user")).withColumn("content", content) \
         .filter(F.col("content").isNotNull())
    meta = F.struct(F.col("path").alias("file"), F.col("model"), F.lit("user").alias("role"))
    ref = F.concat(_name(F.col("path")), F.lit("#"), F.col("conv_id"), F.lit(":"), F.col("idx").cast("string"))
    return _raw(m, F.col("content"), "lm_studio", ref,
                ts_field(msg, "timestamp", "created_at", "createdAt", "time"), meta, F.struct("path", "idx"))


def read_lm_studio_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_lm_studio_logs(read_documents(spark, path))


# ---------------------------------------------------------------- OpenRouter history

def parse_openrouter_history(docs: DataFrame, cutoff=None) -> DataFrame:
    """``cutoff`` (timestamp text) replaces now() - since: a record is dropped
    only when it has a creation time and that time is before the cutoff."""
    docs = _records(docs, "openrouter")
    v = F.try_parse_json("text")
    recs = F.coalesce(F.try_variant_get(v, "$", ARR), list_field(v, "data"), F.array().cast(ARR))
    r = docs.select("path", F.col("base").alias("ri"), F.explode(recs).alias("rec")).filter(is_object(F.col("rec")))
    rec = F.col("rec")
    created = ts_field(rec, "created_at", "created")
    direct = F.coalesce(*[F.nullif(strip_ws(str_field(rec, k)), F.lit("")) for k in ("prompt", "input", "user_prompt")])
    msgs = list_field(rec, "messages")
    users = F.filter(F.transform(msgs, lambda m: F.when(is_object(m) & (str_field(m, "role") == "user"),
                                                        str_field(m, "content"))), lambda t: t.isNotNull())
    joined = F.nullif(strip_ws(F.array_join(users, "\n")), F.lit(""))
    r = r.withColumn("created", created).withColumn("content", F.coalesce(direct, joined))
    if cutoff is not None:
        r = r.filter(F.col("created").isNull() | (F.col("created") >= F.to_timestamp(F.lit(str(cutoff)))))
    r = r.filter(F.col("content").isNotNull())

    def num(k1, k2=None):
        a = F.try_variant_get(rec, f"$.{k1}", "double")
        a = F.when(truthy_text(rec, k1).isNotNull(), a)
        if k2:
            a = F.coalesce(a, F.try_variant_get(rec, f"$.{k2}", "double"))
        return a

    meta = F.struct(F.try_variant_get(rec, "$.model", "string").alias("model"),
                    num("tokens_prompt", "native_tokens_prompt").cast("bigint").alias("tokens_prompt"),
                    num("tokens_completion", "native_tokens_completion").cast("bigint").alias("tokens_completion"),
                    F.try_variant_get(rec, "$.total_cost", "double").alias("total_cost"))
    ref = F.coalesce(first_text(rec, "id", "generation_id"), F.lit(""))
    return _raw(r, F.col("content"), "openrouter", ref, F.col("created"), meta, F.struct("path", "ri"))


def read_openrouter_history(spark: SparkSession, path: str, cutoff=None) -> DataFrame:
    return parse_openrouter_history(read_documents(spark, path), cutoff)
