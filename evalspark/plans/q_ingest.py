"""Ingest queries: text functions, de-duplication and readers.

Reader inputs are export documents that Spark builds from the conversations
and benchmark tables (one JSON document per conversation / category), so the
parsers run over every row of those tables without writing files.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import text as TX
from evalspark.functions.rows import one_row
from evalspark.functions.rubrics import BENCH_DIR_META_KEY
from evalspark.operators import classify as CL
from evalspark.operators import ingest as IG
from evalspark.plans.fixtures import table, with_views
from evalspark.plans.registry import register
from evalspark.sources import exports as EX
from evalspark.sources import seeds as SD

AS_OF = "2024-06-01 00:00:00"
# DuckDB (RE2) spelling of Python's whitespace class, for the oracle only.
DUCK_WS = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def dnorm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{DUCK_WS}+', ' ', 'g'))"


# ---------------------------------------------------------------- text functions

@register("normalize_prompt", f"select doc_id, {dnorm('text')} as normalized from documents")
def q_normalize(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", TX.normalize_prompt("text").alias("normalized"))


@register("content_hash", f"select doc_id, sha256({dnorm('text')}) as content_hash from documents")
def q_hash(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", TX.content_hash("text").alias("content_hash"))


def doc_raw(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("text").alias("content"), F.lit("documents").alias("source"),
                       F.col("doc_id").cast("string").alias("source_ref"),
                       F.lit(None).cast("timestamp").alias("created_at"),
                       F.to_json(F.struct("lang", "source")).alias("metadata"),
                       F.col("doc_id").alias("order"), "lang")


def doc_stored(spark, d):
    return IG.hashed(doc_raw(spark, d).filter(F.col("lang") == "de")).select("content_hash").distinct()


DEDUP_CTES = {
    "h": f"""select doc_id, text, lang, source, sha256({dnorm('text')}) as h from documents
             where {dnorm('text')} <> ''""",
    "firsts": "select h, min(doc_id) as first_doc from h group by h",
    "stored": "select distinct h from h where lang = 'de'",
    "new": f"""select f.h as prompt_id,
                  case when contains(x.text, chr(10)) then x.text else {dnorm('x.text')} end as content,
                  f.h as content_hash, cast(length(x.text) as bigint) as char_count, 'documents' as source,
                  cast(x.doc_id as varchar) as source_ref,
                  '{{"lang":"' || x.lang || '","source":"' || x.source || '"}}' as source_metadata
               from firsts f join h x on x.doc_id = f.first_doc
               where f.h not in (select h from stored)""",
}


@register("dedup_prompts", with_views("select * from new", extra=DEDUP_CTES))
def q_dedup(spark, d):
    out = IG.dedup_prompts(doc_raw(spark, d).drop("lang"), doc_stored(spark, d), ingested_at=AS_OF)
    return out["new"].select("prompt_id", "content", "content_hash", "char_count", "source", "source_ref",
                             "source_metadata")


@register("ingest_dry_run", with_views(f"""
select (select count(*) from new) as inserted,
       (select count(*) from documents where {dnorm('text')} <> '') - (select count(*) from new) as duplicates,
       (select count(*) from documents where {dnorm('text')} = '') as skipped""", extra=DEDUP_CTES))
def q_dry_run(spark, d):
    return IG.ingest_dry_run(doc_raw(spark, d).drop("lang"), doc_stored(spark, d))


@register("f1_dedup", f"""
select h as content_hash, min(doc_id) as first_doc, count(*) as copies
from (select doc_id, sha256({dnorm('text')}) as h from documents) t group by h""")
def q_f1_dedup(spark, d):
    docs = table(spark, d, "documents")
    return (docs.select("doc_id", TX.content_hash("text").alias("content_hash"))
                .groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"),
                                             F.count(F.lit(1)).alias("copies")))


@register("token_count", "select doc_id, cast(null as bigint) as token_count from documents")
def q_token_count(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", TX.token_count("text").alias("token_count"))


MODEL_NAME_SQL = """
select p_partkey,
       case when p_partkey % 3 = 0 then concat(replace(p_name, ' ', '-'), '-', cast(p_size as varchar), 'b')
            when p_partkey % 5 = 0 then concat(lower(replace(p_brand, '#', '')), '/', replace(p_name, ' ', '-'), '-',
                                               cast(p_size as varchar), '.5b')
            else concat(lower(replace(p_brand, '#', '')), '/', replace(p_name, ' ', '-'), '-', cast(p_size as varchar),
                        case when p_partkey % 4 = 0 then 'm' else 'b' end, '-instruct') end as name
from part"""


def model_names(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    dash = F.regexp_replace("p_name", " ", "-")
    brand = F.lower(F.regexp_replace("p_brand", "#", ""))
    size = F.col("p_size").cast("string")
    name = (F.when(k % 3 == 0, F.concat(dash, F.lit("-"), size, F.lit("b")))
             .when(k % 5 == 0, F.concat(brand, F.lit("/"), dash, F.lit("-"), size, F.lit(".5b")))
             .otherwise(F.concat(brand, F.lit("/"), dash, F.lit("-"), size,
                                 F.when(k % 4 == 0, "m").otherwise("b"), F.lit("-instruct"))))
    return p.select("p_partkey", name.alias("name"))


@register("provider_family", with_views("""
select p_partkey, name,
       case when contains(name, '/') then split_part(name, '/', 1) else 'unknown' end as provider,
       nullif(split_part(case when contains(name, '/') then substr(name, strpos(name, '/') + 1) else name end, '-', 1), '')
         as family
from names""", extra={"names": MODEL_NAME_SQL}))
def q_provider_family(spark, d):
    n = model_names(spark, d)
    prov, fam = TX.provider_family("name")
    return n.select("p_partkey", "name", prov.alias("provider"), fam.alias("family"))


@register("size_from_name", with_views("""
select p_partkey, name,
       case when regexp_extract(name, '(?i)\\b(\\d+(?:\\.\\d+)?)b\\b', 1) <> ''
              then cast(regexp_extract(name, '(?i)\\b(\\d+(?:\\.\\d+)?)b\\b', 1) as double)
            when regexp_extract(name, '(?i)\\b(\\d+(?:\\.\\d+)?)m\\b', 1) <> ''
              then cast(regexp_extract(name, '(?i)\\b(\\d+(?:\\.\\d+)?)m\\b', 1) as double) / 1000e0 end as size_params_b
from names""", extra={"names": MODEL_NAME_SQL}))
def q_size_from_name(spark, d):
    n = model_names(spark, d)
    return n.select("p_partkey", "name", TX.size_from_name("name").alias("size_params_b"))


@register("parse_timestamp", """
select event_id, s,
       strftime(coalesce(
         case when num is not null then make_timestamp(cast(round(
                (case when num > 1e10 then num / 1000e0 else num end) * 1e6) as bigint)) end,
         cast(try_cast(regexp_replace(s, 'Z$', '+00:00') as timestamptz) at time zone 'UTC' as timestamp)),
         '%Y-%m-%d %H:%M:%S.%f') as parsed
from (select event_id,
             case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
                               when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
                               when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
                               when 3 then concat('bad-', cast(event_id as varchar))
                               else strftime(ts, '%Y-%m-%d') end as s,
             case event_id % 5 when 3 then cast(floor(epoch_us(ts) / 1000) as double)
                               when 4 then cast(floor(epoch_us(ts) / 1000000) as double) end as num
      from events) t""")
def q_parse_ts(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    s = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
          .when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
          .when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
          .when(k == 3, F.concat(F.lit("bad-"), F.col("event_id").cast("string")))
          .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    num = (F.when(k == 3, F.floor(us / 1000).cast("double"))
            .when(k == 4, F.floor(us / 1000000).cast("double")))
    t = e.select("event_id", s.alias("s"), num.alias("num"))
    parsed = TX.parse_timestamp(F.col("s"), F.col("num"))
    return t.select("event_id", "s", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@register("estimate_cost", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when ti is null or tout is null then null
            when ci is null and co is null then null
            else 0e0 + (case when ci is not null then (ti / 1000000e0) * ci else 0e0 end)
                     + (case when co is not null then (tout / 1000000e0) * co else 0e0 end) end as cost_usd
from (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
             case when l_linenumber = 7 then null else cast(l_quantity * 37 as bigint) end as ti,
             cast(floor(l_extendedprice / 100) as bigint) as tout,
             case when l_suppkey % 3 = 0 then null else (l_suppkey % 5) * 0.25e0 end as ci,
             case when l_suppkey % 4 = 0 then null else (l_suppkey % 9) * 0.5e0 end as co
      from lineitem) t""")
def q_estimate_cost(spark, d):
    li = table(spark, d, "lineitem")
    s = F.col("l_suppkey")
    ti = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("bigint")).otherwise((F.col("l_quantity") * 37).cast("bigint"))
    to = F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    ci = F.when(s % 3 == 0, F.lit(None).cast("double")).otherwise((s % 5) * F.lit(0.25))
    co = F.when(s % 4 == 0, F.lit(None).cast("double")).otherwise((s % 9) * F.lit(0.5))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     TX.estimate_cost(ti, to, ci, co).alias("cost_usd"))


@register("model_provider", """
select s_suppkey, case when s_suppkey % 2 = 0 then 'lm_studio'
                       when (case s_suppkey % 5 when 0 then 'lm_studio' when 1 then 'openrouter' else n_name end)
                            in ('lm_studio', 'openrouter')
                         then (case s_suppkey % 5 when 0 then 'lm_studio' when 1 then 'openrouter' else n_name end)
                       else 'openrouter' end as chat_provider
from supplier join nation on s_nationkey = n_nationkey""")
def q_model_provider(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    prov = F.when(k % 5 == 0, "lm_studio").when(k % 5 == 1, "openrouter").otherwise(F.col("n_name"))
    return s.select("s_suppkey", TX.model_provider(k % 2 == 0, prov).alias("chat_provider"))


# ---------------------------------------------------------------- export documents built from tables

def jstr(c):
    """JSON string literal of a column value."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _conv_msgs(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))


def claude_docs(spark, d):
    g = _conv_msgs(spark, d)
    k = F.col("conv_id") % 3
    sender = lambda m: F.when(m["role"] == "user", "human").otherwise(m["role"])
    ts = lambda m: F.concat(F.lit("2024-01-0"), (m["turn"] % 9 + 1).cast("string"), F.lit("T10:00:00Z"))
    msgs_a = F.transform("m", lambda m: F.to_json(F.struct(sender(m).alias("sender"), m["text"].alias("text"),
                                                           ts(m).alias("created_at"))))
    msgs_b = F.transform("m", lambda m: F.to_json(F.struct(
        sender(m).alias("sender"), F.lit("").alias("text"),
        F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text")),
                F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))).alias("content"))))
    msgs_c = F.transform("m", lambda m: F.to_json(F.struct(m["role"].alias("role"), m["text"].alias("content"))))
    arr = F.concat(F.lit("["), F.array_join(F.when(k == 0, msgs_a).when(k == 1, msgs_b).otherwise(msgs_c), ","), F.lit("]"))
    cid = F.concat(F.lit("c-"), F.col("conv_id").cast("string"))
    conv = F.concat(F.lit('{"uuid": "'), cid, F.lit('", "name": "conversation '), F.col("conv_id").cast("string"),
                    F.lit('", "'), F.when(k == 2, "messages").otherwise("chat_messages"), F.lit('": '), arr, F.lit("}"))
    doc = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), conv, F.lit("]"))) \
           .otherwise(F.concat(F.lit('{"conversations": ['), conv, F.lit("]}")))
    return g.select(F.concat(F.lit("/exports/claude/"), cid, F.lit(".json")).alias("path"), doc.alias("text"))


def grok_docs(spark, d):
    g = _conv_msgs(spark, d)
    k = F.col("conv_id") % 3
    epoch = F.lit(1704067200)
    msgs_a = F.transform("m", lambda m: F.to_json(F.struct(m["role"].alias("role"), m["text"].alias("content"),
                                                           (epoch + m["turn"] * 60).alias("timestamp"))))
    msgs_b = F.transform("m", lambda m: F.to_json(F.struct(
        F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), m["text"].alias("text"),
        ((epoch + m["turn"] * 60) * 1000).alias("timestamp"))))
    msgs_c = F.transform("m", lambda m: F.to_json(F.struct(m["role"].alias("author"), m["text"].alias("content"))))
    cid = F.concat(F.lit("g-"), F.col("conv_id").cast("string"))
    a = F.concat(F.lit('[{"id": "'), cid, F.lit('", "messages": ['), F.array_join(msgs_a, ","), F.lit("]}]"))
    b = F.concat(F.lit('{"conversations": [{"conversation_id": "'), cid, F.lit('", "messages": ['),
                 F.array_join(msgs_b, ","), F.lit("]}]}"))
    c = F.concat(F.lit("["), F.array_join(msgs_c, ","), F.lit("]"))
    doc = F.when(k == 0, a).when(k == 1, b).otherwise(c)
    return g.select(F.concat(F.lit("/exports/grok/"), cid, F.lit(".json")).alias("path"), doc.alias("text"))


def lm_docs(spark, d):
    g = _conv_msgs(spark, d)
    k = F.col("conv_id") % 2
    msgs_a = F.transform("m", lambda m: F.to_json(F.struct(m["role"].alias("role"), m["text"].alias("content"),
                                                           F.lit("2024-02-01T08:00:00").alias("createdAt"))))
    msgs_b = F.transform("m", lambda m: F.concat(
        F.lit('{"sender": '), jstr(m["role"]), F.lit(', "content": ['), jstr(m["text"]),
        F.lit(', {"content": "(end)"}]}')))
    cid = F.concat(F.lit("lm-"), F.col("conv_id").cast("string"))
    a = F.concat(F.lit('{"id": "'), cid, F.lit('", "model": "local/qwen-7b", "messages": ['),
                 F.array_join(msgs_a, ","), F.lit("]}"))
    b = F.concat(F.lit('{"turns": ['), F.array_join(msgs_b, ","), F.lit("]}"))
    return g.select(F.concat(F.lit("/exports/lm/"), cid, F.lit(".json")).alias("path"),
                    F.when(k == 0, a).otherwise(b).alias("text"))


def openrouter_docs(spark, d):
    g = _conv_msgs(spark, d)
    k = F.col("conv_id") % 3
    msgs = F.transform("m", lambda m: F.to_json(F.struct(m["role"].alias("role"), m["text"].alias("content"))))
    first_user = F.try_element_at(F.filter("m", lambda m: m["role"] == "user"), F.lit(1))["text"]
    created = F.concat(F.lit("2024-03-"), F.lpad(((F.col("conv_id") % 28) + 1).cast("string"), 2, "0"),
                       F.lit("T12:00:00Z"))
    rec = F.concat(F.lit('{"id": "gen-'), F.col("conv_id").cast("string"), F.lit('", "model": "openai/gpt-4o-mini"'),
                   F.lit(', "created_at": "'), created, F.lit('", "tokens_prompt": '),
                   (F.col("conv_id") % 50 + 5).cast("string"), F.lit(', "native_tokens_completion": 7'),
                   F.lit(', "total_cost": 0.001'),
                   F.when(k == 0, F.concat(F.lit(', "prompt": '), jstr(first_user)))
                    .otherwise(F.concat(F.lit(', "messages": ['), F.array_join(msgs, ","), F.lit("]"))),
                   F.lit("}"))
    files = g.select(F.floor(F.col("conv_id") / 8).alias("f"), rec.alias("rec"))  # eight records a file
    return (files.groupBy("f").agg(F.array_join(F.array_sort(F.collect_list("rec")), ",").alias("recs"))
                 .select(F.concat(F.lit("/exports/or/history-"), F.col("f").cast("string"), F.lit(".json")).alias("path"),
                         F.when(F.col("f") % 2 == 0, F.concat(F.lit("["), F.col("recs"), F.lit("]")))
                          .otherwise(F.concat(F.lit('{"data": ['), F.col("recs"), F.lit("]}"))).alias("text")))


def seed_docs(spark, d):
    b = table(spark, d, "benchmark")
    k = F.col("item_id") % 4
    line = (F.when(F.col("item_id") % 9 == 0, jstr(F.col("text")))
             .otherwise(F.to_json(F.struct(
                 F.col("text").alias("prompt"), F.concat(F.lit("cat"), k.cast("string")).alias("tag"),
                 F.array(F.substring_index("text", " ", 1)).alias("expected_contains"),
                 F.col("item_id").alias("item")))))
    part = F.lpad(F.floor(F.col("item_id") / 32).cast("string"), 12, "0")  # eight records a file
    files = b.select(F.concat(k.cast("string"), F.lit("-"), part).alias("f"), F.struct("item_id", line.alias("line")).alias("x"))
    return (files.groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("xs"))
                 .select(F.concat(F.lit("/bench/f1/prompts/cat"), F.col("f"), F.lit(".jsonl")).alias("path"),
                         F.array_join(F.transform("xs", lambda x: x["line"]), "\n\n").alias("text")))


# The documents above are built from the tables with turns in order (turns are
# numbered 0..n-1 per conversation), so each reader's output has a direct SQL
# form over the same tables. Metadata JSON is checked in tests/.

@register("read_claude_export", """
select text as content, 'claude_export' as source, concat('c-', cast(conv_id as varchar), ':', cast(turn as varchar)) as source_ref,
       case when conv_id % 3 = 0 then cast(concat('2024-01-0', cast(turn % 9 + 1 as varchar), ' 10:00:00') as timestamp) end
         as created_at
from conversations where role = 'user' and trim(text) <> ''""")
def q_claude(spark, d):
    return EX.parse_claude_export(claude_docs(spark, d)).select("content", "source", "source_ref", "created_at")


@register("read_grok_export", """
select text as content, 'grok_export' as source,
       concat('g-', cast(conv_id as varchar), '.json#g-', cast(conv_id as varchar), ':', cast(turn as varchar)) as source_ref,
       case when conv_id % 3 < 2 then make_timestamp(cast((1704067200 + turn * 60) * 1000000 as bigint)) end as created_at
from conversations where role = 'user' and trim(text) <> ''""")
def q_grok(spark, d):
    return EX.parse_grok_export(grok_docs(spark, d)).select("content", "source", "source_ref", "created_at")


@register("read_lm_studio_logs", """
select case when conv_id % 2 = 0 then text else concat(text, chr(10), '(end)') end as content, 'lm_studio' as source,
       concat('lm-', cast(conv_id as varchar), '.json#lm-', cast(conv_id as varchar), ':', cast(turn as varchar)) as source_ref,
       case when conv_id % 2 = 0 then timestamp '2024-02-01 08:00:00' end as created_at
from conversations where role = 'user'""")
def q_lm(spark, d):
    return EX.parse_lm_studio_logs(lm_docs(spark, d)).select("content", "source", "source_ref", "created_at")


@register("read_openrouter_history", """
select case when u.conv_id % 3 = 0 then u.first_text else u.joined end as content, 'openrouter' as source,
       concat('gen-', cast(u.conv_id as varchar)) as source_ref,
       make_timestamp(2024, 3, cast(u.conv_id % 28 + 1 as bigint), 12, 0, 0) as created_at
from (select conv_id, string_agg(text, chr(10) order by turn) as joined, arg_min(text, turn) as first_text
      from conversations where role = 'user' group by conv_id) u
where u.conv_id % 28 + 1 >= 10""")
def q_openrouter(spark, d):
    return EX.parse_openrouter_history(openrouter_docs(spark, d), cutoff="2024-03-10 00:00:00").select("content", "source", "source_ref", "created_at")


@register("read_seed_prompts", """
select text as content, 'self_generated:seed' as source,
       concat('cat', cast(item_id % 4 as varchar), '-', lpad(cast(item_id // 32 as varchar), 12, '0'), '.jsonl:',
              cast(row_number() over (partition by item_id % 4, item_id // 32 order by item_id) - 1 as varchar)) as source_ref,
       cast(null as timestamp) as created_at
from benchmark""")
def q_seed(spark, d):
    return SD.parse_seed_prompts(seed_docs(spark, d)).select("content", "source", "source_ref", "created_at")


@register("expand_templates", with_views("""
select replace(replace(template, '{tone}', tone), '{audience}', audience) as content,
       'self_generated:template' as source, concat('tmpl:', substr(sha256(template), 1, 8)) as source_ref
from (select concat('Summarize the {tone} review of ', p_name, ' for {audience}.') as template from part
      union all select concat('Write a {tone} poem about ', p_type, ' parts.') from (select distinct p_type from part)
      union all select concat('Translate {missing} for ', p_brand) from (select distinct p_brand from part)) t,
     (select unnest(['short', 'formal']) as tone) a, (select unnest(['engineers', 'kids', 'buyers']) as audience) b
where len(list_filter(regexp_extract_all(t.template, '[{](\\w+)[}]', 1), lambda x: x not in ('tone', 'audience'))) = 0"""))
def q_templates(spark, d):
    p = table(spark, d, "part")
    t = (p.select(F.concat(F.lit("Summarize the {tone} review of "), F.col("p_name"), F.lit(" for {audience}.")).alias("template"))
         .unionAll(p.select("p_type").distinct().select(F.concat(F.lit("Write a {tone} poem about "), F.col("p_type"), F.lit(" parts."))))
         .unionAll(p.select("p_brand").distinct().select(F.concat(F.lit("Translate {missing} for "), F.col("p_brand")))))
    out = SD.expand_templates(t, {"tone": ["short", "formal"], "audience": ["engineers", "kids", "buyers"]},
                              intended_tag="summarization")
    return out.select("content", "source", "source_ref")


@register("load_bench", f"""
with b as (select item_id, {dnorm('text')} as norm,
                  (item_id % 4) * 1000000000 + row_number() over (partition by item_id % 4 order by item_id) - 1 as ord
           from benchmark),
     nb as (select * from b where norm <> ''),
     firsts as (select norm, arg_min(item_id, ord) as first_item from nb group by norm)
select (select count(*) from firsts) as inserted,
       (select count(*) from nb) - (select count(*) from firsts) as duplicates,
       cast(0 as bigint) as skipped,
       (select count(*) from firsts where first_item % 9 <> 0) as tagged""")
def q_load_bench(spark, d):
    raw = SD.parse_seed_prompts(seed_docs(spark, d), {BENCH_DIR_META_KEY: "/bench/f1"})
    out = IG.dedup_prompts(raw, None, ingested_at=AS_OF)
    tags = CL.tag_intended(out["new"], None, marker="/bench/f1")
    return one_row(out["counters"], tags.agg(F.count(F.lit(1)).alias("tagged")))
