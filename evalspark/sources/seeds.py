"""Seed prompt files, template expansion and benchmark directories."""
from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.jsontext import json_value
from evalspark.functions.judges import strip_ws
from evalspark.functions.rubrics import BENCH_DIR_META_KEY
from evalspark.sources.exports import _name, first_text, read_documents
from evalspark.sources.records import read_lines, records

CONTENT_KEYS = ("prompt", "content", "text")
TAG_KEYS = ("intended_tag", "tag", "category")
SEED_SOURCE = "self_generated:seed"
TEMPLATE_SOURCE = "self_generated:template"


def _overlay_map(overlay: dict | None) -> Column | None:
    if not overlay:
        return None
    kv = []
    for k, v in overlay.items():
        kv += [F.lit(k), F.parse_json(F.lit(json.dumps(v)))]
    return F.create_map(*kv)


def parse_seed_prompts(docs: DataFrame, overlay: dict | None = None) -> DataFrame:
    """Documents (path, text) of JSONL (``.jsonl``) or JSON (list or one
    object) -> raw prompt records. Large JSONL files are better read by
    ``read_seed_prompts``, line by line."""
    is_jsonl = F.lower(F.col("path")).endswith(".jsonl")
    lines = F.filter(F.split(F.col("text"), r"\r\n|\r|\n"), lambda s: strip_ws(s) != "")
    by_line = docs.where(is_jsonl).select("path", F.posexplode(lines).alias("idx", "text"))
    return parse_seed_records(by_line.unionByName(_whole(docs.where(~is_jsonl))), overlay)


def _whole(docs: DataFrame) -> DataFrame:
    """JSON documents (a list or one value) as records (path, idx, text)."""
    each = records(docs, "seeds").where("reject is null")
    listed = F.try_variant_get(F.try_parse_json("text"), "$", "array<string>").isNotNull()
    return each.select("path", F.col("base").cast("int").alias("idx"),
                       F.when(listed, F.expr("substring(text, 2, length(text) - 2)")).otherwise(F.col("text")).alias("text"))


def parse_seed_records(r: DataFrame, overlay: dict | None = None) -> DataFrame:
    """Records (path, idx, text), one JSON value each -> raw prompt records.

    A record is a string or an object; content = prompt / content / text;
    intended_tag / tag / category become ``intended_tag``; other keys are
    kept; the caller's ``overlay`` loses to record keys. ``source_ref`` is
    ``<file name>:<record index>`` counting every record, skipped ones too.
    """
    r = r.select("path", "idx", json_value(F.col("text")).alias("rec"))
    rec = F.col("rec")
    t = F.schema_of_variant(rec)
    is_obj = F.coalesce(t.startswith("OBJECT"), F.lit(False))
    content_v = F.coalesce(*[F.when(first_text(rec, k).isNotNull(),
                                    F.try_variant_get(rec, f"$.{k}", "variant")) for k in CONTENT_KEYS])
    content = F.when(t == "STRING", F.try_variant_get(rec, "$", "string")) \
               .when(is_obj & (F.schema_of_variant(content_v) == "STRING"),
                     F.try_variant_get(content_v, "$", "string"))
    m = F.try_variant_get(rec, "$", "map<string,variant>")
    kept = F.map_filter(m, lambda k, v: ~k.isin(*CONTENT_KEYS, *TAG_KEYS))
    tag_v = F.coalesce(*[F.when(first_text(rec, k).isNotNull(),
                                F.try_variant_get(rec, f"$.{k}", "variant")) for k in TAG_KEYS])
    meta = F.when(tag_v.isNotNull(), F.map_concat(F.create_map(F.lit("intended_tag"), tag_v), kept)) \
            .otherwise(kept)
    meta = F.when(is_obj, meta).otherwise(F.create_map().cast("map<string,variant>"))
    ov = _overlay_map(overlay)
    if ov is not None:
        meta = F.map_concat(F.map_filter(ov, lambda k, v: ~F.array_contains(F.map_keys(meta), k)), meta)
    meta_json = F.when(F.size(meta) > 0, F.to_json(meta))
    r = r.withColumn("content", content).filter(F.col("content").isNotNull() & (strip_ws(F.col("content")) != ""))
    return r.select(strip_ws(F.col("content")).alias("content"), F.lit(SEED_SOURCE).alias("source"),
                    F.concat(_name(F.col("path")), F.lit(":"), F.col("idx").cast("string")).alias("source_ref"),
                    F.lit(None).cast("timestamp").alias("created_at"), meta_json.alias("metadata"),
                    F.struct("path", "idx").alias("order"))


def read_seed_prompts(spark: SparkSession, path: str, overlay: dict | None = None,
                      glob: str = "*.json*") -> DataFrame:
    """Seed files under ``path``: JSONL by line (a file of any size is split), JSON by document."""
    lines = read_lines(spark, path, glob).where(F.lower(F.col("path")).endswith(".jsonl"))
    docs = read_documents(spark, path, glob).where(~F.lower(F.col("path")).endswith(".jsonl"))
    return parse_seed_records(lines.unionByName(_whole(docs)), overlay)


def bench_marker(bench_dir: str) -> str:
    from pathlib import Path
    return Path(bench_dir).resolve().as_posix()


def read_bench(spark: SparkSession, bench_dir: str) -> DataFrame:
    """Raw records of every prompts/*.jsonl in a bench directory, marked."""
    overlay = {BENCH_DIR_META_KEY: bench_marker(bench_dir)}
    return read_seed_prompts(spark, f"{bench_dir.rstrip('/')}/prompts", overlay, glob="*.jsonl")


# ---------------------------------------------------------------- templates

_SLOT_RE = re.compile(r"\{(\w+)\}")


def expand_templates(templates: DataFrame, slots: dict[str, Sequence[str]],
                     intended_tag: str | None = None, template_col: str = "template") -> DataFrame:
    """Every template x every combination of slot values (all slots, as the
    product is defined), ``{slot}`` substituted. Templates naming a slot that
    is not given are skipped. Each slot's value list is configuration; the
    expansion is an ``explode`` per slot on each template row (no join)."""
    keys = list(slots)
    t = templates.select(F.col(template_col).alias("template"))
    # '{{' and '}}' are literal braces (str.format escapes): protect them first
    lb, rb = "\u0000L", "\u0000R"
    prot = F.replace(F.replace(F.col("template"), F.lit("{{"), F.lit(lb)), F.lit("}}"), F.lit(rb))
    t = t.withColumn("_prot", prot)
    names = F.regexp_extract_all(F.col("_prot"), F.lit(r"\{(\w*)\}"), 1)
    known = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    t = t.filter(F.size(F.array_except(names, known)) == 0)
    for k in keys:
        t = t.withColumn(f"_s_{k}", F.explode(F.array(*[F.lit(v) for v in slots[k]])))
    content = F.col("_prot")
    for k in keys:
        content = F.replace(content, F.lit("{" + k + "}"), F.col(f"_s_{k}"))
    content = F.replace(F.replace(content, F.lit(lb), F.lit("{")), F.lit(rb), F.lit("}"))
    slots_struct = F.struct(*[F.col(f"_s_{k}").alias(k) for k in keys]) if keys else F.struct()
    meta = F.to_json(F.struct(F.col("template").alias("template"), slots_struct.alias("slots"),
                              F.lit(intended_tag).cast("string").alias("intended_tag")))
    order = F.struct(F.col("template"), *[F.col(f"_s_{k}") for k in keys])
    return t.select(content.alias("content"), F.lit(TEMPLATE_SOURCE).alias("source"),
                    F.concat(F.lit("tmpl:"), F.substring(F.sha2(F.col("template"), 256), 1, 8)).alias("source_ref"),
                    F.lit(None).cast("timestamp").alias("created_at"), meta.alias("metadata"),
                    order.alias("order"))
