"""Table schemas of the six-table evaluation store and fixed default values.

Surrogate integer ids are replaced by natural keys so that independent writers
on a cluster never need a global sequence:
prompt = content_hash (``prompt_id`` is kept as the caller's key column),
model = name, run = run_id, evaluation = (run_id, rubric, created_at).
"""
from __future__ import annotations

from pyspark.sql import types as T

PROMPTS = T.StructType([
    T.StructField("prompt_id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("token_count", T.LongType(), True),
    T.StructField("char_count", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_ref", T.StringType(), True),
    T.StructField("source_metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("ingested_at", T.TimestampType(), True),
])

TAG_TAXONOMY = T.StructType([
    T.StructField("tag", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("parent", T.StringType(), True),
])

PROMPT_TAGS = T.StructType([
    T.StructField("prompt_id", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("classifier", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

MODELS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("family", T.StringType(), True),
    T.StructField("size_params_b", T.DoubleType(), True),
    T.StructField("context_window", T.LongType(), True),
    T.StructField("local", T.BooleanType(), True),
    T.StructField("cost_in_per_mtok", T.DoubleType(), True),
    T.StructField("cost_out_per_mtok", T.DoubleType(), True),
    T.StructField("notes", T.StringType(), True),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("prompt_id", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("tokens_in", T.LongType(), True),
    T.StructField("tokens_out", T.LongType(), True),
    T.StructField("latency_ms", T.LongType(), True),
    T.StructField("cost_usd", T.DoubleType(), True),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("top_p", T.DoubleType(), True),
    T.StructField("seed", T.LongType(), True),
    T.StructField("run_metadata", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

EVALUATIONS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("rubric", T.StringType(), False),
    T.StructField("rubric_hash", T.StringType(), True),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("passed", T.BooleanType(), True),
    T.StructField("scored_by", T.StringType(), False),
    T.StructField("judge_model", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("eval_metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

TABLES: dict[str, T.StructType] = {
    "prompts": PROMPTS,
    "tag_taxonomy": TAG_TAXONOMY,
    "prompt_tags": PROMPT_TAGS,
    "models": MODELS,
    "runs": RUNS,
    "evaluations": EVALUATIONS,
}

# Fixed values (must equal the reference's defaults): the seeded tag taxonomy,
# in its natural order, as (tag, description).
DEFAULT_TAXONOMY: list[tuple[str, str]] = [
    ("coding", "Write, fix, or explain code"),
    ("reasoning", "Multi-step logical or mathematical reasoning"),
    ("math", "Arithmetic, algebra, calculus, proofs"),
    ("summarization", "Condense or paraphrase given text"),
    ("extraction", "Pull structured data from unstructured text"),
    ("classification", "Assign labels to provided content"),
    ("creative", "Fiction, poetry, brainstorming, ideation"),
    ("conversation", "Open-ended chit-chat, role-play, advice"),
    ("instruction", "Follow procedural instructions, tool use"),
    ("translation", "Convert text between human languages"),
    ("qa_factual", "Direct factual question expecting a known answer"),
    ("rewrite", "Edit or rephrase given text"),
    ("planning", "Produce a plan, outline, or schedule"),
    ("unknown", "Could not be classified"),
]

# Thresholds and defaults shared by router, report and compare.
DEFAULT_AUTH_RUBRICS = ("human_pass",)
DEFAULT_THRESHOLD = 0.7
DEFAULT_MIN_SAMPLES = 3
WILSON_Z95 = 1.959963984540054
