"""Rubric definitions that ship with the library.

Fixed values: judge kinds, configurations and tag scopes must equal the
reference's shipped rubrics, because the rubric hash (and thus staleness of
stored evaluations) is computed from exactly these values.
"""
from __future__ import annotations

from evalspark.operators.scoring import Rubric

BENCH_EXPECTED_RUBRIC = "bench:expected_contains"
BENCH_TAG_CLASSIFIER = "bench"
BENCH_DIR_META_KEY = "bench_dir"

SHIPPED: dict[str, dict] = {
    "bullet_list_summary": {
        "judge": "regex",
        "config": {"pattern": "(?m)^\\s*[-*]\\s+.+(?:\\n\\s*[-*]\\s+.+){2,}", "flags": "m"},
        "applies_to": {"tags": ["summarization"]},
        "description": "At least three bullet items at line starts.",
    },
    "concise": {
        "judge": "regex",
        "config": {"pattern": "^[\\s\\S]{0,600}$", "flags": ""},
        "description": "Response stays under 600 characters.",
    },
    "factual_quality": {
        "judge": "llm",
        "config": {"rubric_description": "Score 1-5 how factually accurate the answer is. 5 = correct and clearly "
                                         "explained; 3 = mostly correct but missing nuance; 1 = factually wrong or "
                                         "hallucinated. passed=true if score >= 4.",
                   "pass_threshold": 4},
        "applies_to": {"tags": ["qa_factual"]},
        "description": "LLM-graded factual accuracy, 1-5, pass at 4.",
    },
    "helpful_summary": {
        "judge": "llm",
        "config": {"rubric_description": "Score 1-5 how well the assistant summarized the user's request: 5 = "
                                         "captures all key points concisely; 3 = covers the main idea but misses "
                                         "nuance or adds filler; 1 = misses the point or hallucinates. passed=true "
                                         "if score >= 4.",
                   "pass_threshold": 4},
        "applies_to": {"tags": ["summarization"]},
        "description": "LLM-graded summary quality, 1-5, pass at 4.",
    },
    "no_refusal": {
        "judge": "contains",
        "config": {"none_of": ["I can't", "I cannot", "I'm sorry, but", "I am unable to", "Sorry, I",
                               "I'm not able to"],
                   "case_sensitive": False},
        "description": "Response is not a refusal.",
    },
    "per_prompt_expected": {
        "judge": "expected_contains",
        "config": {"metadata_key": "expected_contains", "on_missing": "skip", "case_sensitive": False},
        "description": "Response contains every expected substring from the prompt metadata.",
    },
    "response_is_valid_json": {
        "judge": "json_valid",
        "config": {"allow_fenced": True},
        "description": "Response parses as JSON after stripping code fences.",
    },
}


def shipped(name: str) -> Rubric:
    d = dict(SHIPPED[name])
    d["name"] = name
    return Rubric.from_dict(d)


BENCH_RUBRIC = Rubric(name=BENCH_EXPECTED_RUBRIC, judge_kind="expected_contains",
                      judge_config={"metadata_key": "expected_contains", "on_missing": "skip"},
                      description="Response contains all expected substrings from the prompt's metadata.")
