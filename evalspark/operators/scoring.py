"""Rubrics and scoring runs into evaluations.

The ordered decision is a single ``CASE`` column over narrow flags (a blank
response, an up-to-date evaluation, an applicable tag, a recorded reply); counters
are one conditional-count aggregate over it. Texts are joined last, to the runs
that reach the judge, which runs once on each.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.judges import NEEDS_METADATA, build_judge, is_blank
from evalspark.functions.rows import one_row

DECISIONS = ("skipped_existing", "skipped_no_response", "skipped_tag_mismatch", "error", "evaluated")


@dataclass
class Rubric:
    name: str
    judge_kind: str
    judge_config: dict = field(default_factory=dict)
    description: str = ""
    applies_to_tags: list[str] | None = None

    def config_hash(self) -> str:
        """SHA-256 of what affects scores (judge, config, sorted tags); the
        description is excluded so editing prose keeps scores fresh. The payload's
        keys and form are fixed: stored hashes must stay equal."""
        payload = json.dumps({
            "judge": self.judge_kind,
            "config": self.judge_config,
            "applies_to_tags": sorted(self.applies_to_tags) if self.applies_to_tags else None,
        }, sort_keys=True, default=str)
        return hashlib.sha256(payload.encode("utf-8")).hexdigest()

    @classmethod
    def from_dict(cls, d: dict) -> "Rubric":
        applies = (d.get("applies_to") or {}).get("tags") if isinstance(d.get("applies_to"), dict) else None
        return cls(name=d["name"], judge_kind=d["judge"], judge_config=dict(d.get("config") or {}),
                   description=d.get("description") or "", applies_to_tags=applies or None)

    @classmethod
    def from_file(cls, path: str) -> "Rubric":
        text = open(path, encoding="utf-8").read()
        if path.lower().endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:  # pragma: no cover
                raise RuntimeError("PyYAML is needed for YAML rubrics; use JSON instead") from e
            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
        return cls.from_dict(data)

    def judge(self):
        return build_judge(self.judge_kind, self.judge_config)


def decide(rubric: Rubric, runs: DataFrame, evaluations: DataFrame | None = None, prompt_tags: DataFrame | None = None,
           replies: DataFrame | None = None) -> DataFrame:
    """(run_id, prompt_id, decision) of each run, in the order of DECISIONS.

    Only keys and flags are joined; no text is moved and no judge runs. A run is
    skipped as existing if ``evaluations`` has an up-to-date row of it (hash NULL
    or equal); an error if an LLM judge has no recorded reply for it.
    """
    x = runs.select("run_id", "prompt_id", is_blank(F.col("response")).alias("_blank"))
    if evaluations is None:
        x = x.withColumn("_fresh", F.lit(False))
    else:
        h = F.col("rubric_hash")
        fresh = evaluations.where((F.col("rubric") == rubric.name) & (h.isNull() | (h == rubric.config_hash())))
        x = x.join(fresh.select("run_id").distinct().withColumn("_fresh", F.lit(True)), "run_id", "left")
    if rubric.applies_to_tags:
        if prompt_tags is None:
            raise ValueError("rubric has applies_to tags; prompt_tags is required")
        ok = prompt_tags.where(F.col("tag").isin(list(rubric.applies_to_tags))).select("prompt_id").distinct()
        x = x.join(ok.withColumn("_tag_ok", F.lit(True)), "prompt_id", "left")
    else:
        x = x.withColumn("_tag_ok", F.lit(True))
    if rubric.judge_kind == "llm":
        if replies is None:
            raise ValueError("an LLM rubric needs recorded replies (run_id, reply)")
        x = x.join(replies.select("run_id").distinct().withColumn("_replied", F.lit(True)), "run_id", "left")
    else:
        x = x.withColumn("_replied", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return x.select("run_id", "prompt_id", F.when(flag("_fresh"), "skipped_existing").when(F.col("_blank"), "skipped_no_response")
                    .when(~flag("_tag_ok"), "skipped_tag_mismatch").when(~flag("_replied"), "error").otherwise("evaluated").alias("decision"))


def judged(rubric: Rubric, decisions: DataFrame, runs: DataFrame, prompts: DataFrame | None, replies: DataFrame | None,
           scored_by: str, ts) -> DataFrame:
    """Evaluation rows of the runs to evaluate: texts are joined last, the judge runs once on each."""
    todo = decisions.where("decision = 'evaluated'").select("run_id", "prompt_id")
    x = runs.select("run_id", F.col("response").alias("_text")).join(todo, "run_id")
    if rubric.judge_kind == "llm":
        x = x.drop("_text").join(replies.select("run_id", F.col("reply").alias("_text")), "run_id")
    if rubric.judge_kind in NEEDS_METADATA and prompts is not None:
        x = x.join(prompts.select("prompt_id", F.col("source_metadata").alias("_meta")), "prompt_id", "left")
    else:
        x = x.withColumn("_meta", F.lit(None).cast("string"))
    x = x.withColumn("_v", rubric.judge()(F.lit(""), F.col("_text"), F.col("_meta")))
    own = F.to_json(F.struct(F.lit(rubric.description).alias("rubric_description")))
    more = F.when(F.length("_v.extra") > 2, F.concat(F.expr("substring(_own, 1, length(_own) - 1)"), F.lit(","),
                                                      F.expr("substring(_v.extra, 2)")))
    return x.withColumn("_own", own).select(
        "run_id", F.lit(rubric.name).alias("rubric"), F.lit(rubric.config_hash()).alias("rubric_hash"),
        F.col("_v.score").alias("score"), F.col("_v.passed").alias("passed"), F.lit(scored_by).alias("scored_by"),
        F.col("_v.judge_model").alias("judge_model"), F.col("_v.notes").alias("notes"),
        F.coalesce(more, F.col("_own")).alias("eval_metadata"), ts.alias("created_at"))


def score_runs(rubric: Rubric, runs: DataFrame, prompts: DataFrame, evaluations: DataFrame,
               prompt_tags: DataFrame | None = None, as_of=None, mode: str = "skip",
               run_ids=None, rescored_by: str | None = None,
               replies: DataFrame | None = None) -> dict[str, DataFrame]:
    """Apply ``rubric`` to runs.

    mode: 'skip' (default) keeps up-to-date rows (hash NULL or equal) and
    deletes stale ones (non-NULL, different hash) before re-scoring;
    'append' scores every run next to old rows; 'replace' deletes the rubric's
    rows of the given runs and scores all of them. Rows of runs that are not given
    are never touched. ``run_ids`` (a table with run_id, or a short list) narrows
    ``runs``.

    Returns ``evaluations`` (the full new table), ``new`` (rows written),
    ``decisions`` (per run) and ``counters`` (one row).
    ``replies`` (run_id, reply) feeds the LLM judge with recorded replies.
    """
    if mode not in ("skip", "append", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    scored_by = rescored_by or ("llm" if rubric.judge_kind == "llm" else "auto")
    ts = F.current_timestamp() if as_of is None else F.to_timestamp(F.lit(str(as_of)))
    if run_ids is not None:
        if not isinstance(run_ids, DataFrame):
            run_ids = runs.sparkSession.createDataFrame([(r,) for r in run_ids], runs.select("run_id").schema)
        runs = runs.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")

    own = F.coalesce(F.col("rubric") == rubric.name, F.lit(False))
    if mode == "append":
        kept, removed = evaluations, evaluations.where(F.lit(False))
    else:
        given = runs.select("run_id").distinct().withColumn("_given", F.lit(True))
        gone = F.coalesce(F.col("_given"), F.lit(False))
        if mode == "skip":
            gone = gone & F.coalesce(F.col("rubric_hash") != rubric.config_hash(), F.lit(False))
        marked = evaluations.where(own).join(given, "run_id", "left").withColumn("_gone", gone)
        kept = evaluations.where(~own).unionByName(marked.where("not _gone").select(*evaluations.columns))
        removed = marked.where("_gone")

    decisions = decide(rubric, runs, evaluations if mode == "skip" else None, prompt_tags, replies)
    new = judged(rubric, decisions, runs, prompts, replies, scored_by, ts)
    cols = kept.columns
    for c in new.columns:
        if c not in cols:
            kept = kept.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    new_aligned = new.select(*[F.col(c).cast(kept.schema[c].dataType) if c in new.columns
                               else F.lit(None).cast(kept.schema[c].dataType).alias(c)
                               for c in kept.columns])
    d = F.col("decision")
    seen = decisions.agg(F.count(F.lit(1)).alias("runs_seen"),
                         F.count_if(d == "evaluated").alias("runs_evaluated"),
                         F.count_if(d == "evaluated").alias("evaluations_written"),
                         F.count_if(d == "skipped_existing").alias("skipped_existing"),
                         F.count_if(d == "skipped_no_response").alias("skipped_no_response"),
                         F.count_if(d == "skipped_tag_mismatch").alias("skipped_tag_mismatch"),
                         F.count_if(d == "error").alias("errors"))
    counters = (one_row(seen, removed.agg(F.count(F.lit(1)).alias("_n")))
                .withColumn("replaced", F.when(F.lit(mode == "replace"), F.col("_n")).otherwise(F.lit(0)).cast("bigint"))
                .withColumn("stale_replaced", F.when(F.lit(mode == "skip"), F.col("_n")).otherwise(F.lit(0)).cast("bigint"))
                .drop("_n"))
    return {"evaluations": kept.unionByName(new_aligned), "new": new, "decisions": decisions, "counters": counters}
