"""JSON export files cut into records, with a row for everything unreadable.

An export is one JSON text, often of hundreds of megabytes, and a VARIANT is
limited in size. So a file is cut into its conversations (or entries) first, by
one pass of a JSON decoder in the task that reads it, and each of them becomes a
small text of its own; the readers parse those as they would a small file. A file
that is not exactly one JSON value, and a record beyond ``RECORD_BYTES``, gives a
row with the reason in ``reject`` and no text.
"""
from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: bytes of one record's text, at most (Spark's VARIANT holds no more than 128 MB)
RECORD_BYTES = 100 << 20

#: of each kind of export: the keys of its list of records, and whether a list whose first
#: element has none of ``inside`` is a single record itself
KINDS = {
    "claude": {"lists": ("conversations",), "inside": None},
    "grok": {"lists": ("conversations",), "inside": "messages"},
    "lm_studio": {"lists": (), "inside": ""},
    "openrouter": {"lists": ("data",), "inside": None},
    "catalog": {"lists": ("data",), "inside": None},
    "seeds": {"lists": (), "inside": None},
}


class _Numbers(json.JSONDecoder):
    """A decoder that reports where NaN and infinities stood; they are read as null."""

    def __init__(self):
        super().__init__(parse_constant=self.constant)
        self.odd = False

    def constant(self, _):
        self.odd = True


def _space(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    return at


def cut(text: str, kind: str) -> list[tuple[int, str]]:
    """(number, text) of the records of an export; ValueError if it is not one JSON value.

    A record in a list is wrapped as a list of one, so that its reader sees a file
    with that record alone.
    """
    spec = KINDS[kind]
    decoder = _Numbers()

    def value(at: int) -> tuple[object, str, int]:
        decoder.odd = False
        found, end = decoder.raw_decode(text, at)
        return found, json.dumps(found, ensure_ascii=False) if decoder.odd else text[at:end], end

    def elements(at: int) -> tuple[list[str], int, object]:
        out, first = [], None
        at = _space(text, at + 1)
        while text[at:at + 1] != "]":
            found, raw, at = value(at)
            first = found if not out else first
            out.append(raw)
            at = _space(text, at)
            if text[at:at + 1] == ",":
                at = _space(text, at + 1)
                if text[at:at + 1] == "]":
                    raise ValueError("comma before the end of a list")
            elif text[at:at + 1] != "]":
                raise ValueError(f"no comma between elements at character {at}")
        return out, at + 1, first

    at = _space(text, 1 if text[:1] == "﻿" else 0)
    if text[at:at + 1] == "[" and spec["inside"] != "":
        out, end, first = elements(at)
        if spec["inside"] and not (isinstance(first, dict) and first.get(spec["inside"]) is not None):
            out = ["[" + ",".join(out) + "]"] if out else []
        else:
            out = [f"[{raw}]" for raw in out]
    elif text[at:at + 1] == "{" and spec["lists"]:
        out, rest, listed = [], [], False
        at = _space(text, at + 1)
        while text[at:at + 1] != "}":
            key, at = decoder.raw_decode(text, at)
            at = _space(text, at)
            if not isinstance(key, str) or text[at:at + 1] != ":":
                raise ValueError(f"no member at character {at}")
            at = _space(text, at + 1)
            if key in spec["lists"] and text[at:at + 1] == "[":
                raws, at, _ = elements(at)
                listed, out = True, [f'{{{json.dumps(key)}: [{raw}]}}' for raw in raws]
            else:
                _, raw, at = value(at)
                rest.append(f"{json.dumps(key)}: {raw}")
            at = _space(text, at)
            if text[at:at + 1] == ",":
                at = _space(text, at + 1)
                if text[at:at + 1] == "}":
                    raise ValueError("comma before the end of an object")
            elif text[at:at + 1] != "}":
                raise ValueError(f"no comma between members at character {at}")
        end = at + 1
        out = out if listed else ["{" + ", ".join(rest) + "}"]
    else:
        _, raw, end = value(at)
        out = [raw]
    if _space(text, end) != len(text):
        raise ValueError(f"text after the JSON value at character {end}")
    return list(enumerate(out))


def records(docs: DataFrame, kind: str, limit: int = RECORD_BYTES) -> DataFrame:
    """Documents (path, text) as records (path, base, text, reject).

    ``base`` numbers the records of a file. Null and empty files are rejects.
    """
    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = cut(text or "", kind)
                except (ValueError, IndexError, RecursionError) as problem:
                    yield _row([(path, None, None, f"not one JSON value: {problem}")])
                    continue
                part, size = [], 0
                for n, raw in found:
                    if len(raw) > limit // 4 and len(raw.encode("utf-8", "surrogatepass")) > limit:
                        part.append((path, n, None, f"record {n} is longer than {limit} bytes"))
                    else:
                        part.append((path, n, raw, None))
                        size += len(raw)
                    if size > 1 << 22:
                        yield _row(part)
                        part, size = [], 0
                if part:
                    yield _row(part)

    return docs.select("path", "text").mapInArrow(run, "path string, base long, text string, reject string")


def _row(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["path", "base", "text", "reject"])


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Non-blank lines of files as (path, idx, text); ``idx`` counts them in each file.

    Files are split as Spark splits them: lines are numbered within their split,
    and splits by the counts of those before, so no file is one task.
    """
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("path"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    lines = lines.where(~F.regexp_like("text", F.lit(r"(?U)^[\s\x1c-\x1f﻿]*$")))
    before = lines.groupBy("path", "at").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.coalesce(F.sum("c").over(  # one row per split of a file
        Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    here = lines.withColumn("i", F.row_number().over(Window.partitionBy("path", "at").orderBy("n")) - 1)
    return here.join(before, ["path", "at"]).select("path", (F.col("i") + F.col("before")).alias("idx"), "text")
