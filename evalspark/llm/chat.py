"""Chat formatting by schema fingerprints.

Raw records come as JSON in whatever layout their source has. The nested paths of
a record's fields, sorted, are hashed; the fingerprint selects a
declarative mapping that says where the conversation, its turns, roles and texts
stand. So layouts are told apart by structure alone, an unknown one is set aside
with its fingerprint and paths, and a new source needs a new mapping, not code.

Canonical turns are formatted one by one and put together in order. Control
strings inside roles and texts are escaped by a joiner after their first sign
(and one more where a text already has joiners there), which is taken out again
by the reader. The loss mask covers the texts of assistant turns.
"""
from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import table, tune

# Marks of the template
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
# Control strings that are escaped in roles and texts (fixed values)
CONTROL = [
    ROLE, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|im_sep|>",
    "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>", "[MASK]", "[CLS]", "[SEP]", "[PAD]",
]
#: stands after the first sign of an escaped control string
JOINER = "⁠"
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}{JOINER}*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}{JOINER}+{re.escape(c[1:])}" for c in CONTROL))

# Declarative mappings: the paths a layout has (those with ? may be missing, and
# any may be null), and where its turns stand. "rows": each record is one turn.
# "list": a list of turns. "fields": roles in order and the fields of their texts.
MAPPINGS = {
    "turn_rows": {"paths": ["conv_id", "role", "text", "turn"], "id": "conv_id", "kind": "rows", "order": "turn", "role": "role", "text": "text"},
    "messages": {"paths": ["conv_id", "messages[].content", "messages[].role"], "id": "conv_id", "kind": "list", "list": "messages",
                 "role": "role", "text": "content"},
    "from_value": {"paths": ["conversations[].from", "conversations[].value", "id"], "id": "id", "kind": "list", "list": "conversations",
                   "role": "from", "text": "value"},
    "prompt_response": {"paths": ["id", "prompt", "response", "system?"], "id": "id", "kind": "fields",
                        "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"paths": ["completion", "id", "prompt"], "id": "id", "kind": "fields",
                          "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction": {"paths": ["id", "input?", "instruction", "output", "system?"], "id": "id", "kind": "fields",
                    "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "nested_dialog": {"paths": ["dialog.turns[].speaker", "dialog.turns[].utterance", "meta.id"], "id": "meta.id", "kind": "list",
                      "list": "dialog.turns", "role": "speaker", "text": "utterance"},
}
# Names that sources give to the three roles (fixed values)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; list elements share one path."""
    if isinstance(value, dict):
        found = set()
        for k, v in value.items():
            found |= paths(v, f"{at}.{k}" if at else k)
        return found
    if isinstance(value, list):
        found = set()
        for v in value:
            found |= paths(v, f"{at}[]")
        return found or {f"{at}[]"}
    return {at}


def fingerprint(fields) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def variants(mapping: dict) -> list[str]:
    """Fingerprints that select a mapping: with and without each field that may be missing, and with an empty or null list."""
    sets = [set()]
    for p in mapping["paths"]:
        sets = [s | {p.rstrip("?")} for s in sets] + ([set(s) for s in sets] if p.endswith("?") else [])
    if mapping["kind"] == "list":
        empty = {p for p in sets[0] if not p.startswith(mapping["list"] + "[]")} | {mapping["list"] + "[]"}
        missing = [s - {f"{mapping['list']}[].{mapping['text']}"} for s in sets]
        null = {p for p in sets[0] if not p.startswith(mapping["list"] + "[]")} | {mapping["list"]}
        sets += [empty, null, *missing]
    return [fingerprint(s) for s in sets]


def by_fingerprint(mappings: dict = MAPPINGS) -> dict[str, tuple[str, dict]]:
    found: dict[str, tuple[str, dict]] = {}
    for name, m in mappings.items():
        for f in variants(m):
            if found.setdefault(f, (name, m))[0] != name:
                raise ValueError(f"{name} and {found[f][0]} share a layout")
    return found


def _at(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _whole(value) -> bool:
    """Null or a 64-bit integer: what an id or an order may be."""
    return value is None or (type(value) is int and -2 ** 63 <= value < 2 ** 63)


def turns_of(record, mapping: dict) -> list[tuple]:
    """(conversation, order, role, text) of a record under its mapping."""
    who = _at(record, mapping["id"])
    if mapping["kind"] == "rows":
        return [(who, _at(record, mapping["order"]), _at(record, mapping["role"]), _at(record, mapping["text"]))]
    if mapping["kind"] == "list":
        return [(who, i, _at(t, mapping["role"]), _at(t, mapping["text"])) for i, t in enumerate(_at(record, mapping["list"]) or [])]
    out = []
    for role, fields in mapping["fields"]:
        values = [_string(_at(record, f)) for f in fields if _at(record, f) is not None]
        if values or role != "system":
            out.append((who, len(out), role, "\n\n".join(v for i, v in enumerate(values) if v or not i)))
    return out


def canonical(records: DataFrame, mappings: dict = MAPPINGS) -> DataFrame:
    """Turns (conv_id, turn, role, text, layout, fingerprint, raw) of JSON records (column ``record``).

    ``layout`` is null where no mapping has the fingerprint or the record is no
    JSON object, or where an id or order is neither null nor a 64-bit integer; then
    the turn's columns are null and ``raw`` keeps the record. Roles of other sources
    are renamed by ROLES; null roles and texts are empty; a text that is no string is
    kept as JSON. A known layout without turns gives no row. Repeated records give
    repeated turns; extra columns are ignored.
    """
    tune(records.sparkSession)
    known = by_fingerprint(mappings)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for raw in b.column(0).to_pylist():
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(paths(value)) if isinstance(value, dict) else None
                name, mapping = known.get(mark, (None, None))
                got = turns_of(value, mapping) if mapping else []
                if mapping is None or any(not _whole(x) for t in got for x in t[:2]):
                    out.append((None, None, None, None, None, mark, raw))
                    continue
                out += [(c, n, ROLES.get(r := _string(role), r), _string(text), name, mark, None) for c, n, role, text in got]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.string()) for i, c in enumerate(cols)], NAMES)

    return records.select(F.col("record").cast("string").alias("record")).mapInArrow(
        run, "conv_id long, turn long, role string, text string, layout string, fingerprint string, raw string")


NAMES = ["conv_id", "turn", "role", "text", "layout", "fingerprint", "raw"]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + JOINER + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the span of its text."""
    head = f"{ROLE}{escape(role)}{TEXT}"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from formatted turns."""
    out = []
    for part in formatted.split(END)[:-1]:
        head, _, body = part.partition(TEXT)
        out.append((unescape(head.removeprefix(ROLE)), unescape(body)))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chunk, loss_start, loss_end): formatted turns in order, with their loss mask.

    A conversation is its chunks by ``seq`` put together; the mask is a span of
    code points of the chunk (null: none). Turns are ordered by turn, role and
    text, nulls first; repeated rows are repeated turns; null conv_ids make one
    conversation. A conversation of any length passes through its task turn by
    turn and is never held as a whole.
    """
    def run(batches):
        now, seq = object(), 0
        for b in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seq = seq + 1 if conv == now else 0
                now = conv
                chunk, lo, hi = format_turn(role, text)
                out.append((conv, seq, chunk, *((lo, hi) if role == "assistant" else (None, None))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(cols)],
                                             ["conv_id", "seq", "chunk", "loss_start", "loss_end"])

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, seq long, chunk string, loss_start long, loss_end long")


def digests(chunks: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its chunks.

    Everything comes from the formatted text: turns by the reader, the loss from
    the masked spans.
    """
    def run(batches):
        class Conversation:
            def __init__(self, conv):
                self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
                self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

            def add(self, chunk, lo, hi):
                for role, text in read_turns(chunk):
                    self.n += 1
                    self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    text = unescape(chunk[lo:hi])
                    self.loss += len(text)
                    self.masked.update(text.encode("utf-8", "surrogatepass"))
                self.chars += len(chunk)

            def row(self):
                return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

        now, seen = None, False
        for b in batches:
            out = []
            for conv, chunk, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen or conv != now.conv:
                    if seen:
                        out.append(now.row())
                    now, seen = Conversation(conv), True
                now.add(chunk, lo, hi)
            yield _rows(out)
        if seen:
            yield _rows([now.row()])

    rows = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "chunk", "loss_start", "loss_end")
    return rows.mapInArrow(run, DIGESTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)],
                                      [c.split()[0] for c in DIGESTS.split(", ")])


#: a conversation in another layout than the table's, with control strings in its texts
EXTRA = {"conv_id": -7, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """Contract query: the table's turn rows and conversation -7 as a message list, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(
        F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    extra = spark.range(1).select(F.lit(json.dumps(EXTRA)).alias("record"))
    return digests(formatted(canonical(rows.unionAll(extra)).where("layout is not null")))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s as (select *, length(role) + length(text) + 23
    + len(regexp_extract_all(role, '(CONTROL)')) + len(regexp_extract_all(text, '(CONTROL)')) as chars from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from s group by conv_id
""".replace("CONTROL", "|".join(re.sub(r"([\[\]|/])", r"\\\1", c[0]) + JOINER + "*" + re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROL))
