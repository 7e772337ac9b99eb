"""Text, naming, time and cost column expressions used by ingest and runs."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.judges import WS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_prompt(text) -> Column:
    """Collapse every run of (Python-definition) whitespace to one space, strip."""
    return F.trim(F.regexp_replace(_c(text), f"(?U){WS}+", " "))


def content_hash(text) -> Column:
    """SHA-256 hex of the UTF-8 normalized text."""
    return F.sha2(normalize_prompt(text), 256)


def stored_content(text) -> Column:
    """Stored form: normalized unless the text has line breaks (kept verbatim)."""
    t = _c(text)
    return F.when(F.instr(t, "\n") > 0, t).otherwise(normalize_prompt(t))


def provider_family(name) -> tuple[Column, Column]:
    """(provider, family) from 'provider/rest'; provider 'unknown' without a
    slash; family = part of rest before the first '-', NULL when empty."""
    n = _c(name)
    has_slash = F.instr(n, "/") > 0
    provider = F.when(has_slash, F.substring_index(n, "/", 1)).otherwise(F.lit("unknown"))
    rest = F.when(has_slash, F.regexp_extract(n, "(?s)^[^/]*/(.*)$", 1)).otherwise(n)
    family = F.substring_index(rest, "-", 1)
    return provider, F.when(family != "", family)


def size_from_name(name) -> Column:
    """Parameter count in billions from a model name: '<num>b' word, else
    '<num>m' / 1000, case-insensitive; NULL if neither appears."""
    n = _c(name)
    b = F.regexp_extract(n, r"(?iU)\b(\d+(?:\.\d+)?)b\b", 1)
    m = F.regexp_extract(n, r"(?iU)\b(\d+(?:\.\d+)?)m\b", 1)
    return (F.when(b != "", b.cast("double"))
             .when(m != "", m.cast("double") / F.lit(1000.0)))


def epoch_to_timestamp(v) -> Column:
    """Epoch number to timestamp: milliseconds when > 1e10, else seconds."""
    x = _c(v).cast("double")
    secs = F.when(x > 1e10, x / 1000.0).otherwise(x)
    return F.timestamp_micros(F.round(secs * 1e6).cast("bigint"))


def parse_timestamp(v, numeric=None) -> Column:
    """ISO-8601 text ('Z' allowed, naive = UTC) or epoch number; bad -> NULL.

    ``numeric`` may carry the same value as a number when the source keeps
    JSON types apart (e.g. a JSON field that is a number, not a string)."""
    s = _c(v)
    iso = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))
    if numeric is None:
        return iso
    return F.coalesce(epoch_to_timestamp(numeric), iso)


def estimate_cost(tokens_in, tokens_out, cost_in_per_mtok, cost_out_per_mtok) -> Column:
    """NULL if a token count is NULL or both prices are NULL; else the sum over
    known prices of tokens / 1e6 * price."""
    ti, to, ci, co = map(_c, (tokens_in, tokens_out, cost_in_per_mtok, cost_out_per_mtok))
    part_in = F.when(ci.isNotNull(), (ti / F.lit(1000000.0)) * ci).otherwise(F.lit(0.0))
    part_out = F.when(co.isNotNull(), (to / F.lit(1000000.0)) * co).otherwise(F.lit(0.0))
    return F.when(ti.isNull() | to.isNull(), F.lit(None).cast("double")) \
            .when(ci.isNull() & co.isNull(), F.lit(None).cast("double")) \
            .otherwise(F.lit(0.0) + part_in + part_out)


def model_provider(local, provider) -> Column:
    """Chat provider for a model: local -> lm_studio; lm_studio/openrouter as
    registered; anything else goes through openrouter."""
    loc, p = _c(local), _c(provider)
    return (F.when(F.coalesce(loc, F.lit(False)), F.lit("lm_studio"))
             .when(p.isin("lm_studio", "openrouter"), p)
             .otherwise(F.lit("openrouter")))


_ENCODER = {"loaded": False, "enc": None}


def _encoder(name: str):
    if not _ENCODER["loaded"]:
        _ENCODER["loaded"] = True
        try:
            import tiktoken
            _ENCODER["enc"] = tiktoken.get_encoding(name)
        except Exception:  # noqa: BLE001 - no encoding files offline -> NULL counts
            _ENCODER["enc"] = None
    return _ENCODER["enc"]


def token_count(text, encoding: str = "cl100k_base") -> Column:
    """Optional tokenizer length (Arrow UDF); NULL when no tokenizer loads."""
    @F.pandas_udf("bigint")
    def _count(s: pd.Series) -> pd.Series:
        enc = _encoder(encoding)
        if enc is None:
            return pd.Series([None] * len(s), dtype="Int64")
        return pd.Series([None if x is None else len(enc.encode(x, disallowed_special=())) for x in s],
                         dtype="Int64")
    return _count(_c(text))
