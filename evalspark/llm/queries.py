"""Registered queries of the training-data operators, and SQL where SQL can say it."""
from __future__ import annotations

from evalspark.llm import chat, classifier, decontam, divergence, extract, packing, quality, simhash, spelling, suffixes, tokenfile, toxicity, urls

QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_chat": chat.op2_chat,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_tokens": tokenfile.op6_tokens,
    "op7_quality": quality.op7_quality,
    "op8_suffix": suffixes.op8_suffix,
    "op9_extract": extract.op9_extract,
    "op10_decontam": decontam.op10_decontam,
    "op11_divergence": divergence.op11_divergence,
    "op12_quality": classifier.op12_quality,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op9_extract": extract.ORACLE,
    "op10_decontam": decontam.ORACLE,
    "op11_divergence": divergence.ORACLE,
}
