"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from waymark.llm import bpe, decontaminate, extract, graph, langid, lm, quality, shards, simhash, suffixes

QUERIES = {
    "op1_extract": extract.op1_extract,
    "op2_langid": langid.op2_langid,
    "op3_simhash": simhash.op3_simhash,
    "op4_shards": shards.op4_shards,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_suffix_tree": lm.op6_suffix_tree,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_bpe": bpe.op8_bpe,
    "op9_repeats": graph.op9_repeats,
    "op10_quality": quality.op10_quality,
}
ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_repeats": graph.OP9_SQL,
}
