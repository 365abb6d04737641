"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import collocations, decontaminate, line_dedup, mixing, ngram_join, periodic_runs, pii, quality, sharding, tiff, token_store, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_tiff": tiff.op7_tiff,
    "op8_token_ids": token_store.op8_token_ids,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_collocations": collocations.op12_collocations,
    "op13_sharding": sharding.op13_sharding,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op11_periodic_runs": periodic_runs.ORACLE, "op12_collocations": collocations.ORACLE, "op13_sharding": sharding.ORACLE}
