"""The queries of this subpackage: one to an operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm import decontamination, line_dedup, mixing, pii, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_output

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_output": token_output.op7_token_output,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_sharding": sharding.op10_sharding,
    "pipeline": corpus_pipeline.run,
}

#: The other operators hash, compress, tokenise or measure edit distances in ways that SQL has no words for.
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE_SQL}
