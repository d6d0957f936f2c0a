"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from tracewell.llm.common import store, table
from tracewell.llm.decontamination import decontamination_stage
from tracewell.llm.mixing import mix_stage
from tracewell.llm.quality_rules import rules_stage
from tracewell.llm.simhash import simhash_stage
from tracewell.llm.token_output import token_stage

STAGES = [
    ("quality rules", rules_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID / binary output", token_stage),
]

#: Perplexities, fingerprints, edit distances and token ids have no DuckDB form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{k}")
    return docs
