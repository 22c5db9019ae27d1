"""The registered queries of this subpackage and, where SQL can say them, their DuckDB text."""
from __future__ import annotations

import corpus_pipeline
from plansift.llm import (classifier, conversations, embeddings, licences, lm_scoring, manifest, mixing, packing, pii, quality_rules,
                          sharding, simhash, substrings)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substrings": substrings.op2_substrings,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_classifier": classifier.op9_classifier,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_conversations": conversations.op11_conversations,
    "op12_licences": licences.op12_licences,
    "op13_manifest": manifest.op13_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op2_substrings": substrings.ORACLE, "op3_embeddings": embeddings.ORACLE,
          "op4_quality_rules": quality_rules.ORACLE, "op11_conversations": conversations.ORACLE, "op13_manifest": manifest.ORACLE}
