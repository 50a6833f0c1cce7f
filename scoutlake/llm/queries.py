"""The queries of this subpackage for the driver, and their SQL where SQL can express them (tokenisers, hashing families,
trained models and graph components are tested against brute force instead)."""

from __future__ import annotations

from . import divergence, repair, rules
from .chat import op8_chat_formatting
from .counts import op2_edit_aware_counts
from .divergence import op13_source_divergence
from .embeddings import op3_embedding_near_duplicates
from .fingerprints import op1_document_fingerprints
from .html import op10_html_main_text
from .packing import op4_best_fit_packing
from .quality import op5_quality_scores
from .repair import op12_conversation_repair
from .rules import op11_host_quality_rules
from .simhash import op6_simhash_near_duplicates
from .tokens import op7_bpe_round_trip
from .toxicity import op9_toxicity_scores

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_edit_aware_counts, op3_embedding_near_duplicates, op4_best_fit_packing, op5_quality_scores,
        op6_simhash_near_duplicates, op7_bpe_round_trip, op8_chat_formatting, op9_toxicity_scores, op10_html_main_text,
        op11_host_quality_rules, op12_conversation_repair, op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {op11_host_quality_rules.__name__: rules.ORACLE, op12_conversation_repair.__name__: repair.ORACLE, op13_source_divergence.__name__: divergence.ORACLE}
