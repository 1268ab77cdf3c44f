"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from verdigris.llm import chat, lmscore
from verdigris.llm.alignment import op11_token_alignment
from verdigris.llm.chat import op9_chat_formatting
from verdigris.llm.decontaminate import op4_benchmark_decontamination
from verdigris.llm.html import op1_html_extraction
from verdigris.llm.jaccard import op6_ngram_jaccard_join
from verdigris.llm.langid import op8_language_id
from verdigris.llm.licenses import op12_license_scans
from verdigris.llm.lmscore import op2_lm_scoring, op2_lm_scoring_bigrams, op2_lm_scoring_trigrams
from verdigris.llm.negatives import op13_hard_negatives
from verdigris.llm.neighbours import op7_nearest_neighbours
from verdigris.llm.packing import op10_best_fit_packing
from verdigris.llm.pii import op5_pii_sanitisation
from verdigris.llm.repeats import op3_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_lm_scoring,
        op2_lm_scoring_bigrams,
        op2_lm_scoring_trigrams,
        op3_suffix_array_dedup,
        op4_benchmark_decontamination,
        op5_pii_sanitisation,
        op6_ngram_jaccard_join,
        op7_nearest_neighbours,
        op8_language_id,
        op9_chat_formatting,
        op10_best_fit_packing,
        op11_token_alignment,
        op12_license_scans,
        op13_hard_negatives,
    )
}
ORACLES = {"op2_lm_scoring": lmscore.ORACLE_TRIGRAMS, "op2_lm_scoring_bigrams": lmscore.ORACLE_BIGRAMS, "op2_lm_scoring_trigrams": lmscore.ORACLE_TRIGRAMS, "op9_chat_formatting": chat.ORACLE}
