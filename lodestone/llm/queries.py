"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_quality import op1_quality_classifier
from .op2_licenses import op2_license_scan
from .op3_toxicity import op3_toxicity
from .op4_rules import op4_quality_rules
from .op5_langid import op5_language_id
from .op6_decontam import OP6_SQL, op6_decontamination
from .op7_chat import OP7_SQL, op7_chat_formatting
from .op8_mix import OP8_SQL, op8_source_mix
from .op9_substrings import OP9_SQL, op9_substring_dedup
from .op10_jaccard import OP10_SQL, op10_ngram_jaccard_join
from .op11_phrases import OP11_SQL, op11_phrase_mining
from .op12_lines import OP12_SQL, op12_line_dedup
from .op13_search import OP13_SQL, op13_ranked_search

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_source_mix": op8_source_mix,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_line_dedup": op12_line_dedup,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {
    "op6_decontamination": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_source_mix": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
    "op11_phrase_mining": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
