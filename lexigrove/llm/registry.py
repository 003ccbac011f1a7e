"""Queries of the operators here, and their DuckDB SQL."""

from __future__ import annotations

from . import op4_chat_format as chat
from . import op13_centroid_clustering as centroids
from .op1_mpeg_audio import op1_mpeg_audio
from .op10_html_extraction import op10_html_extraction
from .op11_spelling_variants import op11_spelling_variants
from .op12_simhash import op12_simhash
from .op13_centroid_clustering import op13_centroid_clustering
from .op2_ngram_jaccard import op2_ngram_jaccard
from .op3_toxicity import op3_toxicity
from .op4_chat_format import op4_chat_format
from .op5_token_counts import op5_token_counts
from .op6_quality_rules import op6_quality_rules
from .op7_packing import op7_packing
from .op8_sentencepiece import op8_sentencepiece
from .op9_substring_dedup import op9_substring_dedup


def queries():
    return {f.__name__: f for f in (op1_mpeg_audio, op2_ngram_jaccard, op3_toxicity, op4_chat_format, op5_token_counts, op6_quality_rules, op7_packing, op8_sentencepiece, op9_substring_dedup, op10_html_extraction, op11_spelling_variants, op12_simhash, op13_centroid_clustering)}


def oracle_sql():
    return {"op4_chat_format": chat.ORACLE_SQL, "op13_centroid_clustering": centroids.ORACLE_SQL}
