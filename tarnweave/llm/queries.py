"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import hard_negatives, mixing, sharding
from .fingerprints import op10_document_fingerprints
from .hard_negatives import op12_hard_negatives
from .html_text import op1_main_text
from .language_id import op3_language_id
from .mixing import op9_source_mixing
from .packing import op5_best_fit_packing
from .sharding import op7_sharding
from .simhash import op4_simhash_near_dedup
from .token_files import op2_token_planes
from .toxicity import op6_toxicity
from .vector_graph import op8_embedding_near_dedup
from .window_packing import op11_window_packing
from .word_runs import op13_word_runs

QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_token_planes,
        op3_language_id,
        op4_simhash_near_dedup,
        op5_best_fit_packing,
        op6_toxicity,
        op7_sharding,
        op8_embedding_near_dedup,
        op9_source_mixing,
        op10_document_fingerprints,
        op11_window_packing,
        op12_hard_negatives,
        op13_word_runs,
    )
}

ORACLE_SQL = {"op7_sharding": sharding.ORACLE, "op9_source_mixing": mixing.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
