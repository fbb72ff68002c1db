"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from .ann import op4_nearest
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .jaccard_join import OP10_SQL, op10_jaccard_join
from .language_id import op1_language_id
from .lm_score import op3_lm_score
from .packing import op6_best_fit_packing
from .pii import op7_pii
from .piece_bpe import op5_sentencepiece
from .suffix_dedup import op8_suffix_dedup
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_nearest": op4_nearest,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op9_warc": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
}
