"""Queries of the operators and their SQL twins."""

from __future__ import annotations

from .byte_bpe import op10_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import OP1_SQL, op1_decontaminate
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard_join import OP2_SQL, op2_jaccard_join
from .language_id import op5_language_id
from .license_scan import op3_license_scan
from .line_dedup import op9_line_dedup
from .lm_scoring import op8_lm_scoring
from .mixing import OP11_SQL, op11_mix_sources
from .secret_scan import op6_secret_scan
from .token_packing import op7_token_packing
from .topk_search import OP4_SQL, op4_topk_search

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_topk_search": op4_topk_search,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_packing": op7_token_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_mix_sources": op11_mix_sources,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

#: The others learn or read byte tables, or are too slow in SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op4_topk_search": OP4_SQL,
                            "op11_mix_sources": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_collocations": OP13_SQL}
