"""The operators' queries over their whole tables, and SQL where it exists."""

from __future__ import annotations

from quillon.llm.jaccard_join import JACCARD_SQL, op3_jaccard_join
from quillon.llm.language_id import op9_language_id
from quillon.llm.line_dedup import op7_line_dedup
from quillon.llm.piece_codec import op6_piece_codec
from quillon.llm.lm_scoring import op8_lm_scoring
from quillon.llm.packing import op2_packing
from quillon.llm.quality_rules import op5_ngram_quality
from quillon.llm.sharding import op4_jump_sharding
from quillon.llm.token_store import op1_token_store
from quillon.llm.topk_search import TOPK_SQL, op10_topk_search

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_jump_sharding": op4_jump_sharding,
    "op5_ngram_quality": op5_ngram_quality,
    "op6_piece_codec": op6_piece_codec,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_topk_search": op10_topk_search,
}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": JACCARD_SQL,
    "op10_topk_search": TOPK_SQL,
}
