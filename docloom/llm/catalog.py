"""All queries of this subpackage."""

from docloom.llm import (  # noqa: F401
    op1_chaining,
    op2_toxicity,
    op3_decontaminate,
    op4_quality,
    op5_minhash,
    op6_language,
    op7_bpe,
    op8_token_counts,
    op9_pii,
    op10_suffix,
    op11_chat,
    op12_resample,
    op13_periodic,
)
from docloom.llm.common import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
