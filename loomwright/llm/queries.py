"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .embeddings import OP6_SQL, op6_embedding_dedup
from .fingerprints import op10_fingerprints
from .line_dedup import OP8_SQL, op8_line_dedup
from .minhash import OP1_SQL, op1_near_dedup
from .mixing import OP4_SQL, op4_mixing
from .packing import op9_packing
from .sharding import op7_sharding
from .token_counts import op2_token_counts
from .toxicity import op3_toxicity
from .urls import op5_url_filter

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
}
