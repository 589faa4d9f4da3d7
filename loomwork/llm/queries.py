"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, lines, sharding
from .bpe import op3_byte_bpe
from .chat import op10_chat
from .media import op8_media
from .sharding import op9_sharding
from .surrogates import op6_pii
from .toxicity import op7_toxicity
from .training_order import op2_training_order

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_training_order": op2_training_order,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_media": op8_media,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.SQL,
    "op4_ngram_jaccard": jaccard.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op9_sharding": sharding.SQL,
}
