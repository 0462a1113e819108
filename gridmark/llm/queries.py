"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .op01_scoring import op1_scoring
from .op02_embedding_dedup import op2_embedding_dedup
from .op03_chat import OP3_SQL, op3_chat
from .op04_quality import op4_quality
from .op05_packing import op5_packing
from .op06_bpe import op6_bpe
from .op07_suffix import op7_suffix
from .op08_sharding import op8_sharding
from .op09_ann import op9_ann
from .op10_simhash import op10_simhash

QUERIES = {
    "op1_scoring": op1_scoring,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_suffix": op7_suffix,
    "op8_sharding": op8_sharding,
    "op9_ann": op9_ann,
    "op10_simhash": op10_simhash,
}
ORACLE: dict[str, str] = {
    "op3_chat": OP3_SQL,
}
