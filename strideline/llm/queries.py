"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .decontamination import OP1_SQL, op1_decontamination
from .katz import op2_katz
from .language import op5_language
from .quality import op10_quality
from .secrets import op7_secrets
from .simhash import op8_simhash
from .sketches import op3_sketches
from .token_store import op9_token_store
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_katz": op2_katz,
    "op3_sketches": op3_sketches,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_token_store": op9_token_store,
    "op10_quality": op10_quality,
}
ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op6_warc": OP6_SQL,
}
