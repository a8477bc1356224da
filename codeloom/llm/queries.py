"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .anisotropic import op1_mips
from .bpe import op9_bpe
from .huffman import op8_token_files
from .kd_search import OP4_SQL, op4_kd_search
from .language_id import op6_language
from .lexical import OP13_SQL, op13_lexical
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import op3_near_dedup
from .sharding import op11_sharding
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op5_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_mips": op1_mips,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_kd_search": op4_kd_search,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_sharding": op11_sharding,
    "op12_merkle": op12_merkle,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op4_kd_search": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op12_merkle": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
