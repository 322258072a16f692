"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .byte_bpe import op13_byte_bpe
from .importance import op11_importance
from .licenses import op3_licenses
from .merkle import op12_merkle
from .order_minhash import op6_order_minhash
from .packing import op10_packing
from .quality import op2_quality
from .secrets import op4_secrets
from .sentencepiece_scan import op5_sentencepiece
from .simhash import op8_simhash
from .simple8b import op1_simple8b
from .token_counts import op9_token_counts
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simple8b": op1_simple8b,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_order_minhash": op6_order_minhash,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_importance": op11_importance,
    "op12_merkle": op12_merkle,
    "op13_byte_bpe": op13_byte_bpe,
}

#: The others need tokenizers, hashes or fingerprints that DuckDB has no function for; tests/llm holds each against a brute-force version.
SQL: dict[str, str] = {"op11_importance": oracles.IMPORTANCE, "op12_merkle": oracles.MERKLE}
