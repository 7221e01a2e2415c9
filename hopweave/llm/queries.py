"""The queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import ORACLE as DECONTAMINATION_ORACLE
from .decontaminate import op7_decontamination
from .hash_forest import op5_nearest
from .html_text import op9_html_text
from .near_dup import ORACLE as NEAR_DUP_ORACLE
from .near_dup import op4_minhash_hamming
from .pii import op1_pii
from .quotes import ORACLE as QUOTES_ORACLE
from .quotes import op2_quote_links
from .secrets import op3_secrets
from .sentencepiece_codec import op8_sentencepiece
from .token_counts import op10_token_rollup
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quote_links": op2_quote_links,
    "op3_secrets": op3_secrets,
    "op4_minhash_hamming": op4_minhash_hamming,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_text": op9_html_text,
    "op10_token_rollup": op10_token_rollup,
}

ORACLES: dict[str, str] = {"op2_quote_links": QUOTES_ORACLE, "op4_minhash_hamming": NEAR_DUP_ORACLE, "op7_decontamination": DECONTAMINATION_ORACLE}
