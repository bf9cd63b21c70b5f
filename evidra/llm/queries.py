"""Queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op6_byte_bpe
from .debruijn import op10_debruijn_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .importance import OP11_SQL, op11_importance_resampling
from .language_id import op5_language_id
from .near_dedup import OP13_SQL, op13_near_dedup
from .ngram_join import OP9_SQL, op9_ngram_jaccard_join
from .packing import op7_packing
from .spelling import OP12_SQL, op12_spelling_variants
from .topk_search import OP8_SQL, op8_exact_topk
from .toxicity import op4_toxicity
from .suffix_dedup import op1_suffix_array_dedup
from .url_filter import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_exact_topk": op8_exact_topk,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_debruijn_dedup": op10_debruijn_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_near_dedup": op13_near_dedup,
}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_exact_topk": OP8_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_near_dedup": OP13_SQL}
