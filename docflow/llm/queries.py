"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontamination import benchmark_proximity, op5_decontamination
from .fill_middle import op12_fill_middle
from .lm_scoring import op2_lm_scoring
from .media import op3_media, page_media
from .minhash_dedup import op8_minhash_dedup
from .ngram_join import op11_ngram_join
from .quality import op9_quality
from .oracles import ORACLES
from .run_dedup import op10_run_dedup
from .spelling import op13_spelling
from .substring_dedup import op1_substring_dedup
from .token_counts import op7_token_counts, token_recounts
from .toxicity import op6_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_media": op3_media,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_quality": op9_quality,
    "op10_run_dedup": op10_run_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_fill_middle": op12_fill_middle,
    "op13_spelling": op13_spelling,
    "page_media": page_media,
    "benchmark_proximity": benchmark_proximity,
    "token_recounts": token_recounts,
}

__all__ = ["ORACLES", "QUERIES"]
