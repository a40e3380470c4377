"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op9_benchmark_leaks
from .fingerprints import op3_fingerprints
from .html_text import op4_html_extraction
from .line_dedup import op2_line_dedup
from .ngram_join import op1_ngram_jaccard
from .packing import op6_best_fit_packing
from .repeats import op7_suffix_array_repeats
from .token_files import op5_token_files
from .toxicity import op10_toxicity
from .url_filter import OP8_SQL, op8_url_filter


def queries() -> dict:
    import corpus_pipeline

    found = [op1_ngram_jaccard, op2_line_dedup, op3_fingerprints, op4_html_extraction, op5_token_files, op6_best_fit_packing, op7_suffix_array_repeats, op8_url_filter, op9_benchmark_leaks, op10_toxicity]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    return {"op8_url_filter": OP8_SQL}
