"""The queries of this subpackage. Most have no oracle in SQL: positions of
regular expressions, tokenizers, trained models, sketches and transforms are
tested against brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airops.llm import filters, negatives
from airops.llm.decontamination import op7_simhash_decontamination
from airops.llm.filters import op13_filter_interactions
from airops.llm.html import op9_html_bilstm
from airops.llm.jaccard import op12_jaccard_partition_join
from airops.llm.langid import op4_language_nb
from airops.llm.licenses import op8_license_minhash
from airops.llm.minhash import op5_minhash_bottom_k
from airops.llm.negatives import op11_multi_index_negatives
from airops.llm.packing import op3_nnls_packing
from airops.llm.quality import op2_line_quality
from airops.llm.secrets import op1_secret_ownership
from airops.llm.suffix import op10_bwt_repeats
from airops.llm.toxicity import op6_toxicity_nbsvm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_ownership, op2_line_quality, op3_nnls_packing, op4_language_nb, op5_minhash_bottom_k,
    op6_toxicity_nbsvm, op7_simhash_decontamination, op8_license_minhash, op9_html_bilstm, op10_bwt_repeats,
    op11_multi_index_negatives, op12_jaccard_partition_join, op13_filter_interactions)}

ORACLE_SQL: dict[str, str] = {"op11_multi_index_negatives": negatives.ORACLE_SQL,
                              "op13_filter_interactions": filters.ORACLE_SQL}
