"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .fingerprints import op11_fingerprints
from .html_text import op8_html_text
from .language_mix import op4_language_mix
from .media_chunks import OP5_PAYLOADS_SQL, op5_media_chunks, op5_payloads
from .ngram_join import OP7_LINKS_SQL, OP7_SQL, op7_ngram_join, op7_ngram_links
from .secret_scan import OP2_BASE_SQL, op2_base_spans, op2_secret_scan
from .sentencepiece_codec import op10_sentencepiece
from .source_divergence import OP12_SQL, op12_source_divergence
from .source_mix import OP6_SQL, op6_source_mix
from .topk_search import OP1_SQL, op1_topk_search
from .toxicity import op3_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_language_mix": op4_language_mix,
    "op5_media_chunks": op5_media_chunks,
    "op6_source_mix": op6_source_mix,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_text": op8_html_text,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_fingerprints": op11_fingerprints,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
    "op2_base_spans": op2_base_spans,
    "op5_payloads": op5_payloads,
    "op7_ngram_links": op7_ngram_links,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op2_base_spans": OP2_BASE_SQL,
    "op5_payloads": OP5_PAYLOADS_SQL,
    "op6_source_mix": OP6_SQL,
    "op7_ngram_join": OP7_SQL,
    "op7_ngram_links": OP7_LINKS_SQL,
    "op9_warc": OP9_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
