"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from laminaspark.llm.dedup import OP6_SQL, op6_exact_dedup
from laminaspark.llm.encoding import op5_byte_bpe
from laminaspark.llm.html_text import op8_html_extraction
from laminaspark.llm.packing import op3_best_fit_packing
from laminaspark.llm.quality import op7_quality_classifier
from laminaspark.llm.sharding import op4_sharding
from laminaspark.llm.simhash import op10_simhash_near_dedup
from laminaspark.llm.sketches import op2_document_fingerprints
from laminaspark.llm.token_counts import op1_token_counts
from laminaspark.llm.url_rules import OP9_SQL, op9_url_filters

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_document_fingerprints, op3_best_fit_packing, op4_sharding, op5_byte_bpe, op6_exact_dedup, op7_quality_classifier, op8_html_extraction, op9_url_filters, op10_simhash_near_dedup)
}
ORACLE = {"op6_exact_dedup": OP6_SQL, "op9_url_filters": OP9_SQL}
