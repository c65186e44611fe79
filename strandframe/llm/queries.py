"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .embeddings import op8_embedding_dedup
from .licenses import op9_license_scan
from .lines import op7_line_dedup
from .mixing import op5_source_mixing
from .oracles import LINES, SUBSTRINGS, VECTORS
from .quality import op6_quality_rules
from .secrets import op2_secret_scan
from .simhash import op10_simhash
from .substrings import op4_substring_dedup
from .subword import op1_sentencepiece
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_secret_scan, op3_toxicity, op4_substring_dedup, op5_source_mixing, op6_quality_rules, op7_line_dedup, op8_embedding_dedup, op9_license_scan, op10_simhash)
}
ORACLES = {"op4_substring_dedup": SUBSTRINGS, "op7_line_dedup": LINES, "op8_embedding_dedup": VECTORS}
