"""Queries of this package, and their SQL where DuckDB can express them."""

from docsift.llm import q_chat, q_licence, q_vafile
from docsift.llm.q_alignment import op13_token_alignment
from docsift.llm.q_chat import op1_preference_format
from docsift.llm.q_jaccard import op11_ngram_jaccard_join
from docsift.llm.q_licence import op4_license_scan
from docsift.llm.q_minhash import op2_minhash_near_dedup
from docsift.llm.q_mixing import op5_temperature_mix
from docsift.llm.q_packing import op10_best_fit_packing
from docsift.llm.q_pii import op6_pii_spans
from docsift.llm.q_quality import op8_llr_quality
from docsift.llm.q_sharding import op7_jump_sharding
from docsift.llm.q_simple8b import op3_simple8b_tokens
from docsift.llm.q_vafile import op9_va_file_topk
from docsift.llm.q_whitening import op12_jacobi_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_format,
        op2_minhash_near_dedup,
        op3_simple8b_tokens,
        op4_license_scan,
        op5_temperature_mix,
        op6_pii_spans,
        op7_jump_sharding,
        op8_llr_quality,
        op9_va_file_topk,
        op10_best_fit_packing,
        op11_ngram_jaccard_join,
        op12_jacobi_whitening,
        op13_token_alignment,
    )
}
SQL = {"op1_preference_format": q_chat.SQL, "op4_license_scan": q_licence.SQL, "op9_va_file_topk": q_vafile.SQL}
