"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from clickflow.llm.conversations import op13_conversation_repair
from clickflow.llm.decontaminate import op4_decontaminate
from clickflow.llm.embedding_dedup import op10_embedding_dedup
from clickflow.llm.html import op9_html_extraction
from clickflow.llm.language import op3_language_id
from clickflow.llm.line_dedup import op1_line_dedup
from clickflow.llm.mixing import op7_mixing
from clickflow.llm.ngram_join import op2_ngram_jaccard
from clickflow.llm.oracle import ORACLE
from clickflow.llm.pii import op5_pii
from clickflow.llm.suffix_dedup import op6_suffix_dedup
from clickflow.llm.token_alignment import op12_token_alignment
from clickflow.llm.topk_search import op11_topk_search
from clickflow.llm.toxicity import op8_toxicity

QUERIES = (
    op1_line_dedup,
    op2_ngram_jaccard,
    op3_language_id,
    op4_decontaminate,
    op5_pii,
    op6_suffix_dedup,
    op7_mixing,
    op8_toxicity,
    op9_html_extraction,
    op10_embedding_dedup,
    op11_topk_search,
    op12_token_alignment,
    op13_conversation_repair,
)


def llm_queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def llm_oracle() -> dict[str, str]:
    return dict(ORACLE)
