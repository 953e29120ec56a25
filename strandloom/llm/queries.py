"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from strandloom.llm import chat, exact_dedup, filter_audit, fim, secrets, url_lists
from strandloom.llm.chat import op2_chat
from strandloom.llm.compression import op13_quality
from strandloom.llm.exact_dedup import op1_exact_dedup
from strandloom.llm.filter_audit import op11_filter_audit
from strandloom.llm.fim import op12_fill_in_middle
from strandloom.llm.language import op6_language
from strandloom.llm.mixing import op8_mixing
from strandloom.llm.packing import op7_packing
from strandloom.llm.secrets import op4_secrets
from strandloom.llm.simhash import op9_simhash
from strandloom.llm.spotsigs import op5_spotsigs
from strandloom.llm.toxicity import op10_toxicity
from strandloom.llm.url_lists import op3_url_lists

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat": op2_chat,
    "op3_url_lists": op3_url_lists,
    "op4_secrets": op4_secrets,
    "op5_spotsigs": op5_spotsigs,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality": op13_quality,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_chat": chat.SQL,
    "op3_url_lists": url_lists.SQL,
    "op4_secrets": secrets.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_fill_in_middle": fim.SQL,
}
