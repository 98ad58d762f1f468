"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from tallyfold.llm import byte_bpe, centroids, conversations, decontaminate, html_text, licenses, near_dup, quality, secrets, sharding, token_files, top_k, toxicity
from tallyfold.llm.oracle import ORACLE as ORACLE

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_html_text": html_text.op8_html_text,
    "op9_top_k": top_k.op9_top_k,
    "op10_quality": quality.op10_quality,
    "op11_centroids": centroids.op11_centroids,
    "op12_conversations": conversations.op12_conversations,
    "op13_sharding": sharding.op13_sharding,
}
