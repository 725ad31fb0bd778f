"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from slackline.llm import chat, ego_join, exact_dedup, mixing, ngram_join, packing, pii, quality, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_packing": packing.op2,
    "op3_toxicity": toxicity.op3,
    "op4_chat": chat.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_quality": quality.op6,
    "op7_warc": warc.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_pii": pii.op9,
    "op10_ego_join": ego_join.op10,
}

SQL = {
    "op1_mixing": mixing.op1_sql(),
    "op4_chat": chat.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_ego_join": ego_join.OP10_SQL,
}
