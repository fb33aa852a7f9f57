"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from tidemark.llm.decontaminate import OP7_SQL, op7_decontaminate
from tidemark.llm.embdedup import OP4_SQL, op4_embeddings
from tidemark.llm.licenses import op2_licenses
from tidemark.llm.lm import op10_lm
from tidemark.llm.packing import op9_packing
from tidemark.llm.pii import op8_pii
from tidemark.llm.quality import op6_quality
from tidemark.llm.simhash import op3_simhash
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_embeddings": op4_embeddings,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_lm": op10_lm,
}
ORACLES = {
    "op4_embeddings": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_decontaminate": OP7_SQL,
}
