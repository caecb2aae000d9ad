"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import run
from shelfwatch.llm.bpe import op8_bpe
from shelfwatch.llm.fingerprints import op9_fingerprints
from shelfwatch.llm.jaccard import op11_jaccard
from shelfwatch.llm.licenses import op10_licenses
from shelfwatch.llm.mixing import OP4_SQL, op4_mixing
from shelfwatch.llm.neardup import op2_neardup
from shelfwatch.llm.repair import op13_repair
from shelfwatch.llm.substrings import op5_substrings
from shelfwatch.llm.tokencount import op3_token_counts
from shelfwatch.llm.topk import OP7_SQL, op7_topk
from shelfwatch.llm.toxicity import op1_toxicity
from shelfwatch.llm.warc import OP6_SQL, op6_warc
from shelfwatch.llm.whitening import op12_whitening

LLM_JOBS = {
    "op1_toxicity": op1_toxicity,
    "op2_neardup": op2_neardup,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_substrings": op5_substrings,
    "op6_warc": op6_warc,
    "op7_topk": op7_topk,
    "op8_bpe": op8_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_licenses": op10_licenses,
    "op11_jaccard": op11_jaccard,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
    "pipeline": run,
}
LLM_ORACLE = {"op4_mixing": OP4_SQL, "op6_warc": OP6_SQL, "op7_topk": OP7_SQL}
