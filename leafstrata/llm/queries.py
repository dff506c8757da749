"""Queries of this package and the SQL that checks them, where SQL can express one."""

from __future__ import annotations

from leafstrata.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from leafstrata.llm.mixing import OP10_SQL, op10_poisson_mixing
from leafstrata.llm.pieces import op7_sentencepiece
from leafstrata.llm.quality import op6_quality
from leafstrata.llm.secrets import op3_secret_scan
from leafstrata.llm.sharding import op8_sharding
from leafstrata.llm.simhash import op1_simhash_near_dedup
from leafstrata.llm.topk import OP2_SQL, op2_exact_top_k
from leafstrata.llm.toxicity import op9_toxicity
from leafstrata.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_poisson_mixing": op10_poisson_mixing,
}

ORACLE_SQL = {
    "op2_exact_top_k": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op10_poisson_mixing": OP10_SQL,
}
