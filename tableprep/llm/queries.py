"""Registry: one query per operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline

from .chat import OP7_SQL, op7_chat
from .compress_quality import op8_quality
from .cws import op12_cws
from .decontam import op4_decontam
from .hmm_lm import op2_hmm
from .laesa import OP13_SQL, op13_laesa
from .lemp import OP11_SQL, op11_lemp
from .mixing import OP1_SQL, op1_mix
from .quality_rules import op6_quality
from .secret_scan import op9_secrets
from .sharding import op10_shard
from .simhash import op3_simhash
from .toxicity import op5_toxicity

QUERIES = {
    "op1_mix": op1_mix,
    "op2_hmm": op2_hmm,
    "op3_simhash": op3_simhash,
    "op4_decontam": op4_decontam,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_shard": op10_shard,
    "op11_lemp": op11_lemp,
    "op12_cws": op12_cws,
    "op13_laesa": op13_laesa,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_mix": OP1_SQL,
    "op7_chat": OP7_SQL,
    "op11_lemp": OP11_SQL,
    "op13_laesa": OP13_SQL,
}
if PIPELINE_SQL is not None:
    ORACLES["pipeline"] = PIPELINE_SQL
