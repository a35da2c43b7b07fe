"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quaverlake.llm.bpe import op6_bpe
from quaverlake.llm.jaccard import op3_jaccard
from quaverlake.llm.language import op4_language
from quaverlake.llm.licences import op10_licences
from quaverlake.llm.linededup import op7_line_dedup
from quaverlake.llm.neardup import op9_near_dup
from quaverlake.llm.oracle import SQL as ORACLE
from quaverlake.llm.packing import op8_packing
from quaverlake.llm.pii import op1_pii
from quaverlake.llm.quality import op2_quality
from quaverlake.llm.secretscan import op11_secrets
from quaverlake.llm.spelling import op12_spelling
from quaverlake.llm.toxicity import op5_toxicity
from quaverlake.llm.trie import op13_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_near_dup": op9_near_dup,
    "op10_licences": op10_licences,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
