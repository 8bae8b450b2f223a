"""The operators' queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm.audio import op1_audio
from pairforge.llm.bpe_reuse import op2_bpe
from pairforge.llm.branch_merge import ORACLE as MERGE_SQL
from pairforge.llm.branch_merge import op11_merge
from pairforge.llm.hostrep import ORACLE as HOSTS_SQL
from pairforge.llm.hostrep import op9_hosts
from pairforge.llm.order_minhash import op6_near
from pairforge.llm.ordinal_tox import op10_toxicity
from pairforge.llm.packing import op5_packing
from pairforge.llm.ppm import op7_ppm
from pairforge.llm.secrets import op4_secrets
from pairforge.llm.spelling import ORACLE as SPELLING_SQL
from pairforge.llm.spelling import op13_spelling
from pairforge.llm.stream_dedup import ORACLE as EXACT_SQL
from pairforge.llm.stream_dedup import op12_exact
from pairforge.llm.topk import ORACLE as TOPK_SQL
from pairforge.llm.topk import op8_topk
from pairforge.llm.warc_index import ORACLE as WARC_SQL
from pairforge.llm.warc_index import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio": op1_audio,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_near": op6_near,
    "op7_ppm": op7_ppm,
    "op8_topk": op8_topk,
    "op9_hosts": op9_hosts,
    "op10_toxicity": op10_toxicity,
    "op11_merge": op11_merge,
    "op12_exact": op12_exact,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op8_topk": TOPK_SQL,
    "op9_hosts": HOSTS_SQL,
    "op11_merge": MERGE_SQL,
    "op12_exact": EXACT_SQL,
    "op13_spelling": SPELLING_SQL,
}
