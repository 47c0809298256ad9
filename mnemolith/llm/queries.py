"""Queries and SQL of the training-data operators, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_line_dedup as op1
from . import op4_near_dedup as op4
from . import op8_token_counts as op8
from . import op11_centroids as op11
from . import op12_warc_chunks as op12
from . import op13_filter_audit as op13
from .op2_transport_stream import op2_transport_stream
from .op3_token_files import op3_token_files
from .op6_sentencepiece import op6_sentencepiece
from .op5_toxicity import op5_toxicity
from .op7_fingerprints import op7_fingerprints
from .op9_quality import op9_quality
from .op10_mixing import op10_mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1.op1_line_dedup,
    "op2_transport_stream": op2_transport_stream,
    "op3_token_files": op3_token_files,
    "op4_near_dedup": op4.op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_counts": op8.op8_token_counts,
    "op8_tokenizer_counts": op8.op8_tokenizer_counts,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11.op11_centroids,
    "op12_warc_chunks": op12.op12_warc_chunks,
    "op13_filter_audit": op13.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": op1.SQL, "op4_near_dedup": op4.SQL, "op8_token_counts": op8.SQL, "op11_centroids": op11.SQL, "op12_warc_chunks": op12.SQL, "op13_filter_audit": op13.SQL}
