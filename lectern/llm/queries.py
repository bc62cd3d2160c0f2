"""Queries of the pipeline operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ann
from .codes import OP11_SQL, op11_codes
from .decontam import OP5_SQL, op5_decontam
from .langid import op1_langid
from .licences import op10_licences
from .lines import op9_lines
from .mixing import OP7_SQL, op7_mixing
from .quality import OP12_SQL, op12_quality
from .ranked import OP13_SQL, op13_ranked
from .sharding import op6_sharding
from .simhash import op8_simhash
from .spans import OP3_SQL, op3_spans
from .toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = (op1_langid, op2_toxicity, op3_spans, op4_ann, op5_decontam, op6_sharding, op7_mixing, op8_simhash, op9_lines, op10_licences, op11_codes, op12_quality, op13_ranked)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_spans": OP3_SQL, "op5_decontam": OP5_SQL, "op7_mixing": OP7_SQL, "op11_codes": OP11_SQL, "op12_quality": OP12_SQL, "op13_ranked": OP13_SQL}
