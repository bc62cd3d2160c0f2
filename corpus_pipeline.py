"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, source mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import release, released, stored, table, tuned
from lectern.llm.decontam import stage_decontam
from lectern.llm.langid import stage_langid
from lectern.llm.mixing import stage_mixing
from lectern.llm.sharding import stage_sharding
from lectern.llm.simhash import stage_simhash

STAGES = [
    ("langid", stage_langid),
    ("simhash", stage_simhash),
    ("decontam", stage_decontam),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: Hash functions and trained models of the stages have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage is written as Parquet and reread as the next one's documents.

    The tables that a stage wrote for itself are removed once its result is written, its result once the next one's is;
    those of the last stage when the application ends. An empty table gives no rows; nulls, empty and long texts, repeated
    rows and further columns: as each stage states.
    """
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark) as kept:
            before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
