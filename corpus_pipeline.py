"""Documents to training windows: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import linededup, mixing, packing, quality, simhash
from loomline.llm.common import read, shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", linededup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("packing", packing.stage),
]

#: No stage but line dedup and mixing can be put in SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet to the shared folder and read again by the next.

    What a stage wrote is removed when the next one's is written; the input of
    the last stays, as the result is computed from it.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}"), True)
    return docs
