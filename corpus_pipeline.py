"""The corpus pipeline: quality rules, near copies, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``documents``;
the last returns the digests of the encoded documents, one row for each copy that the mix
takes. Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, near_copies, quality, secret_scan
from millrace.session import shared_folder

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", near_copies.stage),
    ("secret scan", secret_scan.stage),
    ("mixing sources", mixing.stage),
    ("byte-level BPE", bpe.stage),
]

#: Hashed likelihood ratios, a random forest and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
