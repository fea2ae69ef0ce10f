"""From raw documents to packed sequences: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; run()
writes it as Parquet to the shared folder and reads it again as the next stage's docs. All stages but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table, write_shared
from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.language import keep_spoken
from lodestone.llm.neardup import keep_one_of_each
from lodestone.llm.packing import packed_sequences
from lodestone.llm.secrets import mask_secrets

STAGES = [
    ("language_id", keep_spoken),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", packed_sequences),
]

#: The tokenizer and the language model are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return docs
