"""The corpus pipeline: documents that the quality classifier keeps, one of each near-duplicate group, without benchmark
passages and personal data, packed into sequences.

Edge cases, for run and every stage alone: a null text is judged as an empty one; empty texts are near duplicates of none,
so all of them stay; a null source, language or id is a value like others; repeated rows are rows of their own until
near_duplicates keeps one; rows that share an id but not a text are told apart; columns that documents doesn't have are cut
off at the start of a stage; an empty table of documents, labels or benchmark is no error: without labels the classifier
rejects nothing, without documents every stage is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import forget_at_exit, shared_dir, table
from larkspur.llm.decontaminate import decontaminate
from larkspur.llm.jaccard_join import keep_one_of_each
from larkspur.llm.packing import pack_documents
from larkspur.llm.pii import redact
from larkspur.llm.quality import keep_good

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, as low quality or as toxic."""
    return keep_good(docs.select(*DOCUMENTS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, a null id last."""
    return keep_one_of_each(docs.select(*DOCUMENTS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, whatever other rows have their id."""
    return decontaminate(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks."""
    return redact(docs.select(*DOCUMENTS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its sequence and its place there; a null text is packed as an empty one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier decides first, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    forget_at_exit(spark, place)
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{place}/{k}-{name}")
    return docs
