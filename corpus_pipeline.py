"""Corpus pipeline over the ``documents`` table: language, near-duplicates,
personal data, source mix, packing.  Each stage's rows are written and read
again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from staywise.llm import langid, mix, pack, pii, simhash
from staywise.llm.common import prepare
from staywise.llm.queries import remainder, tokenizer_path
from staywise.session import checkpoint_dir
from staywise.sources.tables import table


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    prepare(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts (the least score that it
    accepts is calibrated on held-out training documents)."""
    prepare(spark)
    return langid.accepted(docs, langid.fit(docs.where(remainder() != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group."""
    prepare(spark)
    return simhash.one_of_each(docs, shingle_words=4, radius=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data masked by its kind."""
    return pii.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: per document and round, the words that it takes."""
    return mix.mixed_documents(docs, _folder(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece in sequences of 2048 ids."""
    prepare(spark)
    return pack.packed(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Fingerprints, draws and packing have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written to the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), _folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
