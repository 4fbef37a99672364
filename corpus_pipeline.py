"""A corpus pipeline over documents: toxicity, quality rules, near-duplicates, packing.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder in between. All but the last
return the columns of documents; the last returns the pieces of packed sequences. SQL can express neither the trained
scores of the first stage nor the retrieval order of the last, so the pipeline has no SQL; tests hold each stage against
a plain version on small tables.

Defined results, for all stages: columns other than doc_id and text pass through, whatever their names, but for the last
stage, which returns pieces only. Null text is the empty text: it has the model's score of an empty sentence, has too few words
for the quality rules, and so never reaches the later stages of run(). Rows without an id are kept and dropped by their
text like others; of near-duplicates they stay only if no row of their group has an id. Rows that repeat are judged
alike, and near-duplicates leave one of them. Without labels nothing is toxic. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitedrift.llm import minhash, packing, quality, toxicity
from sitedrift.llm.shared import stored

#: A document goes if its toxicity score is at least this.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the table of labels (a bounded sample, see toxicity.fit), scores below TOXIC."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, TOXIC)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more: the smallest id."""
    return minhash.one_of_each(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
