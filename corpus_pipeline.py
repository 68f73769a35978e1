"""A training corpus from documents: toxic texts out, copies out, near copies out, secrets blanked, tokens packed.

Every stage reads the whole of what its predecessor kept, which is written as Parquet in between. All but the last
return the columns of documents, whatever other columns there are. Null and empty texts are kept by every filter but
the one that finds them equal: of all empty texts one stays. Rows with a null id stay, but as copies; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import exact_dedup, ngram_join, packing, secrets, storage, tokens
from matchgrid.llm import toxicity as tox

#: What stages keep aside is under this tag, and stays until storage.clean(spark, TAG): their results are lazy.
TAG = "pipeline"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from the table of labels, does not call toxic. Repeated rows are scored
    each; a tie, 0.5, is toxic; null and empty texts score as texts without hits."""
    model = tox.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(tox.score_of(model, F.col("text")) < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str = TAG) -> DataFrame:
    """One document of each text, the one with the smallest id, nulls last; null counts as empty; of rows that repeat both
    id and text one stays."""
    return exact_dedup.drop_duplicates(docs, tag=tag)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str = TAG) -> DataFrame:
    """One document of each group of linked shingle sets, the one with the smallest id. Texts without words, and rows with a
    null id, stay; an id that several texts share goes only if all of them would."""
    return ngram_join.keep_one(docs, tag=tag)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str = TAG) -> DataFrame:
    """Pieces of documents in sequences, without their ids. A null or empty text is its end id; null sources are one queue."""
    return packing.pack(docs, tokens.default_path(), tag=tag, with_ids=False)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", blank_secrets), ("packing", pack)]

#: SQL cannot express the stages that learn, scan or tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written, and then what the stage kept aside is deleted, under tags of this run alone. Of the
    last, what its lazy result reads stays under TAG."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        own, kept = storage.new_tag(), storage.new_tag()
        docs = storage.written(stage(spark, docs, sf_dir, own) if stage in (exact, near) else stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), tag=kept if stage is not blank_secrets else TAG)
        storage.clean(spark, own)
        if before:
            storage.clean(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
