"""A corpus pipeline of five stages, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and rereads it as the next stage's documents. All
stages but the last return the columns of ``documents``. Stages that decide on a text
alone filter it where it is read; only near-duplicate removal and the final ordered
output exchange texts. Null and empty texts, repeated rows and empty tables are treated
as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm import decontaminate, mixing, quality, simhash, token_output
from recallgrid.llm.common import scratch_dir, table, tokenizer_path, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more; the model learns from the labels of these documents."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model, quality.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, simhash.SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domain, language and source, each once at most."""
    return mixing.mix_documents(docs, mixing.source_domain(), mixing.FRACTION, mixing.WEIGHTS, mixing.SEED)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files in order of doc_id; a row per document, read back from them."""
    out_dir = scratch_dir(spark, "pipeline-tokens")
    token_output.write_token_files(docs, out_dir, tokenizer_path("byte_bpe_50k.json"), 50_257)
    return token_output.read_token_files(spark, out_dir)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_files", token_files),
]

#: SQL can express neither the classifier nor the tokenizer. Tests hold near-duplicate removal against brute force on
#: planted pairs, and the other stages' operators against brute force or by hand; the pipeline itself by counts and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
