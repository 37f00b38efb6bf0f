"""The corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the
shared folder and rereads it as the next stage's docs.

In every stage columns beyond those of documents pass through, whatever their names, and an empty table gives
no rows; what becomes of nulls, blank and repeated rows is stated with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumigate.llm import byte_bpe, line_dedup, mixing, ngram_join, quality, shared

MAX_REPETITION = 1.25
BPE_SHARE = 0.36  # executors that have run the other stages have less memory left for the transducer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is above their language's quantile go.

    A null or empty text goes; a null doc_id or language is judged like any other (by all languages together);
    repeated rows stay or go together; a text of any length is scored whole.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words or more are deleted; a document of which only blanks are left goes.

    Null, empty and blank texts stay as they are; a null doc_id sorts first; rows alike in doc_id and text count
    as one document and keep the same text.
    """
    return line_dedup.without_repeats(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of least doc_id stays.

    Of rows alike in doc_id and text one stays, and of rows that share a doc_id only those whose own text is linked to a
    smaller doc_id go. Texts without words stay. A row with a null doc_id goes where its component holds a doc_id;
    without one, all of the component stay, as none comes first.
    """
    return ngram_join.first_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought as near to each other as a repetition of 1.25 allows; every document stays at least once.

    A null source is a source of its own; null and blank texts have no tokens and stay once, or twice where the
    cut of their source's second round comes later; repeated rows are repeated alike.
    """
    return mixing.repeated(docs, max_repetition=MAX_REPETITION)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text encoded to token ids and decoded again: a row of digests a row.

    A null text is an empty one; a null doc_id stays null; repeated rows give equal rows.
    """
    return byte_bpe.round_trip(docs, share=BPE_SHARE)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", byte_bpe_stage),
]
ORACLE_SQL = None  # perplexities, components and token ids are beyond SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shared.Steps(spark) as steps:
        for k, (_, stage) in enumerate(STAGES):
            before, docs = docs, steps.write(stage(spark, docs, sf_dir), f"stage{k}", keep=k == len(STAGES) - 1)
            if k:
                steps.drop(before)
    return docs
