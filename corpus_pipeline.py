"""A corpus pipeline over documents: quality, repeated passages, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of documents, whatever their
names. An empty table gives an empty result in every stage; null and repeated ids, null, empty and
very long texts are rows like others, with the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import bpe, line_dedup, mixing, near_text, quality_gam, simhash
from kinloom.llm.common import table
from kinloom.llm.queries import tokenizer
from kinloom.shared import scratch, written

#: Rows that a Python worker holds at once.
ROWS = 512


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go. A null text is scored as the empty
    text; equal texts fare alike."""
    _few_at_once(spark)
    return quality_gam.keep_quality(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line passages, and of whole texts of one or two lines, go;
    every document stays. Documents are ordered by id, null first, then by text; of rows equal in both
    one counts as the first. A null text stays null."""
    return line_dedup.cleaned_documents(docs, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays. Candidates are what operator 4's ball hashing
    links on SimHashes of five-word shingles, and what shares a key of minima; those of Jaccard 0.8 or more are
    links. Null ids come last, and of rows that share the id one stays. Texts without a word, nulls included,
    are one group."""
    _few_at_once(spark)
    return simhash.deduplicated(docs, near_text.components)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or repeated so that sources meet their target weights;
    null is a source like others. A text without a word has size zero and may be left out."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too; a null text has no tokens."""
    _few_at_once(spark)
    return bpe.round_trip(docs, *tokenizer(), keep=False)  # idle workers would hold tables while other stages run


def _few_at_once(spark: SparkSession) -> None:
    """Texts go to Python workers ROWS at a time in this session, as stages of several kinds share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("mixing", mixing_stage),
    ("byte-level BPE", tokens),
]

#: No SQL: the classifier's training, the hashes and the token ids are beyond DuckDB's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept. Of what they wrote only the last one's result stays, as that is read."""
    docs = table(spark, sf_dir, "documents")
    *first, (last, stage_before_tokens) = STAGES[:-1]
    with scratch(spark):
        for name, stage in first:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        docs = written(stage_before_tokens(spark, docs, sf_dir), last, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}
