"""A cleaning pipeline over documents: each stage works on what the stage before it kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, secret scans, packing. In all of them a null text is
empty, a long text is read whole, an empty table gives an empty one, and columns other than doc_id and text pass through
unread, whatever their names, but for n_chars, which follows redacted texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Scratch, free_name, table
from folio.llm.decontamination import drop_contaminated
from folio.llm.packing import pack
from folio.llm.quality_model import fit_folds, score
from folio.llm.secrets import redact_secrets
from folio.llm.set_join import keep_first

#: Documents that score less go.
MIN_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, gives MIN_SCORE or more.

    A score of MIN_SCORE stays. Equal texts get one score, so repeated rows stay or go together; empty ones are scored as any.
    """
    model, name = fit_folds(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "score")
    return score(docs, model, name).where(F.col(name) >= MIN_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of linked documents.

    Rows that repeat doc_id and text are one; empty texts link with nothing and all stay.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; empty ones hold none, equal ones go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated and empty ones too, with secrets and linked identifiers replaced."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 4096 tokens; repeated rows are packed as often, an empty text is its end id."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("packing", packing)]

#: A learned classifier and the packing plan can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and reread as the next one's docs; documents that any stage drops are in no later one."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}")
        if i:
            scratch.drop(f"{i - 1}")
    return docs
