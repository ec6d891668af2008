"""The stages of the corpus pipeline: each takes what the one before kept.

What holds for all of them: ``docs`` has the columns of ``documents`` and may
have more, whatever their names, which all but the last stage return as they
are. A null text counts as empty. Rows repeated in full are rows of their own.
An empty table gives an empty table. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphslice.llm import mixing as mixing_operator
from graphslice.llm import near_dup, packing as packing_operator, quality, queries, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio.

    Empty texts fail the rules. The ratio's target are the documents that
    ``labels`` calls good; rows with a null id are in none, and labels without
    a document do not matter. Equal texts have equal verdicts.
    """
    model = quality.fit(docs, queries.trusted_ids(queries.table(spark, sf_dir, "labels")))
    return quality.good_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    It is the one with the least id; null ids come last, and of rows equal in
    id and text any one stays. All texts without words are one class.
    """
    return near_dup.Duplicates(docs).one_of_each()


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and ``n_chars`` set anew where that was done.

    Null and empty texts stay as they are; equal rows are treated alike.
    """
    return secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, three times at most.

    Texts without words are never taken. A null source is a source of its own.
    Ties in the order of a source go by size, and a rerun takes the same.
    """
    return mixing_operator.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences of at most 1024 ids.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset,
    ids_crc32``. An empty text is the closing id alone; a document that the
    mix repeats has the pieces of each copy.
    """
    pieces = packing_operator.pack(docs, *queries.tokenizer_paths())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
