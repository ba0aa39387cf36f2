"""A corpus made ready for training: filters, near copies, leaks, then packing.

Each stage takes what its predecessor kept, whole, as rows of ``documents``; the
last returns the placed pieces.  Null and repeated ids and null or empty texts are
rows like any other; columns of their own, whatever their names, stay as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontamination, language, packing, simhash_dedup, toxicity
from lorekeep.llm.queries import table
from lorekeep.llm.ship import ship
from lorekeep.llm.tables import free_name, stored
from lorekeep.llm.tokens import tokenizer_path

#: Languages of a training corpus, by code: those whose family is known.
LANGUAGES = sorted(code for codes in language.FAMILIES.values() for code in codes)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not call toxic."""
    ship(spark)
    model = toxicity.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    names = free_name(docs.columns, "score"), free_name(docs.columns, "predicted")
    return toxicity.score(docs, model, names).where(F.col(names[1]) == 0).select(*docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus, by the machines' prediction.

    Texts without a letter go, and so do texts that read like a label that is no
    language of ``LANGUAGES``.  Where no language could be learned, all texts with
    a letter stay.
    """
    ship(spark)
    model = language.learn(docs)
    if not model.languages:
        return language.with_letters(docs)
    names = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    return language.predict(docs, model, names).where(F.col(names[0]).isin(LANGUAGES)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id."""
    ship(spark)
    return simhash_dedup.one_row_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2,048 ids."""
    ship(spark)
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("language", with_language),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", in_sequences),
]

#: Learned filters and a packing have no form in SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
