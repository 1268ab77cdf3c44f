"""A training corpus from raw documents: language, near duplicates, contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents, also where these are named like columns that an operator adds. An empty table
goes through every stage as an empty one. What each does with odd rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.common import materialize, table
from verdigris.llm.decontaminate import decontaminated
from verdigris.llm.jaccard import deduplicated
from verdigris.llm.langid import accepted
from verdigris.llm.packing import packed
from verdigris.llm.pii import sanitised

#: Documents are near copies from this share (in percent) of common word shingles of this length on; op6 has its own rule.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, and texts without a letter.

    Short, mixed and ambiguous texts stay, with whatever language is nearest. Rows with repeated or null ids are judged each by
    their text. Where no row has a language to learn from, texts with letters stay, and a warning says so.
    """
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null ids come last).

    Rows that share an id and differ in text are different documents; texts without words are in no group and stay; texts of fewer
    than five words are near copies where all their words are the same.
    """
    return deduplicated(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or more go.

    Null and empty texts hold nothing and stay; items with null ids or without words match nothing; with an empty benchmark all stay.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets and the terms that reveal them leave the texts; no document goes.

    Null texts stay null; rows with repeated or null ids are changed each by their own text; texts without matches are never changed.
    """
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the corpus, one row per piece of a document; a null or empty text is a piece with the end token alone."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Trained models, exact near-duplicate joins and token ids can't be written as SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
