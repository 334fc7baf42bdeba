"""A corpus pipeline: language identification, near-deduplication, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever others there are. A row that no stage objects to reaches the last
one. Texts are taken whole, however long; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import Stages, discard, read
from quillspark.llm.decontamination import decontaminate
from quillspark.llm.language import held_out, identify, learn
from quillspark.llm.neardup import deduplicate
from quillspark.llm.packing import pack
from quillspark.llm.pii import redact


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or that share no n-gram with any language; profiles are learned from the rows' own lang.

    Null and empty texts go, as they have no letter. Where no row has a language, texts with a letter
    stay. Repeated rows are judged alike; ties between languages decide nothing here.
    """
    return identify(docs, learn(docs.where(held_out(5) != 0)), keep=0.0)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 of five-word shingles: the one of the least doc_id.

    Null, empty and wordless texts are linked with nothing and stay; rows of one doc_id all stay or all go; rows without one stay.
    """
    return deduplicate(docs, 5, 80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of ten benchmark words, and without documents more than half of whose words are such; one of exactly half stays.

    Null and empty texts have no words and stay. Repeated rows are treated alike.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses and numbers of persons replaced by their kind; of overlapping spans (a tie too) the first and longest names the kind.

    All rows stay; null and empty texts as they are, repeated rows alike.
    """
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids laid into sequences of 2048. Null and empty texts are their end id; repeated rows are packed each by itself, ties by doc_id and start."""
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: SQL can't express the language profiles, the field and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir. What a stage wrote is deleted when the next has read it, but for the last."""
    docs, work = read(spark, sf_dir, "documents"), Stages(spark)
    for name, step in STAGES[:-1]:
        docs = work(step(spark, docs, sf_dir), name)
        discard(spark, *work.paths[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
