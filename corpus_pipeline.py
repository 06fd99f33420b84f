"""A corpus from documents to sequences: five of the operators in roadloom.llm, one after another."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from roadloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go; the model learns from the documents that are there and have labels."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, n_chars follows, and documents of which nothing is left go."""
    return line_dedup.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, one stays."""
    return jaccard_join.one_of_each(docs, 5, Fraction(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids; fewer strings are cached than alone, as workers still hold what earlier stages left."""
    return packing.packed(docs, packing.tokenizer_path(), cached=300_000)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", dedup_documents), ("mixing", mix_sources), ("packing", pack)]

#: A trained model, a suffix array, graph components, seeded sampling and packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    before = None
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
