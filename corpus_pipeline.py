"""A corpus made ready for training: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm import line_dedup, sentence_pieces, simhash_dedup, source_mix, toxicity
from cvengine.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; labels outside the held-out fold teach the model."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of line runs of 50 words or more."""
    return line_dedup.dedup_lines(docs, min_words=50)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at 4 bits or fewer, over shingles of 4 words."""
    return simhash_dedup.keep_first(docs, shingle_words=4, max_distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards weights that grow with the square root of a source's size, in a global random order."""
    return source_mix.replicate(docs, seed=17)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each remaining copy's whole text, and how many."""
    pieces = sentence_pieces.load_pieces(sentence_pieces.MODEL)
    encoded = sentence_pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces)
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("poisson_mix", mix_sources),
    ("sentence_pieces", encode_texts),
]

#: The toxicity model and the encoder have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
