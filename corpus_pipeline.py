"""Corpus pipeline over ``documents``: quality, exact copies, near copies,
source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; the last returns one row per packed piece.

Cases: extra columns, also those named like a stage's own, go through unchanged;
null and empty texts are documents (equal to each other for both dedups, of
volume 1 for the mix, a single end token when packed); a null doc_id is the
smallest for exact dedup and never the one that near dedup keeps where another
is there; a null source is a source of its own; of repeated rows one is left;
very long texts are read whole; an empty table stays empty through all stages.
``run`` removes what a stage staged, and the table before, once a stage's own
is written; the packed result reads the last ones until the folder is cleaned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm.common import Staging, scratch
from tally.llm.exact_dedup import drop_exact_copies
from tally.llm.mixing import mix_sources
from tally.llm.packing import pack
from tally.llm.quality import keep_resampled
from tally.llm.queries import tokenizer
from tally.llm.simhash import drop_near_copies
from tally.sources.tables import read_table


#: Target weights of the mix, and that of every source not named.
SOURCE_WEIGHTS, OTHER_WEIGHT = {"src0": 2.0}, 1.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; those it rejects go."""
    return keep_resampled(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest doc_id)."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the smallest doc_id)."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that src0 gets twice the share of any other source."""
    return mix_sources(docs, SOURCE_WEIGHTS, other=OTHER_WEIGHT, keep_extra=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, by sequence and offset."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", packing),
]

#: SQL can express neither the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    staging = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = list(staging.live)
        with scratch():
            docs = staging.write(stage(spark, docs, sf_dir), name)
        staging.drop(*before)
    return STAGES[-1][1](spark, docs, sf_dir)
