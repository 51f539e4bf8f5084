"""A text corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe_codec, decontam, line_align, near_copies, ppm_lang
from loomline.llm.common import held_out, if_small, job, load, row_key, written

#: A language below this share of the total probability is no better than a guess among the languages.
MIN_LANGUAGE_SCORE = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two more columns, the key that near_copies.groups names its rows by."""
    return docs.withColumns(dict(zip(("__did", "__th"), row_key(), strict=True)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, in no language learned or with no likely one go. Each row is judged by its own text."""
    return ppm_lang.identified(docs, ppm_lang.train(docs.where(~held_out())), MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks they share with earlier ones; those that nothing is left of go."""
    return line_align.apply_to_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word Jaccard of 0.8 or above), that of lowest doc_id.

    SimHash fingerprints and pivot distance tables bring close copies together, prefix filtering all
    other pairs at 0.8 or above; both kinds are verified on the shingles.
    Each row is judged by its own text: rows that share an id, or have none, go only if their texts
    are in a group. A null id is after all others, equal ids are in the order of a hash of their texts.
    Only rows that go, and those that occur several times, are joined to the texts: few beside those that stay.
    """
    key = ["__did", "__th"]
    found = near_copies.groups(docs).withColumnsRenamed({"did": "__did", "th": "__th"})
    stays = (F.col("__did") == F.col("first_did")) & (F.col("__th") == F.col("first_th"))
    gone = if_small(found.where(~stays).select(*key), "pipeline-gone")
    several = if_small(found.where(stays & (F.col("rows") > 1)).select(*key), "pipeline-several")
    left = _keyed(docs).join(gone, key, "left_anti")
    once = left.join(several, key, "left_semi").dropDuplicates(key)
    return left.join(several, key, "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean_documents(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, with the bytes that its ids decode to."""
    done = bpe_codec.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: No stage but decontamination can be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's rows written to the shared folder for the next; what it needed besides is deleted then."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with job(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-stage-{k}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
