"""A training corpus from raw documents: quality classifier, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.  Null texts count as
empty everywhere.  An empty table passes through as an empty one.  Stages that run Python leave their session's Arrow
batches at 8 MB unless it sets them itself, for the results they return are read later; run() puts that back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import BATCH_BYTES, small_batches, table, written
from broadsheet.llm.exact_dedup import exact_dedup
from broadsheet.llm.mixing import drawn
from broadsheet.llm.packing import pack, piece_tokens
from broadsheet.llm.quality import keep_quality
from broadsheet.llm.simhash import near_groups

#: Shares of the expected tokens after the quality classifier has taken the low-quality documents out.
MIXTURE = {"clean": 0.97, "toxic": 0.03, "low": 0.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


#: Up to so many ids of dropped documents are broadcast (about 64 MB); beyond it the documents are shuffled by id
#: instead, with the same result.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the given ids; rows with a null id stay."""
    ids = written(gone.select("doc_id"))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest original, then the smallest id."""
    return _without(docs, exact_dedup(docs).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8 or more) the document with the smallest id stays."""
    small_batches(spark)
    return _without(docs, near_groups(docs).where("doc_id <> component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, its fraction decided by a draw from its id.  Tokens are those that the
    next stage packs.  Domains are learnt from all labelled documents, for most of one have been rejected by now."""
    from public_tokenizers import path

    small_batches(spark)
    tokens_of = piece_tokens(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return drawn(docs, table(spark, sf_dir, "labels"), MIXTURE, tokens_of=tokens_of, taught=table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece and the sequence that holds it."""
    from public_tokenizers import path

    small_batches(spark)
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the fingerprints or the tokens; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_BYTES, None)
    try:
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)
    return docs
