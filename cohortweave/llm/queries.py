"""The operators as queries over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import align, bpe, centroids, langid, license_scan, minhash, neighbours, packing, quality
from cohortweave.llm import sentence_pieces, substring, toxicity
from cohortweave.llm import url_filter as urls
from cohortweave.llm.sql import ORACLE, RULES, SPAM
from cohortweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the library, and its place on the path of Python workers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return configure(spark)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ready(spark), sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, of: int, held: int) -> Column:
    """Whether a row is held out; rows without a key are not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == held, F.lit(False))


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar sets of two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", size=2)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    documents = table(spark, sf_dir, "documents")
    return bpe.round_trip(documents, "doc_id", "text", RANKS, public_tokenizers.PATTERN)


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = [urls.Rule(*r) for r in RULES]
    return urls.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", rules, SPAM)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in every text."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    learn = ~fold("doc_id", 3, 1)
    return toxicity.fit(*toxicity.sample(documents, labels, "doc_id", "text", "toxic", learn))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labelled rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, ["doc_id"], "text", model)
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality cascade; which rule failed depends on the order, so it is left out."""
    judged = quality.quality(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.expr(" or ".join(f"({r.fails})" for r in quality.BASE_RULES))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


def language_model(documents: DataFrame) -> langid.LanguageModel:
    return langid.fit(*langid.sample(documents, "doc_id", "text", "lang", ~fold("doc_id", 4, 2)))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    named = langid.identify(documents, ["doc_id"], "text", language_model(documents))
    return named.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without passages of smaller documents."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers go together in every text."""
    return align.align(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER, PIECES)


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and what they decode to."""
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", PIECES)


__all__ = ["ORACLE", "QUERIES"]
