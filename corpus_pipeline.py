"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import minhash, packing, substring, toxicity
from cohortweave.llm.queries import TOKENIZER, language_model, table, toxicity_model
from cohortweave.llm.queries import ready as ready_for_queries
from cohortweave.llm.words import buffers, filter_texts
from cohortweave.session import materialize

#: From this score on a document is toxic; below that probability its language is not identified.
TOXIC, IDENTIFIED = 0.7, 0.5

#: Five stages run in the same Python workers one after the other. With fixed thresholds a worker's large
#: arrays go back to the system when they are freed, instead of staying with it for the stages to come.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the library, and how its Python workers treat freed memory."""
    spark.sparkContext.environment.update(MEMORY)
    return ready_for_queries(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    model = toxicity_model(docs, table(ready(spark), sf_dir, "labels"))
    pair: list = []

    def passes(texts) -> np.ndarray:
        if not pair:
            pair.append(model.compressors())
        data, offsets = buffers(texts)
        raw = toxicity.normalized(data).tobytes()
        spans = zip(offsets[:-1], offsets[1:], strict=True)
        return np.array([model.score(toxicity.saving(raw[a:b], pair[0])) < TOXIC for a, b in spans], bool)

    return filter_texts(docs, "text", passes)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language has a probability of at least IDENTIFIED."""
    ready(spark)
    model = language_model(docs)

    def passes(texts) -> np.ndarray:
        _, scores = model.predict(texts.fill_null("").to_pylist())
        return np.array(scores) >= IDENTIFIED

    return filter_texts(docs, "text", passes)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the one with the smallest doc_id.

    Rows are told apart by a 64-bit hash of all their columns, so that rows of one doc_id are judged
    each by its own text; of those that share a group's smallest doc_id the smallest hash stays.
    Rows without a doc_id come last. Rows that are equal in all columns are one, with words or
    without; other rows without words are near nothing and stay.
    """
    ready(spark)
    # The hash passes over nulls, so it is told where they are.
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    marked = docs.withColumn("__row", row)
    found = minhash.near_duplicates(marked, "__row", "text", size=5)
    rows = (
        found.groupBy("__row", "component_id")
        .agg(F.count("*").alias("n"))
        .join(marked.select("__row", "doc_id").distinct(), "__row")
    )
    rows = materialize(rows)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    first = rows.groupBy("component_id").agg(least.alias("f")).select("f.__row", F.lit(True).alias("stays"))
    judged = materialize(rows.join(first, "__row", "left"))
    # Only rows that occur more than once are shuffled once more to leave one of them.
    repeated = materialize(judged.where("stays and n > 1").select("__row"))
    single = marked.join(judged.where("stays is null or n > 1").select("__row"), "__row", "left_anti")
    one_each = marked.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return single.unionByName(one_each).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of documents with smaller doc_id; n_chars follows the text."""
    ready(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    made = substring.remove_repeats(docs, "doc_id", "text", with_text=True, carry=rest)
    made = made.withColumnRenamed("kept_text", "text")
    if "n_chars" in rest:
        n = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        made = made.withColumn("n_chars", n.otherwise(F.col("n_chars")))
    return made.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    ready(spark)
    return packing.pack_documents(docs, "doc_id", "text", TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifiers; every stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    ready(spark)
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir.rstrip("/"))
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
