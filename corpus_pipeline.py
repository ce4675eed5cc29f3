"""A training corpus from `documents` in five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from korvine.llm import jaccard, language_id, line_dedup, mixing, packing
from korvine.llm.common import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence makes clear."""
    return language_id.accepted_documents(docs, language_id.fit(language_id.sample(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before in the corpus; those that lose every line go."""
    rest = line_dedup.survivors(line_dedup.rewritten(docs))
    return rest.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest doc_id (null last), and of its texts that of the smallest hash.

    Rows are told apart by a hash of doc_id and text, and of equal ones one stays. Rows without words are copies of none.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = jaccard.classes(keyed.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    found = jaccard.materialize(found.withColumnsRenamed({"doc_id": "_key", "component_id": "c"}))
    several = jaccard.materialize(found.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c"))
    members = found.join(several, "c").select("_key", "c")
    members = jaccard.materialize(keyed.select("_key", "doc_id").join(members, "_key").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("_key").alias("key"))
    first = members.groupBy("c").agg(F.min(place).alias("f")).select("c", F.col("f.key").alias("kept"))
    gone = jaccard.materialize(members.join(first, "c").where("_key <> kept").select("_key"))
    repeated = jaccard.materialize(found.where("n > 1").select("_key"))
    rest = keyed.join(gone, "_key", "left_anti")
    if not repeated.isEmpty():
        once = rest.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        rest = rest.join(repeated, "_key", "left_anti").unionByName(once)
    return rest.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Language models, fuzzy lines and tokenizing have no SQL form; the tests hold near_copies and the operators of the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
