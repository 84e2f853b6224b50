"""A corpus pipeline over documents: language ID, near-duplicates, benchmark decontamination, packing.

In every stage a null in any other column, extra columns (whatever their names) and repeated rows pass through unchanged;
an empty table gives an empty one. What each stage does with null texts and ids, long texts and ties, its function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import decontamination, langid, packing, simhash
from kerbline.llm.common import scratch, written

END = 1


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labelled ones show; those without a letter, or far from every language, go.

    A null or empty text goes; a null id doesn't matter here; a text is read whole; of languages equally near, it's in the
    one that sorts first, which decides nothing about staying.
    """
    labelled = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select(F.col("doc_id").alias("id"), "lang", "text")
    return langid.accepted(docs, langid.fit(labelled))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, shingles of five words at a similarity of 0.8 or more, the document with the smallest id.

    Candidates are texts whose SimHash fingerprints are linked by deletion-variant signatures, and those that share minima of
    their shingles; the exact similarity decides on all.
    Texts without words and rows without id stay; rows with one id stay or go together; a text is read whole; a shorter
    text than five words is one shingle.
    """
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, up to a fifth of its words edited.

    A null or empty text and a row without id stay; each of repeated rows is decided by its own text, read whole.
    """
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids.

    A null or empty text is its end id; a null id and repeated rows are packed like others; a long text is cut into full
    sequences; of sequences of equal cost the first is filled.
    """
    return packing.pack(docs, _tokenizer(), end=END, ids=False)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}"))
    return docs
