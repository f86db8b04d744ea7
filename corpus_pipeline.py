"""A corpus pipeline of five operators; each stage works on what the one before it kept.

All stages but the last keep the columns of their input, whatever their names. A null text counts as empty in
decisions and stays null; rows that repeat an id and text share a fate; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import key_filter, with_maybe
from tidemark.llm.linededup import line_dedup
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.substring import substring_dedup
from tidemark.llm.toxicity import toxicity_score, train_toxicity
from tidemark.sources.scratch import cut


#: Lines on more than this share of a source's pages go. Template, license and header lines stand on 0.1 to
#: 13 % of a source's pages; below that are lines that only copies of a page share, which near-dedup settles.
LINE_RATIO = 0.001


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.7; the model learns from the labels of documents that are here.

    Null and wordless texts have the share of toxic labels as their score; without labels all rows stay.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity_score(F.col("text"), model, spark) < 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are boilerplate in their source; ``n_chars`` follows. All rows stay, a null source
    is a source of its own, and lines of white space alone are no boilerplate."""
    return _counted(line_dedup(docs, F.col("source"), max_ratio=LINE_RATIO), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the smallest id stays.

    Rows that share an id go together; rows without an id stay. Only documents that may have to go
    are shuffled.
    """
    gone = cut(near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id").distinct(), "gone")
    marked = with_maybe(docs.select(F.struct("*").alias("_row"), "doc_id"), key_filter(gone, "doc_id"), "_maybe", "doc_id")
    rest = marked.filter("_maybe").join(gone, "doc_id", "left_anti")
    return marked.filter("not _maybe").select("_row.*").unionByName(rest.select("_row.*"))


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has. All rows stay, with an empty text if all of it
    repeats; a null id counts as the earliest."""
    return _counted(substring_dedup(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens. Null and empty texts are one
    piece, the end id; equal rows get places of their own."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memory=1_000_000)


def _counted(df: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between two stages is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
