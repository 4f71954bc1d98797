"""The training-data pipeline over ``documents``: quality, near-dedup, secrets, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import mixing, near_dups, packing, quality, secret_scan
from weftline.llm.common import crc_mod, free_name, staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; it learns from the labelled rows among ``docs`` outside its test fold.

    Null texts score as empty ones, repeated rows and equal texts share one verdict, an empty table stays empty, and other
    columns, of any name, stay as they are.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    accepted = free_name("predicted", docs.columns)
    return quality.score(docs, quality.learn(docs, labels)).where(f"{accepted} = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the smallest id.

    Null, empty and blank texts are in no group and stay, and so do rows without an id. Rows that share an id are one
    document: the one whose text is first stays, by all columns if texts tie, so that repeated rows become one. An empty
    table stays empty, and other columns, of any name, stay as they are.
    """
    kept = near_dups.near_duplicates(docs, size=5).where("kept and doc_id is not null").select("doc_id").distinct()
    number = free_name("place", docs.columns)
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    found = docs.join(kept, "doc_id", "left_semi").withColumn(number, F.row_number().over(order)).where(f"{number} = 1")
    return found.select(*docs.columns).union(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret; n_chars, where there is one, counts the new text.

    Null and empty texts stay as they are, repeated rows each get their own text, an empty table stays empty, and other
    columns, of any name, stay as they are.
    """
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated or cut as its quotas say.

    Null, empty and blank texts have no words and go. Which of several equal rows is repeated is not fixed, how often they
    are in all is. An empty table stays empty, and other columns, of any name, stay as they are.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; the columns other than doc_id and text are not read.

    A null or empty text is one end id, repeated rows are packed as often as they occur, an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_dups", one_of_each), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the network nor the signatures; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
