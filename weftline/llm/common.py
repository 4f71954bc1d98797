"""Helpers that the training-data operators share: the shared folder, staged tables and whitespace words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words, as a Java/RE2 character class body and as a word pattern.
SPACES = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of the Arrow batches that tasks get, whose default counts rows, and texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores more as it takes to clash with none of ``columns`` in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage, so that a lost executor costs no more than the tasks it ran, and lets several readers use one result.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, by: int) -> Column:
    """crc32 of the value's text, modulo ``by``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % by


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for null. Split at ASCII whitespace only."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACES}]+"))


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null: words start where a non-space follows a space or the beginning."""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACES}]+", " ")
    gaps = F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit("")))
    edges = F.startswith(folded, F.lit(" ")).cast("long") + (F.endswith(folded, F.lit(" ")) & (F.length(folded) > 1)).cast("long")
    return F.when(folded.isin("", " "), F.lit(0).cast("long")).otherwise(gaps.cast("long") + 1 - edges)
