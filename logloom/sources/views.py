"""Log relations derived from the driver's tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .parse import deal_small, number_lines


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lid, dt, host, words of one line per event; hosts are shaped like racks, midplanes and nodes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    host = F.concat(F.lit("R"), F.lpad((F.col("user_id") % 4).cast("string"), 2, "0"), F.lit("-M"), F.col("user_id") % 2, F.lit("-N"), F.col("user_id") % 16)
    words = F.array("event_type", F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.floor("value").cast("long").cast("string"), F.lit("k"), F.regexp_extract("props", r"(\d+)", 1))
    return e.select((F.col("event_id") + 1).alias("lid"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("dt"), host.alias("host"), words.alias("words"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lid, host, words of one line per line of a document, without empty ones; words are escaped."""
    d = deal_small(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    lines = d.select("doc_id", F.col("source").alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line != ''")
    split = lines.withColumn("words", F.split("line", " "))
    numbered = number_lines(split, F.floor(F.col("doc_id") / 1024), F.col("doc_id"), F.col("pos"))
    return numbered.select("lid", "host", T.escape_words(F.col("words")).alias("words"))
