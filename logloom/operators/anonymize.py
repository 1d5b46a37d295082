"""Anonymised copies of a log: hosts by rank, words of templates by a placeholder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WILDCARD

PLACEHOLDER = "##"


def host_mapping(log: DataFrame) -> DataFrame:
    """host, anonymous: ``host`` and the rank in sorted order, with as many digits as the number of hosts has. One row per host is ranked."""
    hosts = log.select("host").distinct()
    rank = F.row_number().over(Window.orderBy("host")) - 1
    width = F.length(F.count(F.lit(1)).over(Window.partitionBy()).cast("string"))
    return hosts.select("host", F.concat(F.lit("host"), F.lpad(rank.cast("string"), width, "0")).alias("anonymous"))


def template_mapping(lt: DataFrame) -> DataFrame:
    """Templates with words replaced and symbols as single blanks with empty ends; null symbols stay null."""
    words = F.transform("ltw", lambda t: F.when(t == WILDCARD, t).otherwise(PLACEHOLDER))
    n = F.size("lts")
    symbols = F.when(F.col("lts").isNotNull(), F.transform("lts", lambda s, i: F.when((i == 0) | (i == n - 1), "").otherwise(" ")))
    return lt.withColumn("ltw", words).withColumn("lts", symbols)


def anonymize(log: DataFrame, lt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, lt, host mapping): lines get their template's words and their host's pseudonym."""
    mapping, hidden = host_mapping(log), template_mapping(lt)
    joined = log.join(mapping, "host").join(hidden.select("ltid", F.col("ltw").alias("__w")), "ltid")
    return joined.withColumn("host", F.col("anonymous")).withColumn("words", F.col("__w")).drop("anonymous", "__w"), hidden, mapping


def restore_hosts(log: DataFrame, mapping: DataFrame) -> DataFrame:
    back = mapping.select(F.col("anonymous").alias("host"), F.col("host").alias("__h"))
    return log.join(back, "host").withColumn("host", F.col("__h")).drop("__h")


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hosts, templates) as they were written beside an anonymous log: host, anonymous; and ltid, ltw, lts."""
    return spark.read.schema("host string, anonymous string").json(f"{path}/hosts"), spark.read.schema("ltid long, ltw array<string>, lts array<string>").json(f"{path}/templates")


def restore_templates(lt: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates and symbols as they were; counts are the anonymous log's."""
    old = templates.select("ltid", F.col("ltw").alias("__w"), F.col("lts").alias("__s"))
    return lt.join(old, "ltid", "left").withColumn("ltw", F.coalesce("__w", "ltw")).withColumn("lts", F.coalesce("__s", "lts")).drop("__w", "__s")


def restore_log(log: DataFrame, mapping: DataFrame, lt: DataFrame) -> DataFrame:
    """Lines with their hosts and with the words of their templates; the values of variables are gone for good and stay wildcards."""
    own = lt.select("ltid", F.col("ltw").alias("__w"))
    return restore_hosts(log, mapping).join(own, "ltid", "left").withColumn("words", F.coalesce("__w", "words")).drop("__w")
