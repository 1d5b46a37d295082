"""Statistics over the log and its templates, tags and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def line_count(log: DataFrame) -> DataFrame:
    """last_lid (the reference notion of a count, zero if empty) and n_lines."""
    return log.agg(F.coalesce(F.max("lid"), F.lit(0)).alias("last_lid"), F.count(F.lit(1)).alias("n_lines"))


def term(log: DataFrame) -> DataFrame:
    """First and last time, and the days that hold them as a half-open interval."""
    made = log.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    return made.withColumn("top", day(F.col("first_dt"))).withColumn("end", (day(F.col("last_dt")) + F.expr("interval 1 day")).cast("timestamp_ntz"))


def hosts(log: DataFrame) -> DataFrame:
    return log.select("host").distinct()


def host_templates(log: DataFrame) -> DataFrame:
    return log.select("host", "ltid").distinct()


def host_groups_of_templates(log: DataFrame, ltg: DataFrame) -> DataFrame:
    return host_templates(log).join(ltg, "ltid").select("host", "ltgid").distinct()


def info(log: DataFrame, lt: DataFrame, ltg: DataFrame) -> DataFrame:
    """One row about the whole database."""
    return (
        log.agg(F.count(F.lit(1)).alias("n_lines"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.countDistinct("host").alias("n_hosts"))
        .join(lt.agg(F.count(F.lit(1)).alias("n_templates")), how="cross")
        .join(ltg.agg((F.coalesce(F.max("ltgid"), F.lit(-1)) + 1).alias("n_groups")), how="cross")  # one row each
    )


def term_info(log: DataFrame, ltg: DataFrame, dts: str, dte: str) -> DataFrame:
    within = log.where((F.col("dt") >= F.lit(dts).cast("timestamp_ntz")) & (F.col("dt") < F.lit(dte).cast("timestamp_ntz")))
    return within.join(ltg, "ltid", "left").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("ltid").alias("n_templates"), F.countDistinct("ltgid").alias("n_groups"), F.countDistinct("host").alias("n_hosts")
    )


def group_summary(lt: DataFrame, ltg: DataFrame, tags: DataFrame) -> DataFrame:
    """ltgid, n_templates, n_lines, tags of each template group."""
    counts = lt.join(ltg, "ltid").groupBy("ltgid").agg(F.count(F.lit(1)).alias("n_templates"), F.sum("count").alias("n_lines"))
    named = ltg.join(tags, "ltid").groupBy("ltgid").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return counts.join(named, "ltgid", "left")


def tag_summary(lt: DataFrame, tags: DataFrame) -> DataFrame:
    return lt.join(tags, "ltid").groupBy("tag").agg(F.count(F.lit(1)).alias("n_templates"), F.sum("count").alias("n_lines"))


def group_tags(ltg: DataFrame, tags: DataFrame, ltgid: int) -> DataFrame:
    return ltg.where(F.col("ltgid") == ltgid).join(tags, "ltid", "left").select("tag").distinct().where("tag is not null")


def host_group_summary(log: DataFrame, hg: DataFrame) -> DataFrame:
    """tier, hgid, n_hosts and n_events: the distinct (host, template) pairs of its hosts."""
    events = host_templates(log).groupBy("host").agg(F.count(F.lit(1)).alias("events"))
    return hg.join(events, "host", "left").groupBy("tier", "hgid").agg(F.countDistinct("host").alias("n_hosts"), F.coalesce(F.sum("events"), F.lit(0)).alias("n_events"))


def word_counts(log: DataFrame, lt: DataFrame, target: str = "all", fold: bool = False) -> DataFrame:
    """word, count over messages (all), template words weighted by lines (description), or variable values (variable)."""
    if target == "all":
        words = log.select(F.explode("words").alias("word"), F.lit(1).cast("long").alias("n"))
    elif target == "description":
        counts = log.groupBy("ltid").agg(F.count(F.lit(1)).alias("n"))
        words = counts.join(lt, "ltid").select(F.explode(T.description(F.col("ltw"))).alias("word"), "n")
    elif target == "variable":
        words = log.join(lt.select("ltid", "ltw"), "ltid").select(F.explode(T.variables(F.col("words"), F.col("ltw"))).alias("word"), F.lit(1).cast("long").alias("n"))
    else:
        raise ValueError(f"unknown target {target}")
    if fold:
        words = words.withColumn("word", T.fold_digits(F.col("word")))
    return words.groupBy("word").agg(F.sum("n").alias("count"))


def variable_values(log: DataFrame, lt: DataFrame, ltid: int | None = None) -> DataFrame:
    """ltid, vid, value, count, first_lid of the values of each variable."""
    chosen = log if ltid is None else log.where(F.col("ltid") == ltid)
    joined = chosen.join(lt.select("ltid", "ltw"), "ltid")
    values = joined.select("ltid", "lid", F.posexplode(T.variables(F.col("words"), F.col("ltw"))).alias("vid", "value"))
    return values.withColumn("vid", F.col("vid").cast("long")).groupBy("ltid", "vid", "value").agg(F.count(F.lit(1)).alias("count"), F.min("lid").alias("first_lid"))


def variable_variety(log: DataFrame, lt: DataFrame) -> DataFrame:
    """ltid, vid, variety: the number of distinct values."""
    return variable_values(log, lt).groupBy("ltid", "vid").agg(F.count(F.lit(1)).alias("variety"))


def stable_variables(log: DataFrame, lt: DataFrame, most: int = 1) -> DataFrame:
    return variable_variety(log, lt).where(F.col("variety") <= most)
