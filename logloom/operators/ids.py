"""Template ids by first appearance, template tables, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def template_table(mined: DataFrame, key: str = "tpl", template: str = "tpl") -> DataFrame:
    """ltid, ltw, lts, count, first_lid of each distinct ``key`` of ``mined`` (lid, symbols if there, key, template).

    Ids count up in the order of first lines; symbols are those of the first line. One task ranks one row per template: numbering them
    in blocks would mine everything twice, as the blocks' sizes have to be known first.
    """
    symbols = [F.min_by("symbols", "lid").alias("lts")] if "symbols" in mined.columns else [F.lit(None).cast("array<string>").alias("lts")]
    shape = F.col(key).alias("ltw") if key == template else F.max_by(template, "lid").alias("ltw")
    grouped = mined.groupBy(F.col(key).alias("__key")).agg(F.min("lid").alias("first_lid"), F.count(F.lit(1)).alias("count"), *symbols, *([] if key == template else [shape]))
    if key == template:
        grouped = grouped.withColumn("ltw", F.col("__key"))
    ranked = grouped.withColumn("ltid", (F.row_number().over(Window.orderBy("first_lid")) - 1).cast("long"))
    return ranked.select("ltid", "ltw", "lts", "count", "first_lid", "__key")


def assign(mined: DataFrame, key: str = "tpl", template: str = "tpl") -> tuple[DataFrame, DataFrame]:
    """(log, lt): the lines with their ltid, and the templates."""
    table = template_table(mined, key, template)
    log = mined.join(table.select("ltid", "__key"), mined[key] == table["__key"]).drop("__key")
    return log, table.drop("__key")


def append(log: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after ``log``, its line ids following the largest one there."""
    last = log.agg(F.coalesce(F.max("lid"), F.lit(0)).alias("__last"))
    shifted = more.join(F.broadcast(last), how="cross").withColumn("lid", F.col("lid") + F.col("__last")).drop("__last")  # one row
    return log.unionByName(shifted)
