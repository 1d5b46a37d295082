"""Template surgery. Every operation takes (log, lt) and returns the new (log, lt); nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .generate import common_template

Tables = tuple[DataFrame, DataFrame]


def _replaced(lt: DataFrame, changed: DataFrame) -> DataFrame:
    """``lt`` with ltw and count of ``changed`` (ltid, ltw, count) where it has them; new ltids are added."""
    new = changed.select("ltid", F.col("ltw").alias("__w"), F.col("count").alias("__c"))
    joined = lt.join(new, "ltid", "full")
    return joined.withColumn("ltw", F.coalesce("__w", "ltw")).withColumn("count", F.coalesce("__c", "count")).drop("__w", "__c")


def _rebuilt(log: DataFrame, lt: DataFrame, ltids: list[int]) -> DataFrame:
    """The templates of ``ltids`` anew from their lines."""
    members = log.where(F.col("ltid").isin(ltids))
    made = common_template(members).withColumnRenamed("tpl", "ltw").join(members.groupBy("ltid").agg(F.count(F.lit(1)).alias("count")), "ltid")
    return _replaced(lt, made)


def update_template(lt: DataFrame, ltid: int, ltw: list[str] | None = None, lts: list[str] | None = None, count: int | None = None) -> DataFrame:
    """Change what is given, keep what is None."""
    array = lambda x: F.array(*map(F.lit, x))
    hit = F.col("ltid") == ltid
    out = lt
    if ltw is not None:
        out = out.withColumn("ltw", F.when(hit, array(ltw)).otherwise(F.col("ltw")))
    if lts is not None:
        out = out.withColumn("lts", F.when(hit, array(lts)).otherwise(F.col("lts")))
    if count is not None:
        out = out.withColumn("count", F.when(hit, F.lit(count).cast("long")).otherwise(F.col("count")))
    return out


def remove_template(lt: DataFrame, ltg: DataFrame, ltid: int) -> Tables:
    return lt.where(F.col("ltid") != ltid), ltg.where(F.col("ltid") != ltid)


def update_lines(log: DataFrame, condition, **values) -> DataFrame:
    """Set columns of the lines that ``condition`` holds for; it must not be empty."""
    if condition is None:
        raise ValueError("no condition")
    out = log
    for name, value in values.items():
        out = out.withColumn(name, F.when(condition, F.lit(value).cast(log.schema[name].dataType)).otherwise(F.col(name)))
    return out


def merge(log: DataFrame, lt: DataFrame, first: int, second: int) -> Tables:
    """Two templates of equal length become one under the first id, counts added up."""
    a = lt.where(F.col("ltid") == first).select(F.col("ltw").alias("a"), F.col("count").alias("ca"))
    b = lt.where(F.col("ltid") == second).select(F.col("ltw").alias("b"), F.col("count").alias("cb"))
    both = a.join(b, F.size("a") == F.size("b")).select(F.lit(first).cast("long").alias("ltid"), T.merge_templates(F.col("a"), F.col("b")).alias("ltw"), (F.col("ca") + F.col("cb")).alias("count"))
    if both.isEmpty():
        raise ValueError("templates differ in length")
    return log.withColumn("ltid", F.when(F.col("ltid") == second, F.lit(first).cast("long")).otherwise(F.col("ltid"))), _replaced(lt.where(F.col("ltid") != second), both)


def _variable(log: DataFrame, lt: DataFrame, ltid: int, vid: int) -> DataFrame:
    """The lines of ``ltid`` with the value of variable ``vid``."""
    own = lt.where(F.col("ltid") == ltid).select("ltid", "ltw")
    return log.where(F.col("ltid") == ltid).join(own, "ltid").withColumn("value", F.get(T.variables(F.col("words"), F.col("ltw")), F.lit(vid))).drop("ltw")


def _next_id(lt: DataFrame) -> int:
    return (lt.agg(F.max("ltid")).first()[0] or 0) + 1


def separate(log: DataFrame, lt: DataFrame, ltid: int, vid: int, value: str) -> Tables:
    """Lines whose variable ``vid`` is ``value`` get a template of their own; both templates are made anew."""
    new = _next_id(lt)
    chosen = _variable(log, lt, ltid, vid).where(F.col("value") == value).select("lid", F.lit(new).cast("long").alias("__new"))
    moved = log.join(chosen, "lid", "left").withColumn("ltid", F.coalesce("__new", "ltid")).drop("__new")
    return moved, _rebuilt(moved, lt, [ltid, new])


def split(log: DataFrame, lt: DataFrame, ltid: int, vid: int) -> Tables:
    """One template per value of variable ``vid``; the value that comes first keeps the id."""
    new = _next_id(lt)
    valued = _variable(log, lt, ltid, vid)
    ranks = valued.groupBy("value").agg(F.min("lid").alias("f")).withColumn("r", F.row_number().over(Window.orderBy("f")) - 1)  # one row per value
    ids = ranks.select("value", F.when(F.col("r") == 0, F.lit(ltid)).otherwise(F.col("r") - 1 + new).cast("long").alias("__new"))
    moves = valued.select("lid", "value").join(ids, "value").select("lid", "__new")
    moved = log.join(moves, "lid", "left").withColumn("ltid", F.coalesce("__new", "ltid")).drop("__new")
    touched = moved.join(ids.select(F.col("__new").alias("ltid")), "ltid", "left_semi")
    made = common_template(touched).withColumnRenamed("tpl", "ltw").join(touched.groupBy("ltid").agg(F.count(F.lit(1)).alias("count")), "ltid")
    return moved, _replaced(lt, made)


def fix(log: DataFrame, lt: DataFrame, ltid: int, vids: list[int]) -> Tables:
    """Variables that have one value only become words of the template."""
    own = lt.where(F.col("ltid") == ltid).select("ltid", "ltw")
    values = log.where(F.col("ltid") == ltid).join(own, "ltid").select(F.posexplode(T.variables(F.col("words"), F.col("ltw"))).alias("vid", "value")).where(F.col("vid").isin(vids))
    single = values.groupBy("vid").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo = hi").agg(F.map_from_entries(F.collect_list(F.struct("vid", "lo"))).alias("m"))
    joined = lt.join(single, how="cross")  # one row
    number = F.transform("ltw", lambda t, i: F.size(F.filter(F.slice("ltw", F.lit(1), i + 1), lambda x: x == T.WILDCARD)) - 1)
    fixed = F.transform(F.arrays_zip(F.col("ltw").alias("t"), number.alias("v")), lambda x: F.when(x["t"] == T.WILDCARD, F.coalesce(F.try_element_at("m", x["v"]), x["t"])).otherwise(x["t"]))
    return log, joined.withColumn("ltw", F.when(F.col("ltid") == ltid, fixed).otherwise(F.col("ltw"))).drop("m")


def free(log: DataFrame, lt: DataFrame, ltid: int, wids: list[int]) -> Tables:
    """Words at these places become variables."""
    made = F.transform("ltw", lambda t, i: F.when(i.isin(wids), T.WILDCARD).otherwise(t))
    return log, lt.withColumn("ltw", F.when(F.col("ltid") == ltid, made).otherwise(F.col("ltw")))


def merge_duplicates(log: DataFrame, lt: DataFrame) -> Tables:
    """Equal templates become one, under the smallest id, counts added up."""
    least = lt.groupBy("ltw").agg(F.min("ltid").alias("keep"), F.sum("count").alias("total"))
    mapped = lt.select("ltid", "ltw").join(least, "ltw").select("ltid", "keep", "total")
    kept = lt.join(mapped.where("ltid = keep").select("ltid", "total"), "ltid").withColumn("count", F.col("total")).drop("total")
    moved = log.join(mapped.select("ltid", "keep"), "ltid", "left").withColumn("ltid", F.coalesce("keep", "ltid")).drop("keep")
    return moved, kept
