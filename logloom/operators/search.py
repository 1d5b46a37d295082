"""Searches over the log relation: conditions become filters and joins that Catalyst pushes down."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _bound(value) -> Column:
    """A time bound, cut to the second."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return F.lit(value.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


ALIASES = {"top_dt": "dts", "end_dt": "dte", "gid": "ltgid", "time_from": "dts", "time_to": "dte"}


def search(log: DataFrame, *, groups: DataFrame | None = None, host_groups: DataFrame | None = None, order: bool = False, limit: int | None = None, **conditions) -> DataFrame:
    """Lines of ``log`` that meet all conditions; those that are None are left out, and without any it is an error.

    lid, ltid, host: equal. dts, dte: half-open times. date: one day. host_like: pattern without regard to case. host_regexp: found
    anywhere. host_in: members (none matches nothing). ltgid: through ``groups``. hg: (tier, hgid) through ``host_groups``; a tier
    without any row there stands for hosts themselves.
    """
    given = {ALIASES.get(k, k): v for k, v in conditions.items() if v is not None}
    if not given and limit is None:
        raise ValueError("no condition")
    out = log
    if "day" in log.columns:  # a stored log is partitioned by day: bounds on times are bounds on partitions too
        for name, value in given.items():
            if name in ("dts", "date"):
                out = out.where(F.col("day") >= F.to_date(_bound(str(value))))
            if name in ("dte", "date"):
                out = out.where(F.col("day") <= F.to_date(_bound(str(value))))
    for name, value in given.items():
        if name in ("lid", "ltid", "host"):
            out = out.where(F.col(name) == value)
        elif name == "dts":
            out = out.where(F.col("dt") >= _bound(value))
        elif name == "dte":
            out = out.where(F.col("dt") < _bound(value))
        elif name == "date":
            day = datetime.fromisoformat(str(value))
            out = out.where((F.col("dt") >= _bound(day)) & (F.col("dt") < _bound(day + timedelta(days=1))))
        elif name == "host_like":
            out = out.where(F.col("host").ilike(value))
        elif name == "host_regexp":
            out = out.where(F.col("host").rlike(value))
        elif name == "host_in":
            out = out.where(F.col("host").isin(list(value)) if value else F.lit(False))
        elif name == "ltgid":
            out = out.join(groups.where(F.col("ltgid") == value).select("ltid"), "ltid", "left_semi")
        elif name == "hg":
            tier, hgid = value
            rows = host_groups.where(F.col("tier") == tier)
            members = rows.where(F.col("hgid") == hgid).select("host")
            if rows.isEmpty():
                out = out.where(F.col("host") == hgid)
            else:
                out = out.join(members, "host", "left_semi")
        else:
            raise ValueError(f"unknown condition {name}")
    if order or limit is not None:
        out = out.orderBy("lid")
    return out.limit(limit) if limit is not None else out


def parse_conditions(items: list[str]) -> dict:
    """``key=value`` texts as conditions of ``search``."""
    out: dict = {}
    for item in items:
        m = re.fullmatch(r"(\w+)=(.*)", item)
        if not m:
            raise ValueError(f"not key=value: {item!r}")
        key, value = ALIASES.get(m[1], m[1]), m[2]
        if key in ("ltid", "ltgid", "lid"):
            out[key] = int(value)
        elif key in ("dts", "dte"):
            out[key] = datetime.fromisoformat(value)
        elif key in ("date", "host", "host_like", "host_regexp"):
            out[key] = value
        else:
            raise ValueError(f"unknown condition {m[1]!r}")
    return out


def line(log: DataFrame, lid: int) -> DataFrame:
    """The one line of this id; an error if there is none or are several."""
    found = log.where(F.col("lid") == lid)
    if found.limit(2).count() != 1:
        raise LookupError(f"no single line {lid}")
    return found


def with_templates(log: DataFrame, lt: DataFrame, ltg: DataFrame | None = None) -> DataFrame:
    """Lines with ltw, lts and ltgid of their template."""
    full = templates_with_groups(lt, ltg) if ltg is not None else lt.withColumn("ltgid", F.col("ltid"))
    return log.join(full.select("ltid", "ltgid", "ltw", "lts"), "ltid")


def templates_with_groups(lt: DataFrame, ltg: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Templates with their group, or themselves as group; zero_is_missing keeps an old habit of taking group 0 for none."""
    group = F.when(F.col("ltgid") != 0, F.col("ltgid")) if zero_is_missing else F.col("ltgid")
    return lt.join(ltg, "ltid", "left").withColumn("ltgid", F.coalesce(group, "ltid"))


def messages(joined: DataFrame, keep_escapes: bool = False) -> DataFrame:
    """Lines with ``message`` and ``line`` restored, from lines with ltw and lts."""
    message = T.restore_message(F.col("words"), F.col("lts"), keep_escapes)
    return joined.withColumn("message", message).withColumn("line", T.restore_line(F.col("dt"), F.col("host"), F.col("message")))


def template_lines(lt: DataFrame, tags: DataFrame) -> DataFrame:
    """ltid and a line ``ltid (tags) text (count)`` for each template."""
    tagged = tags.groupBy("ltid").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    text = F.concat(F.col("ltid"), F.when(F.col("tags").isNotNull(), F.concat(F.lit(" ("), "tags", F.lit(")"))).otherwise(""), F.lit(" "), F.array_join("ltw", " "), F.lit(" ("), "count", F.lit(")"))
    return lt.join(tagged, "ltid", "left").select("ltid", text.alias("text"))


def template_places(lt: DataFrame) -> DataFrame:
    """ltid, wid, word, vid of every word of every template; vid numbers the variables, else null."""
    from pyspark.sql import Window

    places = lt.select("ltid", F.posexplode("ltw").alias("wid", "word"))
    is_var = (F.col("word") == T.WILDCARD).cast("int")
    running = F.sum(is_var).over(Window.partitionBy("ltid").orderBy("wid").rowsBetween(Window.unboundedPreceding, 0))
    return places.select("ltid", F.col("wid").cast("long").alias("wid"), "word", F.when(is_var == 1, running - 1).cast("long").alias("vid"))
