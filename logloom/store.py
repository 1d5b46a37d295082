"""The five relations as Parquet folders: log (by day), lt, ltg, tag and hg (by tier).

Tables are rewritten into a new folder that then takes the old one's place, so no path is overwritten while it is read. Lines and the
templates that they change are written aside and then moved in as one batch. A writer may die at any time: what it had finished writing is
moved in when the store is opened next, and what it had not is removed, so no line is lost, doubled or seen without its template. All
file work goes through Hadoop's file systems, so a store may lie anywhere that Spark can write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "log": "lid long, ltid long, dt timestamp_ntz, host string, words array<string>, day date",
    "lt": "ltid long, ltw array<string>, lts array<string>, count long",
    "ltg": "ltid long, ltgid long",
    "tag": "ltid long, tag string",
    "hg": "host string, hgid string, tier string",
}
PARTITIONS = {"log": ["day"], "hg": ["tier"]}


class LogStore:
    """A folder of tables. mode: read (must exist), append (created if missing) or reset (emptied). One writer at a time, any readers."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "append"):
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode not in ("read", "append", "reset"):
            raise ValueError(f"unknown mode {mode}")
        if mode == "reset":
            self.drop()
        elif mode == "append" or not (self.exists("log") and self.exists("lt")):
            self.recover()  # a reader leaves a writer's folders alone
        if mode == "read":
            if not self.exists("log") or not self.exists("lt"):
                raise FileNotFoundError(f"no log store in {path}")
        else:
            self.ensure()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._fs(f"{self.path}/{table}")
        return fs.exists(p)

    def _names(self, folder: str = "") -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _move(self, source: str, target: str) -> None:
        fs, old = self._fs(f"{self.path}/{source}")
        _, new = self._fs(f"{self.path}/{target}")
        if not fs.rename(old, new):
            raise OSError(f"cannot move {source} to {target} in {self.path}")

    def _delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def ensure(self) -> list[str]:
        """Make missing tables, empty; returns their names."""
        made = [t for t in SCHEMAS if not self.exists(t)]
        for t in made:
            self.spark.createDataFrame([], SCHEMAS[t]).drop(*PARTITIONS.get(t, [])).write.parquet(f"{self.path}/{t}")
        return made

    def recover(self) -> None:
        """Finish what a writer had written when it died, and remove what it had not finished writing."""
        for name in self._names():
            if name.startswith("_batch_"):
                if self.exists(f"{name}/_READY"):
                    self._move_in(name)
                else:
                    self._delete(name)
        for name in self._names():
            kind, _, rest = name.removeprefix("_").partition("_")
            if name.startswith("_") and kind in ("new", "old"):
                table, _, mark = rest.partition("_")
                if not self.exists(table):  # died between two moves
                    self._move(f"_new_{table}_{mark}" if self.exists(f"_new_{table}_{mark}/_SUCCESS") else f"_old_{table}_{mark}", table)
        for name in self._names():
            if name.startswith("_"):
                self._delete(name)

    def repair(self) -> list[str]:
        """Finish or remove what a writer left and add missing ltg, tag and hg; log and lt must be there."""
        self.recover()
        for t in ("log", "lt"):
            if not self.exists(t):
                raise FileNotFoundError(f"{self.path}/{t}")
        return self.ensure()

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _writer(self, name: str, df: DataFrame):
        if name == "log":
            df = df.withColumn("day", F.to_date("dt"))
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        chosen = df.select(*columns)
        if name == "log":
            # A day's lines go to the files of a few tasks, in an order that keeps templates and hosts together for row-group pruning.
            chosen = chosen.repartition("day", F.pmod(F.hash("host"), F.lit(8))).sortWithinPartitions("day", "ltid", "host")
        return chosen.write.partitionBy(*PARTITIONS.get(name, []))

    def append(self, name: str, df: DataFrame) -> None:
        self._writer(name, df).mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Write ``df`` beside the table, then swap the folders."""
        mark = uuid.uuid4().hex
        self._writer(name, df).parquet(f"{self.path}/_new_{name}_{mark}")
        self._swap(name, f"_new_{name}_{mark}", mark)

    def _swap(self, name: str, staged: str, mark: str) -> None:
        """Put ``staged`` in the place of a table; may be done again from any point."""
        new, old = f"_new_{name}_{mark}", f"_old_{name}_{mark}"
        if staged != new and self.exists(staged):
            self._move(staged, new)
        if self.exists(new):
            if self.exists(name):
                self._move(name, old)
            self._move(new, name)
        self._delete(old)

    def _move_in(self, batch: str) -> None:
        """Move a batch that is written as a whole into the tables; may be done again from any point."""
        for day in self._names(f"{batch}/log"):
            if day.startswith("day="):
                fs, p = self._fs(f"{self.path}/log/{day}")
                fs.mkdirs(p)
                for part in self._names(f"{batch}/log/{day}"):
                    if part.endswith(".parquet"):
                        self._move(f"{batch}/log/{day}/{part}", f"log/{day}/{part}")
        self._swap("lt", f"{batch}/lt", batch.removeprefix("_batch_"))
        if self.exists(f"{batch}/id"):
            for name in self._names(f"{batch}/id"):
                fs, p = self._fs(f"{self.path}/batches/{name}")
                fs.mkdirs(p)
        self._delete(batch)

    def reset_tier(self, tier: str, df: DataFrame) -> None:
        """Make one tier of hg anew and leave the others."""
        kept = self.table("hg").where(F.col("tier") != tier)
        self.replace("hg", kept.unionByName(df.select("host", "hgid", "tier")))

    def has_batch(self, batch_id: int | str) -> bool:
        return self.exists(f"batches/{batch_id}")

    def add_lines(self, lines: DataFrame, key: str = "tpl", template: str = "tpl", batch_id: int | str | None = None) -> None:
        """Append mined lines (lid, dt, host, words, symbols, key, template): line ids follow the last one, known templates keep their ids.

        Lines and templates come in together or not at all. A batch that the store has already (``batch_id``) is left out.
        """
        if batch_id is not None and self.has_batch(batch_id):
            return
        from .operators.ids import template_table

        old_log, old_lt = self.table("log"), self.table("lt")
        last = old_log.agg(F.coalesce(F.max("lid"), F.lit(0))).first()[0]
        table = template_table(lines, key, template).select(F.col("ltid").alias("new"), "ltw", F.col("lts"), "count", "__key")
        known = old_lt.groupBy("ltw").agg(F.min("ltid").alias("old"))
        next_id = (old_lt.agg(F.max("ltid")).first()[0] if not old_lt.isEmpty() else -1) + 1
        joined = table.join(known, "ltw", "left")
        fresh = joined.where("old is null").withColumn("ltid", F.row_number().over(Window.orderBy("new")) - 1 + next_id)  # one row per new template
        ids = joined.where("old is not null").select(F.col("old").alias("ltid"), "__key", "count").unionByName(fresh.select(F.col("ltid").cast("long"), "__key", "count"))
        added = lines.join(ids.select("ltid", "__key"), lines[key] == ids["__key"]).withColumn("lid", F.col("lid") + last)
        counts = ids.groupBy("ltid").agg(F.sum("count").alias("more"))
        grown = old_lt.join(counts, "ltid", "left").withColumn("count", F.col("count") + F.coalesce("more", F.lit(0))).drop("more")
        new_lt = grown.unionByName(fresh.select(F.col("ltid").cast("long"), "ltw", "lts", "count"))
        batch = f"_batch_{uuid.uuid4().hex}"
        self._writer("log", added.select("lid", "ltid", "dt", "host", "words")).parquet(f"{self.path}/{batch}/log")
        self._writer("lt", new_lt).parquet(f"{self.path}/{batch}/lt")
        for made in ([f"{batch}/id/{batch_id}"] if batch_id is not None else []) + [f"{batch}/_READY"]:
            fs, p = self._fs(f"{self.path}/{made}")
            fs.mkdirs(p)
        self._move_in(batch)

    def export_days(self, path: str) -> None:
        """Restored lines as text, a folder per day, in the order of line ids within a day."""
        from .operators import search

        lines = search.messages(search.with_templates(self.table("log"), self.table("lt")))
        days = lines.select(F.date_format("dt", "yyyyMMdd").alias("day"), "lid", "line").repartition("day").sortWithinPartitions("day", "lid")
        days.select("day", F.col("line").alias("value")).write.partitionBy("day").mode("overwrite").text(path)

    def export_templates(self, path: str) -> None:
        """Templates as importable definitions."""
        self.table("lt").orderBy("ltid").select(F.array_join("ltw", " ").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def jdbc_table(spark: SparkSession, url: str, name: str, separator: str = "@@") -> DataFrame:
    """A table of an existing SQL database, word lists decoded; the driver class must be on Spark's class path."""
    from .functions.text import split_unescaped

    df = spark.read.format("jdbc").options(url=url, dbtable=name).load()
    for c in ("words", "ltw", "lts"):
        if c in df.columns:
            df = df.withColumn(c, split_unescaped(F.col(c), separator))
    return df


def write_jdbc(df: DataFrame, url: str, name: str, separator: str = "@@", mode: str = "overwrite") -> None:
    """A table into an SQL database, word lists encoded as ``jdbc_table`` reads them; words are escaped, so the separator is in none."""
    from .functions.text import join_words

    for field in df.schema:
        if field.dataType.simpleString() == "array<string>":
            df = df.withColumn(field.name, join_words(F.col(field.name), separator))
    df.write.format("jdbc").options(url=url, dbtable=name).mode(mode).save()
