"""From text files to parsed lines: scan, headers, tokens, hosts, line ids."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .formats import LogFormat

#: Separator characters of statements, and what is never split. Fixed values.
SEPARATORS = "\"()[]{}|+',=><;`# \t"
_V4 = r"(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?"
_V6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+|::1"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?"
_MAC = r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"
WINDOWS_PATH = r"[A-Z]:(?:\\[a-zA-Z0-9.*?_-]+)+"


def expand_paths(paths: list[str], recursive: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Files of the given files, directories and patterns, each one's in sorted order; with ``spark`` in any file system that it knows."""
    out: list[str] = []
    if spark is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            found = fs.globStatus(p)
            if found is None or not len(found):
                raise FileNotFoundError(path)
            for status in found:
                names: list[str] = []
                if status.isFile():
                    names.append(status.getPath().toString())
                elif recursive:
                    files = fs.listFiles(status.getPath(), True)
                    while files.hasNext():
                        names.append(files.next().getPath().toString())
                else:
                    names += [x.getPath().toString() for x in fs.listStatus(status.getPath()) if x.isFile()]
                out += sorted(names)
        return out
    for path in paths:
        if not os.path.isdir(path):
            out.append(path)
        elif recursive:
            for top, _, names in sorted(os.walk(path)):
                out += [os.path.join(top, n) for n in sorted(names)]
        else:
            out += [p for p in (os.path.join(path, n) for n in sorted(os.listdir(path))) if os.path.isfile(p)]
    return out


#: Tables below so many bytes a core are dealt out anew by ``deal_small``.
SMALL_BYTES = 4 << 20


def deal_small(df: DataFrame) -> DataFrame:
    """Deal a small table out over all cores: it may be one file with a single row group, which one task would read.

    The planner's size estimate decides, so no large table is ever shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


def number_lines(df: DataFrame, block: Column, *order: Column, start: int = 1, name: str = "lid") -> DataFrame:
    """Dense numbers in the order of (block, order), without sorting everything in one task.

    Lines are numbered within their block; the blocks' offsets come from a running sum over one row per block, which is small.
    """
    keyed = df.withColumn("__block", block)
    sizes = keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__block", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return keyed.withColumn("__r", within).join(offsets, "__block").withColumn(name, (F.col("__before") + F.col("__r") + (start - 1)).cast("long")).drop("__block", "__n", "__r", "__before")


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_no, split, line_no and value for every line of ``paths``, in their order; gz and bz2 are read by extension, bad bytes dropped.

    All files are one scan. split is the byte at which a piece of a file begins, and line_no grows within it; together with file_no
    (the file's first place in ``paths``) they tell the order.
    """
    if not paths:
        return spark.createDataFrame([], "file_no int, split long, line_no long, value string")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    first: dict[str, int] = {}
    for i, path in enumerate(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        first.setdefault(re.sub("^([a-z0-9]+):/+", r"\1:/", p.getFileSystem(conf).makeQualified(p).toUri().toString()), i)
    numbers = spark.createDataFrame(list(first.items()), "__path string, file_no int")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    lines = spark.read.text(sorted(set(paths))).select(path.alias("__path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), T.valid_text(F.col("value")).alias("value"))
    # One row per file, a checked number.
    return lines.join(F.broadcast(numbers) if len(first) <= 1_000_000 else numbers, "__path").select("file_no", "split", "line_no", "value")


def token_pattern(keep: tuple[str, ...] = ()) -> str:
    """One alternation: what must stay whole, else runs of characters that are neither separators nor colons."""
    escaped = "".join("\\" + c if c in "\"()[]{}|+',=><;`#" else {" ": " ", "\t": "\\t"}[c] for c in SEPARATORS)
    edge = rf"(?<![^{escaped}])"
    end = rf"(?![^{escaped}:])"
    fixed = "|".join(rf"{edge}(?:{p}){end}" for p in (*keep, _MAC, _V6, _V4, _CLOCK))
    return rf"{fixed}|[^{escaped}:]+"


def tokens(statement: Column, keep: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Words and the symbols around them; there is always one symbol more than words."""
    pattern = token_pattern(keep)
    return F.regexp_extract_all(statement, F.lit(pattern), F.lit(0)), F.split(statement, pattern, -1)


def parse_lines(lines: DataFrame, fmt: LogFormat, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` (value, and more) with dt, host, statement, words, symbols and extras; words and statement are escaped.

    Lines that no pattern matches, or without words, have null words: see ``rejects``.
    """
    value = F.col("value")
    fields = fmt.fields(value)
    statement = fields.get("statement", F.lit(None).cast("string"))
    words, symbols = tokens(F.coalesce(statement, F.lit("")), keep)
    others = [n for n in fields if n not in {"host", "statement", "year", "month", "mon", "day", "time", "hour", "minute", "second", "date", "date6", "date8", "time6", "year2", "unixtime", "lid"}]
    extras = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(fields[n] for n in others))) if others else F.create_map().cast("map<string,string>")
    parsed = lines.select(
        "*",
        fmt.timestamp(fields).alias("dt"),
        fields.get("host", F.lit(None).cast("string")).alias("host"),
        T.escape(statement).alias("statement"),
        T.escape_words(words).alias("__words"),
        symbols.alias("symbols"),
        extras.alias("extras"),
    )
    ok = fmt.matched(value).isNotNull() & (F.size("__words") > 0)
    return parsed.withColumn("words", F.when(ok, F.col("__words"))).drop("__words")


def rejects(parsed: DataFrame) -> DataFrame:
    """The raw lines that could not be parsed."""
    return parsed.where("words is null").select("value")


def drop_messages(lines: DataFrame, substrings: list[str]) -> DataFrame:
    """Without the lines that hold any of ``substrings``."""
    out = lines
    for x in substrings:
        out = out.where(~F.col("value").contains(x))
    return out


def normalise_hosts(parsed: DataFrame, aliases: DataFrame | None = None, drop_undefined: bool = False, dummy: str = "dummy") -> DataFrame:
    """Known hosts by their alias, unknown ones kept or dropped, missing ones as ``dummy``. aliases: token, alias."""
    named = parsed.withColumn("host", F.coalesce("host", F.lit(dummy)))
    if aliases is None:
        return named
    joined = named.join(aliases.select(F.col("token").alias("__token"), F.col("alias").alias("__alias")), F.lower("host") == F.col("__token"), "left")
    known = joined.where("__alias is not null or host = " + repr(dummy)) if drop_undefined else joined
    return known.withColumn("host", F.coalesce("__alias", "host")).drop("__token", "__alias")


def read_log(spark: SparkSession, paths: list[str], fmt: LogFormat, aliases: DataFrame | None = None, drop_undefined: bool = False, dummy: str = "dummy", first_lid: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects): the parsed lines (lid, dt, host, words, symbols) of all files in order, and the raw lines that failed."""
    parsed = parse_lines(scan_lines(spark, paths), fmt)
    good = normalise_hosts(parsed.where("words is not null"), aliases, drop_undefined, dummy)
    numbered = number_lines(good, F.struct("file_no", "split", F.shiftright("line_no", 16)), F.col("line_no"), start=first_lid)
    return numbered.select("lid", "dt", "host", "words", "symbols"), rejects(parsed)


def read_definitions(spark: SparkSession, path: str, escaped: bool = True) -> DataFrame:
    """Template definitions, one a line, words apart by blanks: defid (equal templates share one) and tpl; blank lines are skipped."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where("trim(value) != ''")
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    tpl = words if escaped else F.transform(words, lambda w: F.when(w == T.WILDCARD, w).otherwise(T.escape(w)))
    first = lines.select(tpl.alias("tpl"), "n").groupBy("tpl").agg(F.min("n").alias("n"))
    return first.select((F.row_number().over(Window.orderBy("n")) - 1).cast("long").alias("defid"), "tpl")
