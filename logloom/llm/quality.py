"""Quality rules whose thresholds adapt to language and source.

Each statistic of a document is a count out of a total (repeated lines of all lines, capitals of all letters), taken as its empirical
log odds. For each language and source a mergeable quantile sketch sums up every statistic: the log odds in cells of equal width, which
are merged by adding their counts, so that any quantile is known to half a cell. A document is rejected if a statistic lies beyond the
fence of its group: the upper quartile and three quartile distances more. Nothing but the group's own quartiles moves a fence; a group
whose quartiles (nearly) coincide counts as having a least distance. A source that is junk as a whole, its median beyond the fence of its
language, is judged by that fence.

Scale: sketches are built on the map side and merged by (group, statistic, cell), so a source that holds most documents is dealt over as
many keys as it has cells; the final quartiles read one bounded sketch per group. Text is never shuffled.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: The statistics that fences look at; each is the log odds of a count out of a total.
STATISTICS = ["upper", "symbols", "dup_lines", "stutter", "bars", "marks"]
#: Quartile distances beyond the upper quartile: the outer fence of a box plot.
SPREAD = 3.0
#: The least quartile distance, in log odds, that a group counts as having.
LEAST_SPREAD = 0.5
#: Groups with fewer documents use the thresholds of their language, and such languages those of all documents.
LEAST_GROUP = 50
#: Width of a sketch's cells, in log odds; log odds of counts lie within some 45 of zero, so a sketch has 4,500 cells at most.
CELL = 0.02
#: The thresholds are broadcast up to so many groups (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_GROUPS = 100_000

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NOT_WORD = b"".join(bytes([b]) for b in range(256) if 0x80 <= b < 0xC0) + _SPACES


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    # Two windows are equal if their two halves are, and so on: ranks of doubled length name equal windows exactly.
    rank, size = ids, 1
    while size < width:
        pair = rank[: len(rank) - size] * n + rank[size:]
        unique, rank = np.unique(pair, return_inverse=True)
        if len(unique) == len(pair):
            return 0
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    where = np.flatnonzero(twice)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_counts(data: bytes) -> tuple[tuple, tuple]:
    """The base statistics of one UTF-8 text, and (count, total) of each of STATISTICS."""
    words = data.split()  # for bytes, exactly the six ASCII white-space characters
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0), ((0, 0),) * len(STATISTICS)
    chars = len(data.translate(None, _NOT_WORD))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER))
    bars = words.count(b"|")
    marks = sum(w.endswith(b"!!") for w in words)
    stutter = sum(map(operator.eq, words, islice(words, 1, None)))
    return (n, chars, symbols, dup, repeat), ((upper, letters), (symbols, n), (dup, len(lines)), (stutter, n), (bars, n), (marks, n))


def text_statistics(data: bytes) -> tuple:
    """The base statistics of one UTF-8 text and the shares of STATISTICS."""
    base, counts = text_counts(data)
    return (*base, *(c / t if t else 0.0 for c, t in counts))


def log_odds(count: int, total: int) -> float:
    """Of a count out of a total, with half an event added on both sides, so that no share is infinitely rare."""
    return math.log((count + 0.5) / (max(0, total - count) + 0.5))


def with_statistics(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with a column __ll_<name> for each base statistic of its text and the log odds of STATISTICS; null text counts as empty."""
    made = [(f"__ll_{x.split()[0]}", x.split()[1]) for x in [*BASE.split(", "), *(f"{x} double" for x in STATISTICS)]]
    at = docs.columns.index("text")
    passed = [f for i, f in enumerate(docs.schema) if keep_text or i != at]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if k == "long" else pa.float64() for _, k in made]
        for batch in batches:
            for part in common.parts(batch, column=at):
                rows = [(*base, *(log_odds(*x) for x in counts)) for base, counts in map(text_counts, common.utf8(part.column(at)))]
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                old = [part.column(i) for i in range(part.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*old, *new], [*(f.name for f in passed), *(n for n, _ in made)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed), *(f"{n} {k}" for n, k in made)])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(computed, schema)


def _group(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * repeat > 30 * n)


def sketches(stats: DataFrame) -> DataFrame:
    """The quantile sketches of ``stats``: level, __ll_lang, __ll_source, stat, cell, n.

    level 0: for each language and source; 1: for each language, merged from those; 2: of everything.
    """
    passed = stats.where(~base_failed("__ll_"))
    cells = F.array(*(F.floor(F.col(f"__ll_{x}") / CELL).cast("int") for x in STATISTICS))
    flat = passed.select("__ll_lang", "__ll_source", F.posexplode(cells).alias("stat", "cell"))
    fine = common.stored(flat.groupBy("__ll_lang", "__ll_source", "stat", "cell").agg(F.count(F.lit(1)).alias("n")))

    def merged(level: int, *keys: str) -> DataFrame:
        sums = fine.groupBy(*keys, "stat", "cell").agg(F.sum("n").alias("n")) if level else fine
        names = [F.col(k) if k in keys else F.lit("").alias(k) for k in ("__ll_lang", "__ll_source")]
        return sums.select(F.lit(level).alias("level"), *names, "stat", "cell", "n")

    return merged(0, "__ll_lang", "__ll_source").unionByName(merged(1, "__ll_lang")).unionByName(merged(2))


def quartiles(cells: DataFrame) -> DataFrame:
    """level, __ll_lang, __ll_source, stat, n and the quartiles q1, q2, q3 (the middles of their cells) of each sketch."""
    keys = ["level", "__ll_lang", "__ll_source", "stat"]
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell"))  # over one row per cell
    total = F.sum("n").over(Window.partitionBy(*keys))
    counted = cells.withColumn("below", below).withColumn("total", total)
    quartile = lambda p: ((F.min(F.when(F.col("below") >= p * F.col("total"), F.col("cell"))) + 0.5) * CELL)
    return counted.groupBy(*keys).agg(F.max("total").alias("n"), *(quartile(p).alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75), 1)))


def thresholds(stats: DataFrame, spread: float = SPREAD, least: int = LEAST_GROUP, least_spread: float = LEAST_SPREAD) -> DataFrame:
    """The fence of every statistic for each (lang, source) of ``stats``: __ll_lang, __ll_source, __ll_f_<statistic>, in log odds.

    A group's own fence; that of its language if the group has fewer than ``least`` documents or its median lies beyond that fence; and
    that of all documents if the language has fewer.
    """
    fence = F.col("q3") + spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(least_spread))
    fenced = common.stored(quartiles(sketches(stats)).select("level", "__ll_lang", "__ll_source", "stat", "n", "q2", fence.alias("fence")))
    own = fenced.where("level = 0").drop("level")
    lang = fenced.where(f"level = 1 and n >= {least}").select("__ll_lang", "stat", F.col("fence").alias("wide"))
    total = fenced.where("level = 2").select("stat", F.col("fence").alias("widest"))  # one row per statistic
    joined = own.join(lang, ["__ll_lang", "stat"], "left").join(F.broadcast(total), "stat")
    wide = F.coalesce("wide", "widest")
    chosen = joined.withColumn("fence", F.when((F.col("n") >= least) & (F.col("q2") <= wide), F.col("fence")).otherwise(wide))
    return chosen.groupBy("__ll_lang", "__ll_source").agg(*(F.max(F.when(F.col("stat") == i, F.col("fence"))).alias(f"__ll_f_{x}") for i, x in enumerate(STATISTICS)))


def judge(docs: DataFrame, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` (text, lang, source and any other columns) with the statistics, __ll_base_failed and __ll_kept.

    kept is false if the base rules fail or if a statistic exceeds its fence. Null or missing lang and source form groups of their
    own. Groups without any document that passes the base rules have no fence; their documents have failed anyhow. Every document,
    repeated ones too, gets one row. Text is never shuffled; where it is kept it is read twice, for the sketches and for the verdict.
    """
    keys = [_group(x, docs.columns).alias(f"__ll_{x}") for x in ("lang", "source")]
    full = with_statistics(docs.select("*", *keys), keep_text)
    if keep_text:
        light = with_statistics(docs.select("text", *keys), keep_text=False)
    else:
        light = full = common.stored(full)
    fences = common.stored(thresholds(light, **options))
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = full.join(fences, ["__ll_lang", "__ll_source"], "left")
    beyond = F.lit(False)
    for x in STATISTICS:
        beyond = beyond | F.coalesce(F.col(f"__ll_{x}") > F.col(f"__ll_f_{x}"), F.lit(False))
    return joined.withColumn("__ll_base_failed", base_failed("__ll_")).withColumn("__ll_kept", ~F.col("__ll_base_failed") & ~beyond)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judge(docs, **options).where("__ll_kept").select(*docs.columns)
