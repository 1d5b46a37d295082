"""Template generators that are plain relational programs: rules, frequencies, definitions, external patterns, chains of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.variables import DIGITS, VariableRules


def by_rules(lines: DataFrame, rules: VariableRules = DIGITS) -> DataFrame:
    """tpl: the words, where those that a rule hits are wildcards."""
    return lines.withColumn("tpl", rules.template(F.col("words")))


def by_frequency(lines: DataFrame, method: str = "relative-variable", threshold: float = 0.4, most: int | None = None) -> DataFrame:
    """tpl: words that are frequent enough stay. Counts are over all lines and every occurrence.

    static: over ``threshold`` occurrences. relative-line: over ``threshold`` times the number of lines. relative-variable: at least the
    count at place ``threshold`` of the line's own counts in ascending order. Words are counted by one aggregation; the counts of those
    that come again go to where the lines are, up to a checked number of words (``most``), and are joined by a shuffle beyond.
    """
    from .cluster import word_counts

    counted = word_counts(lines, most)
    total = lines.count() if method == "relative-line" else 0
    return lines.join(_frequent(counted, method, threshold, F.lit(total)), "lid")


def _frequent(counted: DataFrame, method: str, threshold: float, total: Column) -> DataFrame:
    """lid and tpl of ``counted`` (lid, words, counts); total: the number of lines that the counts are over."""
    if method == "static":
        limit = F.lit(threshold)
    elif method == "relative-line":
        limit = threshold * total
    elif method == "relative-variable":
        limit = F.element_at(F.sort_array("counts"), (F.floor(F.lit(threshold) * F.size("counts")) + 1).cast("int"))
    else:
        raise ValueError(f"unknown method {method}")
    enough = (lambda n, at: n >= at) if method == "relative-variable" else (lambda n, at: n > at)
    # A lambda variable holds the line's limit, which would be computed anew for every word else.
    made = F.transform(F.array(limit), lambda at: F.zip_with("words", "counts", lambda w, n: F.when(enough(n, at), w).otherwise(T.WILDCARD)))
    return counted.select("lid", F.element_at(made, 1).alias("tpl"))


def by_running_frequency(lines: DataFrame, method: str = "relative-variable", threshold: float = 0.4, block: int | None = None) -> DataFrame:
    """``by_frequency`` online: each line is judged by the counts of words, and of lines, up to and including it."""
    from ..sources.parse import number_lines
    from .cluster import COUNT_BLOCK, running_counts

    counted = running_counts(lines, block)
    if method == "relative-line":
        counted = number_lines(counted, F.floor(F.col("lid") / (block or COUNT_BLOCK)), F.col("lid"), name="__seen")
        return lines.join(_frequent(counted, method, threshold, F.col("__seen")), "lid")
    return lines.join(_frequent(counted, method, threshold, F.lit(0)), "lid")


def match_definitions(lines: DataFrame, definitions: DataFrame, method: str = "tree") -> DataFrame:
    """defid and tpl of the definition (defid, tpl) that matches each line's words; null if none does.

    table: the first definition. tree: literals are preferred to wildcards from left to right. Distinct messages are matched once; the
    equality of lengths is the join's key, so no pair of different lengths is looked at.
    """
    if method not in ("table", "tree"):
        raise ValueError(f"unknown method {method}")
    d = definitions.select("defid", F.col("tpl").alias("__tpl"), F.size("tpl").alias("__len"), T.literal_bits(F.col("tpl")).alias("__bits"))
    messages = lines.select("words").distinct().withColumn("__len", F.size("words"))
    fits = messages.join(d, "__len").where(T.matches_template(F.col("words"), F.col("__tpl")))
    if method == "tree":
        best = fits.groupBy("words").agg(F.max(F.struct("__bits", (-F.col("defid")).alias("d"), "__tpl")).alias("b")).select("words", (-F.col("b.d")).alias("defid"), F.col("b.__tpl").alias("tpl"))
    else:
        best = fits.groupBy("words").agg(F.min(F.struct("defid", "__tpl")).alias("b")).select("words", F.col("b.defid").alias("defid"), F.col("b.__tpl").alias("tpl"))
    return lines.join(best, "words", "left")


def add_definition(definitions: DataFrame, defid: int, tpl: list[str]) -> DataFrame:
    spark = definitions.sparkSession
    return definitions.unionByName(spark.createDataFrame([(defid, tpl)], "defid long, tpl array<string>"))


def remove_definition(definitions: DataFrame, tpl: list[str]) -> DataFrame:
    return definitions.where(F.col("tpl") != F.array(*map(F.lit, tpl)))


def shuffled(definitions: DataFrame, seed: int = 1) -> DataFrame:
    """The definitions in another order, as only the first that matches counts when they are looked through one by one."""
    order = Window.orderBy(F.xxhash64(F.to_json("tpl"), F.lit(seed)), "defid")  # one row per definition of the site's own file
    return definitions.withColumn("defid", (F.row_number().over(order) - 1).cast("long"))


def external_templates(text: str, mode: str = "plain") -> list[str]:
    """Templates of a file, one a line: plain, or ids, where an id and a blank come before each."""
    if mode not in ("plain", "ids"):
        raise ValueError(f"unknown mode {mode}")
    lines = text.splitlines() if mode == "plain" else [x.partition(" ")[2].strip() for x in text.splitlines()]
    return [x for x in lines if x]


def external_pattern(template: str, placeholder: str = "<*>") -> str:
    """A regular expression that matches whole statements: placeholders capture the shortest span."""
    import re

    return "^" + "(.*?)".join(re.escape(x) for x in template.split(placeholder)) + "$"


def by_external(lines: DataFrame, templates: list[str], placeholder: str = "<*>") -> DataFrame:
    """tpl from templates over raw statements (column statement, not escaped): of the first that matches, tokens overlapping a captured
    span are wildcards. Null if none matches. The templates are a list in the plan; each line tries them in order.
    """
    import re

    which = F.coalesce(*(F.when(F.col("statement").rlike(external_pattern(t, placeholder)), F.lit(i)) for i, t in enumerate(templates)), F.lit(None).cast("int"))
    marked = lines.withColumn("__which", which)
    tpl = F.lit(None).cast("array<string>")
    for i, t in enumerate(templates):
        fixed = [re.escape(x) for x in t.split(placeholder)]
        pattern = "^" + "".join(f"({x})(.*?)" for x in fixed[:-1]) + f"({fixed[-1]})$"
        spans, at = [], F.lit(0)
        for k in range(1, 2 * len(fixed)):
            size = F.length(F.regexp_extract("statement", pattern, k))
            if k % 2 == 0:
                spans.append(F.struct(at.alias("a"), (at + size).alias("b")))
            at = at + size
        held = F.array(*spans) if spans else F.array().cast("array<struct<a:int,b:int>>")
        located = F.aggregate(
            "words",
            F.struct(F.array().cast("array<struct<w:string,a:int,b:int>>").alias("out"), F.lit(0).alias("at")),
            lambda acc, w: F.struct(
                F.concat(acc["out"], F.array(F.struct(w.alias("w"), _find(w, acc["at"]).alias("a"), (_find(w, acc["at"]) + F.length(T.unescape(w))).alias("b")))).alias("out"),
                (_find(w, acc["at"]) + F.length(T.unescape(w))).alias("at"),
            ),
            lambda acc: acc["out"],
        )
        made = F.transform(located, _hidden_by(held))
        tpl = F.when(F.col("__which") == i, made).otherwise(tpl)
    return marked.withColumn("tpl", tpl).drop("__which")


def _hidden_by(spans):
    return lambda x: F.when(F.exists(spans, lambda s: (s["a"] < x["b"]) & (x["a"] < s["b"])), T.WILDCARD).otherwise(x["w"])


def _find(word, at):
    """Where the word begins in the statement, from ``at`` on (counting from zero)."""
    rest = F.substr("statement", at + 1)
    return at + F.instr(rest, T.unescape(word)) - 1


def chain(lines: DataFrame, *generators) -> DataFrame:
    """tpl of the first generator that gives one; method numbers it. Each takes lines and adds tpl, which may be null."""
    out = lines.withColumn("__tpl", F.lit(None).cast("array<string>")).withColumn("method", F.lit(None).cast("int"))
    for i, generator in enumerate(generators):
        made = generator(lines).select("lid", F.col("tpl").alias("__new"))
        out = out.join(made, "lid", "left")
        out = out.withColumn("method", F.when(F.col("__tpl").isNull() & F.col("__new").isNotNull(), F.lit(i)).otherwise(F.col("method")))
        out = out.withColumn("__tpl", F.coalesce("__tpl", "__new")).drop("__new")
    return out.withColumnRenamed("__tpl", "tpl")


def word_statistics(lines: DataFrame) -> DataFrame:
    """word, occurrences and n_lines (of the whole table)."""
    counts = lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    total = lines.agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.join(F.broadcast(total), how="cross")  # one row


def common_template(lines: DataFrame, by: str = "ltid") -> DataFrame:
    """by, tpl: place by place the word that all lines of a group have, not counting wildcards; else a wildcard."""
    places = lines.select(by, F.posexplode("words").alias("p", "w"))
    # Two distinct words decide; min and max are enough to tell one from several, and wildcards do not vote.
    votes = places.groupBy(by, "p").agg(F.min(F.when(F.col("w") != T.WILDCARD, F.col("w"))).alias("lo"), F.max(F.when(F.col("w") != T.WILDCARD, F.col("w"))).alias("hi"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(T.WILDCARD)
    return votes.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", word.alias("w")))), lambda x: x["w"]).alias("tpl"))


def top_values(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent rows for each (ltid, vid) of values (ltid, vid, value, count, first_lid)."""
    order = Window.partitionBy("ltid", "vid").orderBy(F.desc("count"), "first_lid")
    return values.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
