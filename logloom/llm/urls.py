"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed rules are keys ``host + path prefix``. A URL may match the key of each of its host suffixes with each listed prefix length of its
path. All of these candidate keys are tested against a blocked Bloom filter (each key sets and tests bits of one 64-bit word only),
and the few that pass go on to an exact hash join with the list, which removes the false positives. The longest matching rule wins.

Scale: the filter has about 16 bits per rule and travels with the plan as one binary literal up to ``bloom_rules`` rules, a checked
bound; beyond it all candidates go to the join, which is exact by itself. A page none of whose keys passes is judged where it is read.
Only pages with passing keys are exploded, joined and gathered again, each by a number of its own, so neither a URL that a third of all
pages share nor missing URLs meet in one task. All expressions are built-in ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's rules. Action, rule.
CONTRACT_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Listed canonical URLs that the method adds: whole hosts of spam, blocked at any path.
LISTED_HOSTS = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
#: Most rules whose filter travels with the plan (16 bits each: 2 MB).
BLOOM_RULES = 1_000_000
#: Most rules that are broadcast to the exact join; beyond it both sides are shuffled.
BROADCAST_RULES = 10_000
_BITS_PER_WORD = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the contract defines them; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _mask(h: Column) -> Column:
    """The bits of a key within its word."""
    bits = [F.expr("1L"), *([F.expr("1L")] * (_BITS_PER_WORD - 1))]
    out = F.lit(0).cast("long")
    for i, one in enumerate(bits):
        out = out.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_filter(rules: DataFrame, words: int) -> bytes:
    """The filter over column ``key``: each key's bits, united by word; words of eight bytes, the highest first."""
    h = F.xxhash64("key")
    made = rules.select(F.pmod(F.shiftrightunsigned(h, 32), F.lit(words)).alias("w"), _mask(h).alias("m"))
    out = bytearray(8 * words)
    for w, m in made.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        out[8 * w : 8 * w + 8] = m.to_bytes(8, "big", signed=True)
    return bytes(out)


def might_hold(key: Column, filled: bytes) -> Column:
    """Whether the filter may hold ``key``."""
    h = F.xxhash64(key)
    at = F.pmod(F.shiftrightunsigned(h, 32), F.lit(len(filled) // 8)).cast("int")
    word = F.conv(F.hex(F.substring(F.lit(filled), 8 * at + 1, 8)), 16, -10).cast("long")
    return word.bitwiseAND(_mask(h)) == _mask(h)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix, by labels, with each prefix of the path that has one of ``lengths`` characters."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def default_rules(spark: SparkSession) -> DataFrame:
    """The contract's rules and the listed spam hosts; ``listed`` marks the latter."""
    rows = [(r, a, False) for a, r in CONTRACT_RULES] + [(r, "block", True) for r in LISTED_HOSTS]
    return spark.createDataFrame(rows, "rule string, action string, listed boolean")


def judge_pages(pages: DataFrame, rules: DataFrame, bloom_rules: int = BLOOM_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    rules: rule (host, then path prefix from its first slash), action (block or allow), listed. The longest fitting rule that is not
    listed gives rule and verdict; without one, rule is null and the verdict is block if a listed entry fits, else allow. Null urls and
    such without ``://`` have empty host and path, fit nothing and are allowed. Rules without a slash or that are null are ignored;
    of equal rules the blocking one counts. Repeated rows and null page_ids are kept as they are.
    """
    clean = rules.where(F.instr("rule", "/") > 0).groupBy(F.col("rule").alias("key")).agg(F.max("action").alias("action"), F.min("listed").alias("listed"))
    clean = clean.withColumn("path_length", F.length("key") - F.instr("key", "/") + 1)
    found = clean.agg(F.count(F.lit(1)).alias("n"), F.collect_set("path_length").alias("lengths")).first()
    host, path = split_url(F.col("url").cast("string"))
    split = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    # collect_set is bounded by the length of the longest rule
    keys = F.when(F.col("host") != "", candidates(F.col("host"), F.col("path"), sorted(found.lengths) or [1]))
    if found.n <= bloom_rules:
        filled = bloom_filter(clean, max(16, found.n // 4))
        keys = F.filter(keys, lambda k: might_hold(k, filled))
    marked = split.select("page_id", "host", "path", F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
    none = marked.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    some = marked.where(F.size("keys") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode("keys"))
    exact = some.join(F.broadcast(clean) if found.n <= BROADCAST_RULES else clean, "key", "left")
    rank = F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("action").alias("action"))
    best = exact.groupBy("row").agg(
        *(F.first(x).alias(x) for x in ("page_id", "host", "path")),
        F.max(F.when(~F.col("listed"), rank)).alias("best"),
        F.max(F.when(F.col("listed"), rank)).alias("spam"),
    )
    verdict = F.coalesce("best.action", "spam.action", F.lit("allow"))
    return none.unionByName(best.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict")))
