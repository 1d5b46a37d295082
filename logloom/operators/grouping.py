"""Groups of templates. Templates are few compared to lines: pairs come from shared n-grams, and the ordered pass runs over one row each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .cluster import edit_distance


def identity(lt: DataFrame) -> DataFrame:
    """Every template is its own group."""
    return lt.select("ltid", F.col("ltid").alias("ltgid"))


def ngram_pairs(lt: DataFrame, n: int = 3, compat: bool = False) -> DataFrame:
    """ltid, other (smaller), ratio of shared n-grams: twice the shared ones over the sum of both counts.

    compat leaves out each template's last n-gram and takes n for the other's count.
    """
    grams = lt.select("ltid", T.ngrams(F.col("ltw"), n, drop_last=compat).alias("grams"))
    flat = grams.select("ltid", F.size("grams").alias("k"), F.explode("grams").alias("g")).withColumn("g", F.array_join("g", "\u0001"))
    left = flat.groupBy("ltid", "k", "g").agg(F.count(F.lit(1)).alias("c"))
    right = left.select(F.col("ltid").alias("other"), F.col("k").alias("ko"), "g", F.col("c").alias("co"))
    shared = left.join(right, "g").where("other < ltid").groupBy("ltid", "other", "k", "ko").agg(F.sum(F.least("c", "co")).alias("s"))
    size = F.col("k") + (F.lit(n) if compat else F.col("ko"))
    return shared.select("ltid", "other", (2.0 * F.col("s") / size).alias("ratio"))


def by_ngrams(lt: DataFrame, n: int = 3, th_lookup: float = 0.3, th_distance: float = 0.85, compat: bool = False) -> DataFrame:
    """ltid, ltgid: a template joins the group of the earlier one that shares most n-grams, if that is near enough by word edits."""
    pairs = ngram_pairs(lt, n, compat).where(F.col("ratio") > th_lookup)
    best = pairs.groupBy("ltid").agg(F.max(F.struct("ratio", (-F.col("other")).alias("o"))).alias("b")).select("ltid", (-F.col("b.o")).alias("other"))
    joined = lt.select("ltid", "ltw").join(best, "ltid", "left").join(lt.select(F.col("ltid").alias("other"), F.col("ltw").alias("ow")), "other", "left")
    distance = F.when(F.col("other").isNotNull(), 2.0 * T.word_edit_distance(F.col("ltw"), F.col("ow")) / (F.size("ltw") + F.size("ow")))
    return _followed(joined.select("ltid", F.when(distance < th_distance, F.col("other")).alias("other")))


def _followed(linked: DataFrame) -> DataFrame:
    """ltid, ltgid from links to earlier templates (ltid, other or null): groups are numbered as they come. One row of two numbers per template."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, int] = {}
        for batch in batches:
            out = []
            for ltid, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                group[ltid] = group[other] if other in group else len(set(group.values()))
                out.append(group[ltid])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["ltid", "ltgid"])

    return linked.coalesce(1).sortWithinPartitions("ltid").mapInArrow(follow, "ltid long, ltgid long")


def by_fuzzy_text(lt: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """ltid, ltgid: each template joins the group of the most similar earlier one (the first of these), if it is similar enough.

    Similarity is that of the sets of character n-grams, an approximation where no fuzzy hash library is there. Candidates come from a
    prefix filter: with grams in the order of their frequency, similar sets share one of their first k - threshold * k + 1, so frequent
    grams make no pairs.
    """
    text = lt.select("ltid", F.array_join("ltw", " ").alias("t"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1)))
    sets = text.select("ltid", F.array_distinct(F.transform(starts, lambda i: F.substr("t", i, F.lit(n)))).alias("g"))
    flat = sets.select("ltid", F.explode("g").alias("x"))
    ranked = flat.join(flat.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "x")
    order = ranked.groupBy("ltid").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda v: v["x"]).alias("o"))
    first = order.select("ltid", F.explode(F.slice("o", F.lit(1), (F.size("o") - F.ceil(threshold * F.size("o")) + 1).cast("int"))).alias("x"))
    pairs = first.join(first.withColumnRenamed("ltid", "other"), "x").where("other < ltid").select("ltid", "other").distinct()
    both = pairs.join(sets, "ltid").join(sets.select(F.col("ltid").alias("other"), F.col("g").alias("h")), "other")
    scored = both.select("ltid", "other", (F.size(F.array_intersect("g", "h")) / F.size(F.array_union("g", "h"))).alias("s")).where(F.col("s") >= threshold)
    best = scored.groupBy("ltid").agg((-F.max(F.struct("s", (-F.col("other")).alias("o")))["o"]).alias("other"))
    return _followed(lt.select("ltid").join(best, "ltid", "left"))


def tokens_for_meaning(lt: DataFrame, least_length: int = 2, stop_words: tuple[str, ...] = (), exceptions: tuple[str, ...] = ()) -> DataFrame:
    """ltid, tokens: lower-case letters-only description words, long enough and no stop words."""
    words = F.transform(T.description(F.col("ltw")), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    kept = F.filter(words, lambda w: ((F.length(w) >= least_length) & ~w.isin(list(stop_words) or [""])) | w.isin(list(exceptions) or ["\u0001"]))
    return lt.select("ltid", *(["domain"] if "domain" in lt.columns else []), kept.alias("tokens"))


def by_meaning(lt: DataFrame, topics: int = 10, radius: float = 0.1, least: int = 1, seed: int = 1, **options) -> DataFrame:
    """ltid, ltgid: topic mixtures of template words (LDA), then density clusters of them. Approximate by nature.

    With a column ``domain`` templates of several data sets share one model. The clustering step runs over one row per template.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    prepared = tokens_for_meaning(lt, **options)
    usable = prepared.where(F.size("tokens") > 0)
    if usable.isEmpty():
        return identity(lt)
    counted = CountVectorizer(inputCol="tokens", outputCol="features").fit(usable).transform(usable)
    model = LDA(k=topics, maxIter=20, seed=seed).fit(counted.orderBy("ltid"))
    mixed = model.transform(counted).select("ltid", F.expr("topicDistribution").alias("v"))
    from pyspark.ml.functions import vector_to_array

    rows = mixed.select("ltid", vector_to_array("v").alias("v"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, vectors = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
        x = np.array(vectors).reshape(len(ids), -1)
        label = [-1] * len(ids)
        group = 0
        for i in range(len(ids)):
            if label[i] >= 0:
                continue
            label[i], todo = group, [i]
            while todo:
                j = todo.pop()
                near = np.flatnonzero(np.sqrt(((x - x[j]) ** 2).sum(axis=1)) <= radius)
                if len(near) >= least:
                    for k in near.tolist():
                        if label[k] < 0:
                            label[k] = group
                            todo.append(k)
            group += 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int64())], ["ltid", "ltgid"])

    found = rows.coalesce(1).sortWithinPartitions("ltid").mapInArrow(dense, "ltid long, ltgid long")
    return lt.select("ltid").join(found, "ltid", "left").withColumn("ltgid", F.coalesce("ltgid", F.lit(1_000_000_000) + F.col("ltid")))


def remake(lt: DataFrame, method: str = "none", **options) -> DataFrame:
    """ltid, ltgid of all templates by method: none, shiso, fuzzy or semantics."""
    methods = {"none": identity, "shiso": by_ngrams, "fuzzy": by_fuzzy_text, "semantics": by_meaning}
    return methods[method](lt, **options)


__all__ = ["by_fuzzy_text", "by_meaning", "by_ngrams", "edit_distance", "identity", "ngram_pairs", "remake"]
