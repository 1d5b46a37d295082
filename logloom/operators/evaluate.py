"""Evaluation of templates: clustering metrics from the contingency table, structure metrics from word pairs, browsers of failures.

labels: line_no, tid_true, tpl_true, tid_pred, tpl_pred. Lines where either side is null are left out together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WILDCARD


def pair_labels(answer: DataFrame, trial: DataFrame) -> DataFrame:
    """Join by line: answer and trial have lid, tid, tpl."""
    a = answer.select(F.col("lid").alias("line_no"), F.col("tid").alias("tid_true"), F.col("tpl").alias("tpl_true"))
    t = trial.select(F.col("lid").alias("line_no"), F.col("tid").alias("tid_pred"), F.col("tpl").alias("tpl_pred"))
    return a.join(t, "line_no").where("tid_true is not null and tid_pred is not null")


def label_text(words, tpl):
    """D, V or N for each word of a line: description, variable, nothing known."""
    return F.when(tpl.isNull(), F.array_join(F.transform(words, lambda w: F.lit("N")), "")).otherwise(F.array_join(F.transform(tpl, lambda t: F.when(t == WILDCARD, "V").otherwise("D")), ""))


def from_label_text(words, labels, mark: bool = False):
    """The template of a label text, or the words with variables as ``*w*``."""
    letters = F.split(labels, "")
    return F.zip_with(words, letters, lambda w, c: F.when(c == "V", F.concat(F.lit("*"), w, F.lit("*")) if mark else F.lit(WILDCARD)).otherwise(w))


def contingency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tid_true", "tid_pred").agg(F.count(F.lit(1)).alias("n"))


def _pairs(n):
    return n * (n - 1) / 2


def pair_counts(labels: DataFrame) -> DataFrame:
    """One row tp, fp, fn, tn over pairs of lines, from cell, row and column sums."""
    cells = contingency(labels)
    sums = lambda by: cells.groupBy(by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("v"))
    both = cells.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    joined = both.join(sums("tid_true").select(F.col("v").alias("t")), how="cross").join(sums("tid_pred").select(F.col("v").alias("p")), how="cross")  # one row each
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return joined.select("tp", (p - tp).alias("fp"), (t - tp).alias("fn"), (_pairs(F.col("total")) - t - p + tp).alias("tn"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def rand_scores(labels: DataFrame) -> DataFrame:
    """rand, precision, recall, f1, adjusted_rand; undefined ones are zero, and identical trivial partitions have adjusted_rand 1."""
    c = pair_counts(labels)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    total = tp + fp + fn + tn
    expected = _ratio((tp + fp) * (tp + fn), total)
    most = (tp + fp + tp + fn) / 2
    adjusted = F.when(most == expected, 1.0).otherwise((tp - expected) / (most - expected))
    return c.select(
        _ratio(tp + tn, total).alias("rand"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        adjusted.alias("adjusted_rand"),
    )


def v_measure(labels: DataFrame, beta: float = 1.0) -> DataFrame:
    """homogeneity, completeness and their weighted harmonic mean, from entropies of the contingency table."""
    cells = contingency(labels)
    total = cells.agg(F.sum("n").alias("total"))
    rows = cells.groupBy("tid_true").agg(F.sum("n").alias("nt"))
    columns = cells.groupBy("tid_pred").agg(F.sum("n").alias("np"))
    full = cells.join(rows, "tid_true").join(columns, "tid_pred").join(F.broadcast(total), how="cross")  # one row
    inner = full.agg(
        (-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("np")))).alias("h_true_given_pred"),
        (-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("nt")))).alias("h_pred_given_true"),
        (-F.sum(F.col("n") / F.col("total") * F.log(F.col("nt") / F.col("total")))).alias("h_true"),
        (-F.sum(F.col("n") / F.col("total") * F.log(F.col("np") / F.col("total")))).alias("h_pred"),
    )
    h = F.when(F.col("h_true") == 0, 1.0).otherwise(1 - F.col("h_true_given_pred") / F.col("h_true"))
    c = F.when(F.col("h_pred") == 0, 1.0).otherwise(1 - F.col("h_pred_given_true") / F.col("h_pred"))
    return inner.select(h.alias("homogeneity"), c.alias("completeness")).withColumn(
        "v_measure", _ratio((1 + beta) * F.col("homogeneity") * F.col("completeness"), beta * F.col("homogeneity") + F.col("completeness"))
    )


def cluster_scores(labels: DataFrame) -> DataFrame:
    """parsing_accuracy (lines), cluster_accuracy (answer clusters), over_division (of answer clusters), over_aggregation (of trial clusters)."""
    cells = contingency(labels)
    rows = cells.groupBy("tid_true").agg(F.count(F.lit(1)).alias("parts"))
    columns = cells.groupBy("tid_pred").agg(F.count(F.lit(1)).alias("owners"))
    full = cells.join(rows, "tid_true").join(columns, "tid_pred")
    exact = (F.col("parts") == 1) & (F.col("owners") == 1)
    lines = full.agg(F.sum(F.when(exact, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("total"), F.sum(exact.cast("int")).alias("clusters"))
    t = rows.agg(F.count(F.lit(1)).alias("nt"), F.sum((F.col("parts") > 1).cast("int")).alias("divided"))
    p = columns.agg(F.count(F.lit(1)).alias("np"), F.sum((F.col("owners") > 1).cast("int")).alias("aggregated"))
    one = lines.join(t, how="cross").join(p, how="cross")  # one row each
    return one.select(
        _ratio(F.col("good"), F.col("total")).alias("parsing_accuracy"),
        _ratio(F.col("clusters"), F.col("nt")).alias("cluster_accuracy"),
        _ratio(F.col("divided"), F.col("nt")).alias("over_division"),
        _ratio(F.col("aggregated"), F.col("np")).alias("over_aggregation"),
    )


def cluster_inventory(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("tid_true").alias("n_answer_clusters"), F.countDistinct("tid_pred").alias("n_trial_clusters"))


def structure_scores(labels: DataFrame) -> DataFrame:
    """word, line, template, template_word, description and variable accuracy; the last four are means over answer clusters."""
    pairs = F.arrays_zip(F.col("tpl_true").alias("a"), F.col("tpl_pred").alias("b"))
    size = lambda f: F.size(F.filter(pairs, f)).cast("long")
    both = lambda x: x["a"].isNotNull() & x["b"].isNotNull()
    counted = labels.select(
        "tid_true",
        (F.col("tpl_true") == F.col("tpl_pred")).cast("int").alias("line"),
        size(both).alias("n"),
        size(lambda x: both(x) & (x["a"] == x["b"])).alias("ok"),
        size(lambda x: both(x) & (x["a"] != WILDCARD)).alias("nd"),
        size(lambda x: both(x) & (x["a"] != WILDCARD) & (x["a"] == x["b"])).alias("okd"),
        size(lambda x: both(x) & (x["a"] == WILDCARD)).alias("nv"),
        size(lambda x: both(x) & (x["a"] == WILDCARD) & (x["a"] == x["b"])).alias("okv"),
    )
    per = counted.groupBy("tid_true").agg(F.count(F.lit(1)).alias("lines"), *(F.sum(x).alias(x) for x in ("line", "n", "ok", "nd", "okd", "nv", "okv")))
    return per.agg(
        _ratio(F.sum("ok"), F.sum("n")).alias("word_accuracy"),
        _ratio(F.sum("line"), F.sum("lines")).alias("line_accuracy"),
        F.avg(F.col("line") / F.col("lines")).alias("template_accuracy"),
        F.avg(F.try_divide("ok", "n")).alias("template_word_accuracy"),
        F.avg(F.try_divide("okd", "nd")).alias("description_accuracy"),
        F.avg(F.try_divide("okv", "nv")).alias("variable_accuracy"),
    )


def final_templates(labels: DataFrame) -> DataFrame:
    """The last trial template of each trial cluster."""
    return labels.groupBy("tid_pred").agg(F.max_by("tpl_pred", "line_no").alias("tpl"))


def final_structure_scores(labels: DataFrame) -> DataFrame:
    """Structure metrics where every line has its cluster's final template."""
    last = final_templates(labels).withColumnRenamed("tpl", "__last")
    return structure_scores(labels.join(last, "tid_pred").withColumn("tpl_pred", F.col("__last")).drop("__last"))


def first_failures(labels: DataFrame) -> DataFrame:
    """Of each answer cluster the first line, if its templates differ there."""
    order = Window.partitionBy("tid_true").orderBy("line_no")
    return labels.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r").where(F.col("tpl_true") != F.col("tpl_pred"))


def differing_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines that the first trial gets right and the second wrong."""
    a = first.select("line_no", "tpl_true", F.col("tpl_pred").alias("tpl_first"))
    b = second.select("line_no", F.col("tpl_pred").alias("tpl_second"))
    return a.join(b, "line_no").where((F.col("tpl_first") == F.col("tpl_true")) & (F.col("tpl_second") != F.col("tpl_true")))


def samples_of_divided(labels: DataFrame, n: int = 1, aggregated: bool = False) -> DataFrame:
    """Up to ``n`` first lines of each cell of answer clusters that are divided, or of trial clusters that are aggregated."""
    whole, part = ("tid_pred", "tid_true") if aggregated else ("tid_true", "tid_pred")
    cells = contingency(labels)
    broken = cells.groupBy(whole).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    order = Window.partitionBy(whole, part).orderBy("line_no")
    return labels.join(broken, whole).withColumn("sample", F.row_number().over(order).cast("long")).where(F.col("sample") <= n)


def complete_clusters(labels: DataFrame) -> DataFrame:
    """Answer clusters that one trial cluster holds exactly."""
    cells = contingency(labels)
    rows = cells.groupBy("tid_true").agg(F.count(F.lit(1)).alias("parts"), F.first("tid_pred").alias("tid_pred"))
    columns = cells.groupBy("tid_pred").agg(F.count(F.lit(1)).alias("owners"))
    return rows.join(columns, "tid_pred").where("parts = 1 and owners = 1").select("tid_true")


def trial_scores(answer: DataFrame, trials: DataFrame) -> DataFrame:
    """One row of scores for each trial of ``trials`` (trial, lid, tid, tpl); trials are few."""
    out = None
    for row in trials.select("trial").distinct().orderBy("trial").collect():
        labels = pair_labels(answer, trials.where(F.col("trial") == row.trial).drop("trial"))
        made = structure_scores(labels).join(rand_scores(labels), how="cross").join(cluster_scores(labels), how="cross")  # one row each
        made = made.select(F.lit(row.trial).alias("trial"), *made.columns)
        out = made if out is None else out.unionByName(made)
    return out


def average_over_trials(scores: DataFrame) -> DataFrame:
    """Mean of each metric over trials; scores: trial, metric, value."""
    return scores.groupBy("metric").agg(F.avg("value").alias("value"))


def search_parameters(lines: DataFrame, answer: DataFrame, generator, grid: list[dict], metric=rand_scores, column: str = "f1") -> list[tuple[dict, float]]:
    """Parameters and their score, best first: each trial is a job of its own over the same lines."""
    out = []
    for parameters in grid:
        trial = generator(lines, **parameters)
        tid = F.col("cid") if "cid" in trial.columns else F.to_json("tpl")
        scored = metric(pair_labels(answer, trial.withColumn("tid", tid))).first()
        out.append((parameters, float(scored[column])))
    return sorted(out, key=lambda x: -x[1])
