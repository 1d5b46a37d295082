"""Supervised tagging of words as description or variable: a linear-chain conditional random field, decoded by Viterbi.

Training runs on the driver over a bounded sample of labelled lines, by the gradient of the penalised likelihood (forward and backward
sums); tagging is a map over the lines.
"""

from __future__ import annotations

import json
import math
import random
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WILDCARD

LABELS = ("D", "V")


def middle_label(word: str) -> str:
    """A coarse class of the word: digits, with digits, letters, or other."""
    if word.isdigit():
        return "digit"
    if any(c.isdigit() for c in word):
        return "mixed"
    return "alpha" if word.isalpha() else "symbol"


def parse_templates(lines: list[str]) -> list[list[tuple[str, int]]]:
    """Feature templates ``field[offset],field[offset]: weight``; the weight is read and left out; ``#`` comments."""
    out = []
    for line in lines:
        body = line.split("#")[0].rpartition(":")[0] or line.split("#")[0]
        parts = [p.strip() for p in body.split(",") if p.strip()]
        if parts:
            out.append([(p.partition("[")[0], int(p.partition("[")[2].rstrip("]") or 0)) for p in parts])
    return out


DEFAULT_TEMPLATES = parse_templates(["w[0]", "m[0]", "w[-1]", "w[1]", "m[-1],m[0]", "m[0],m[1]", "w[-1],w[0]", "m[-1],m[0],m[1]"])


def features(words: list[str], middles: list[str], templates) -> list[list[str]]:
    fields = {"w": words, "m": middles}
    n = len(words)

    def value(name: str, i: int) -> str:
        return "BOS" if i < 0 else "EOS" if i >= n else fields[name][i]

    return [["|".join(f"{f}{o}={value(f, i + o)}" for f, o in t) for t in templates] for i in range(n)]


class Chain:
    """Weights of a linear chain."""

    def __init__(self, templates=None):
        self.templates = templates or DEFAULT_TEMPLATES
        self.weights: dict[tuple[str, str], float] = {}

    def decode(self, words: list[str], middles: list[str] | None = None) -> list[str]:
        if not words:
            return []
        found = features(words, middles or [middle_label(w) for w in words], self.templates)
        get = self.weights.get
        best = {y: sum(get((f, y), 0.0) for f in found[0]) for y in LABELS}
        back = []
        for fs in found[1:]:
            step, links = {}, {}
            for y in LABELS:
                own = sum(get((f, y), 0.0) for f in fs)
                score, link = max((best[x] + get((f"t={x}", y), 0.0), x) for x in LABELS)
                step[y], links[y] = score + own, link
            best = step
            back.append(links)
        y = max(LABELS, key=lambda k: best[k])
        out = [y]
        for links in reversed(back):
            y = links[y]
            out.append(y)
        return out[::-1]

    def scores(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each label at each word, and of each label after each other one."""
        get = self.weights.get
        own = np.array([[sum(get((f, y), 0.0) for f in fs) for y in LABELS] for fs in found])
        return own, np.array([[get((f"t={x}", y), 0.0) for y in LABELS] for x in LABELS])

    def marginals(self, found: list[list[str]]) -> tuple[float, np.ndarray, np.ndarray]:
        """The logarithm of the sum over all labellings, and the probabilities of labels and of pairs of labels at each word."""
        own, step = self.scores(found)
        n = len(own)
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[0] = own[0]
        for i in range(1, n):
            ahead[i] = own[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + step, axis=0)
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp.reduce(step + (own[i + 1] + behind[i + 1])[None], axis=1)
        total = float(np.logaddexp.reduce(ahead[-1]))
        one = np.exp(ahead + behind - total)
        two = np.exp(ahead[:-1, :, None] + step[None] + (own[1:] + behind[1:])[:, None, :] - total)
        return total, one, two

    def log_likelihood(self, data: list[tuple[list[str], list[str], list[str]]]) -> float:
        """The sum over lines of the log probability of their labels."""
        out = 0.0
        for words, middles, labels in data:
            if words:
                found = features(words, middles, self.templates)
                own, step = self.scores(found)
                at = [LABELS.index(y) for y in labels]
                out += sum(own[i][y] for i, y in enumerate(at)) + sum(step[x][y] for x, y in zip(at, at[1:], strict=False)) - self.marginals(found)[0]
        return out

    def fit(self, data: list[tuple[list[str], list[str], list[str]]], rounds: int = 10, seed: int = 1, penalty: float = 0.01, rate: float = 0.5) -> Chain:
        """Maximise the likelihood of data (words, middles and labels of each line), less ``penalty`` times the squared weights.

        Lines are taken one by one in random order; a weight's steps shrink with what its gradients came to so far.
        """
        rng, seen = random.Random(seed), defaultdict(float)
        lines = [(features(w, m, self.templates), y) for w, m, y in data if w]
        for _ in range(rounds):
            rng.shuffle(lines)
            for found, labels in lines:
                _, one, two = self.marginals(found)
                change: dict[tuple[str, str], float] = defaultdict(float)
                for i, (fs, y) in enumerate(zip(found, labels, strict=True)):
                    for k, label in enumerate(LABELS):
                        g = (label == y) - one[i][k]
                        for f in fs:
                            change[f, label] += g
                for j, x in enumerate(LABELS):
                    for k, y in enumerate(LABELS):
                        change[f"t={x}", y] += sum((a, b) == (x, y) for a, b in zip(labels, labels[1:], strict=False)) - float(two[:, j, k].sum())
                for key, g in change.items():
                    g -= penalty * self.weights.get(key, 0.0)
                    seen[key] += g * g
                    if g:
                        self.weights[key] = self.weights.get(key, 0.0) + rate * g / math.sqrt(seen[key])
        return self

    def saved(self) -> str:
        return json.dumps([self.templates, [[*k, w] for k, w in self.weights.items()]])

    @classmethod
    def read(cls, text: str) -> Chain:
        templates, weights = json.loads(text)
        made = cls([[tuple(x) for x in t] for t in templates])
        made.weights = {(f, y): w for f, y, w in weights}
        return made


def sample_lines(lines: DataFrame, n: int, method: str = "all", seed: int = 1, key: Column | None = None) -> DataFrame:
    """Training lines: all, random, ltgen (evenly over what another generator puts together, named by ``key``) or leak (evenly over the
    lines' own templates, which training should not know); at most ``n``, the driver's bound.
    """
    if method == "all":
        return lines.orderBy("lid").limit(n)
    shuffled = F.xxhash64("lid", F.lit(seed))
    if method == "random":
        return lines.orderBy(shuffled, "lid").limit(n)
    if method in ("ltgen", "leak"):
        by = F.to_json("tpl") if method == "leak" or key is None else key
        turn = F.row_number().over(Window.partitionBy(by).orderBy(shuffled, "lid"))
        return lines.withColumn("__t", turn).where(F.col("__t") <= n).orderBy("__t", shuffled).limit(n).drop("__t")
    raise ValueError(f"unknown method {method}")


def train(lines: DataFrame, n: int = 1000, method: str = "random", rounds: int = 10, templates=None, key: Column | None = None) -> Chain:
    """A model from lines with words and tpl, of which a sample of at most ``n`` is used."""
    rows = sample_lines(lines.where("tpl is not null"), n, method, key=key).select("lid", "words", "tpl").collect()
    rows.sort(key=lambda r: r.lid)
    return Chain(templates).fit([(r.words, [middle_label(w) for w in r.words], ["V" if t == WILDCARD else "D" for t in r.tpl]) for r in rows], rounds)


def train_items(text: str, rounds: int = 10, templates=None) -> Chain:
    """A model from a training file (see ``read_items``)."""
    return Chain(templates).fit(read_items(text), rounds)


def read_items(text: str) -> list[tuple[list[str], list[str], list[str]]]:
    """Blank-line separated lines of ``word middle label``."""
    out = []
    for block in text.strip().split("\n\n"):
        rows = [x.split() for x in block.splitlines() if x.strip()]
        if rows:
            out.append(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
    return out


def items_text(lines: DataFrame) -> DataFrame:
    """The training text of each line, as ``read_items`` takes it: lid, value."""
    spec = F.when(F.col("x.w").rlike(r"^\d+$"), "digit").when(F.col("x.w").rlike(r"\d"), "mixed").when(F.col("x.w").rlike(r"^\p{L}+$"), "alpha").otherwise("symbol")
    rows = lines.select("lid", F.posexplode(F.arrays_zip(F.col("words").alias("w"), F.col("tpl").alias("t"))).alias("p", "x"))
    text = F.concat_ws(" ", F.col("x.w"), spec, F.when(F.col("x.t") == WILDCARD, "V").otherwise("D"))
    return rows.groupBy("lid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("v")))), lambda x: x["v"]), "\n").alias("value"))


def tag(lines: DataFrame, model: Chain) -> DataFrame:
    """lines with tpl by the model, whose size the training sample bounds."""
    schema = "lid long, tpl array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[w if y == "D" else WILDCARD for w, y in zip(words, model.decode(words), strict=True)] for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], ["lid", "tpl"])

    return lines.select("lid", "words").mapInArrow(run, schema)
