"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

Statistics of a text (not its id, source, language or labels) are standardised and mapped to random Fourier features, cosines whose
inner products approximate a Gaussian kernel. Each partition sums the normal equations of its labelled rows; the sums are added up by
executors in two levels and the small system is solved on the driver. The raw scores of rows that took no part in the fit are turned
into probabilities by isotonic regression over a fixed number of score bins.

Scale: texts are read once and never shuffled; statistics (a few dozen numbers a document) are stored and joined with the labels. The
driver sees a fixed amount: one matrix for each of at most ``groups`` groups of partitions, and the score bins. All labelled rows are used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import text_statistics

NAMES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "stutter_share", "bar_share", "mark_share",
    "distinct_share", "top_share", "digit_share", "punctuation_share", "line_words", "entropy", "short_line_share", "longest_word", "non_ascii_share", "bigram_share", "title_share",
]
FEATURES = 300
WIDTH = 4.0
RIDGE = 1e-3
BINS = 1000
SEED = 7

_PUNCTUATION = bytes(b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))


def document_statistics(data: bytes) -> list[float]:
    """The statistics NAMES of a text as UTF-8; an empty one has zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    _, chars, symbols, dup, repeat, upper, symbol_share, dup_share, stutter, bars, marks = text_statistics(data)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    tally = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    share = tally / n
    lines = data.count(b"\n") + 1
    size = len(data)
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = letters[letters > 0] / size
    return [
        float(np.log1p(n)),
        chars / n,
        min(symbol_share, 2.0),
        dup_share,
        repeat / n,
        upper,
        stutter,
        bars,
        marks,
        len(counts) / n**0.85,
        float(share.max()),
        float(letters[48:58].sum()) / size,
        (size - len(data.translate(None, _PUNCTUATION))) / size,
        float(np.log1p(n / lines)),
        float(-(p * np.log2(p)).sum()),
        sum(len(x) < 20 for x in data.split(b"\n")) / lines,
        float(np.log1p(max(map(len, words)))),
        float(letters[128:].sum()) / size,
        pairs / max(1, n - 1),
        sum(w[:1].isupper() for w in words) / n,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and __ll_x (array<double>) of each row of ``docs`` (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch):
                rows = [document_statistics(x) for x in common.utf8(part.column(1))]
                ids = part.column(0).to_pylist()
                rest = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rest, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "__ll_fold", "__ll_x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, __ll_fold int, __ll_x array<double>")


class Model:
    """Standardisation, random features, ridge weights and calibration, all of fixed size."""

    def __init__(self, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
        self.turn = rng.standard_normal((len(NAMES), features)) / width
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.bin_low, self.bin_high = 0.0, 1.0
        self.calibrated = np.array([0.5])

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        at = (raw - self.bin_low) / (self.bin_high - self.bin_low) * BINS
        return np.clip(at.astype(np.int64), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; the raw score adds a sliver within what calibration ties, so that ranks are kept."""
        raw = self.raw(x)
        p = self.calibrated[self.bins(raw)] if len(self.calibrated) > 1 else np.full(len(x), self.calibrated[0])
        return np.clip(p * 0.999 + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over the shares of good, each drawn towards one half by one more row; empty bins join the bin before.

    The drawn shares themselves are pooled until none exceeds the next, so the result never decreases, whatever the totals.
    """
    blocks: list[list[float]] = []
    share = lambda x: (x[0] + 0.5) / (x[1] + 1)
    for g, t in zip(good, total, strict=True):
        if not t and blocks:
            blocks[-1][2] += 1
            continue
        blocks.append([float(g), float(t), 1])
        while len(blocks) > 1 and (blocks[-2][1] == 0 or share(blocks[-2]) >= share(blocks[-1])):
            g2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(x[2]), share(x)) for x in blocks])


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))


def _summed_equations(rows: DataFrame, model: Model, groups: int) -> np.ndarray:
    """The sum of [Z y]'[Z y] over ``rows`` (__ll_x, y), by partition, then by group of partitions, then on the driver."""
    size = len(model.weights) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size))
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                z = np.concatenate([model.mapped(_matrix(part, 0)), part.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]], axis=1)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((size, size)), False
        for batch in batches:
            for m in batch.column(1).to_pylist():
                total += np.frombuffer(m).reshape(size, size)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "m"])

    sums = rows.mapInArrow(partial, "g int, m binary").repartition(groups, "g").mapInArrow(added, "g int, m binary")
    total = np.zeros((size, size))
    for row in sums.toLocalIterator():
        total += np.frombuffer(bytes(row[1])).reshape(size, size)
    return total


def fit(stats: DataFrame, labels: DataFrame, groups: int = 8) -> Model:
    """A model from ``stats`` (of ``statistics``) and ``labels`` (doc_id, quality); rows of fold 0 are never looked at.

    Folds 2, 3 and 4 give the normal equations, fold 1 the calibration. Labels that are null or neither 0 nor 1 are left out. A doc_id
    that ``labels`` has several times counts once, and not at all if its labels differ. With no labelled row the model scores 0.5 for all.
    """
    model = Model()
    marks = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__ll_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    known = marks.where("y = z").select("__ll_id", F.col("y").cast("double").alias("y"))
    rows = common.stored(stats.where("__ll_fold != 0").join(known, F.col("doc_id") == F.col("__ll_id")).select("__ll_fold", "__ll_x", "y"))
    moments = rows.select(*(F.col("__ll_x")[i].alias(f"x{i}") for i in range(len(NAMES)))).agg(
        F.count(F.lit(1)).alias("n"),
        *(f(f"x{i}").alias(f"{a}{i}") for i in range(len(NAMES)) for a, f in (("m", F.avg), ("s", F.stddev_pop))),
    ).first()
    if not moments.n:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(len(NAMES))])
    model.scale = np.array([moments[f"s{i}"] or 1.0 for i in range(len(NAMES))])
    equations = _summed_equations(rows.where("__ll_fold != 1").select("__ll_x", "y"), model, groups)
    count = max(1.0, equations[-2, -2])
    a, b = equations[:-1, :-1] / count, equations[:-1, -1] / count
    model.weights = np.linalg.solve(a + RIDGE / len(model.phase) * np.eye(len(a)), b)
    model.bin_low, model.bin_high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.bins(model.raw(_matrix(batch, 0)))), batch.column(1)], ["bin", "y"])

    tally = rows.where("__ll_fold = 1").select("__ll_x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("y").alias("total")).collect()
    good, total = np.zeros(BINS), np.zeros(BINS)
    for row in tally:
        good[row.bin], total[row.bin] = row.good, row.total
    if total.sum():
        model.calibrated = isotonic(good, total)
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``stats``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.score(_matrix(batch, 2))
            fold = pc.equal(batch.column(1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(fold, False), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "__ll_fold", "__ll_x").mapInArrow(made, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores for every row of ``docs`` (doc_id, text), by a model fitted on ``labels`` outside the held-out fold.

    held_out: crc32(doc_id as text) mod 5 is 0. Null and empty texts have all statistics zero and are scored like others; a null doc_id
    is in no fold: scored, not held out, never learned from. Repeated rows each get their row; an empty table gives no rows.
    """
    stats = common.stored(statistics(docs))
    return score(stats, fit(stats, labels), threshold)
