"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become word sequences. A word window of ``min_match`` words that both share is a seed, found by running
(Karp-Rabin) hashes. For each document and item with a seed, the longest common match that overlaps no earlier one is marked, again
and again, until none of ``min_match`` words is left; since tiles may lie in any order, reordered passages are caught. A document is
contaminated by an item if the tiles cover at least ``threshold`` of the item's words.

Scale: documents are read in one map and never shuffled. Benchmarks go to the executors in blocks of at most ``block_bytes``, a checked
size; a larger benchmark takes one pass over the documents per block. A block's index consists of a few arrays (about 60 bytes a word,
some 160 MB for a full block) and is built once in each worker process. Seeds that follow each other on a diagonal are one run, and only
the starts of runs are kept, so texts that repeat one word over and over need no room for all pairs of their places. Only hits leave
the map.
"""

from __future__ import annotations

import heapq
import sys
import types
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_BYTES = 16 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` ids, each from the same running sum: h = sum of id * p^i, modulo 2^64."""
    if len(ids) < width:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out = np.zeros(len(ids) - width + 1, dtype=np.uint64)
        for i in range(width):
            out = out * _PRIME + mixed[i : i + len(out)]
    return out


def greedy(runs: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Tiles out of maximal matches (document start, item start, length): longest first, ties by document and then item position.

    A word belongs to one tile at most; what is left of a match beside earlier tiles is a match again if it has ``width`` words.
    """
    if not runs:
        return []
    used_doc, used_item = (np.zeros(max(r[k] + r[2] for r in runs), dtype=bool) for k in (0, 1))
    made = []
    queue = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(queue)
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        used = used_doc[i : i + n] | used_item[j : j + n]
        if not used.any():
            made.append((i, j, n))
            used_doc[i : i + n] = True
            used_item[j : j + n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin >= width:
                heapq.heappush(queue, (begin - end, i + begin, j + begin))
    return made


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words two sequences share."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


class Index:
    """Benchmark items as arrays: the ids of their words, one after the other, and the places of their seed windows sorted by hash.

    A word's id is its place in the sorted vocabulary of the items. Items shorter than a seed have to occur whole: they are windows of
    their own width.
    """

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        fold = _fold()
        rows = [(item_id, text.translate(fold).split()) for item_id, text in items]
        rows = [(item_id, words) for item_id, words in rows if words]
        self.item_ids = [item_id for item_id, _ in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in rows for w in words}))}
        self.begins = np.concatenate([[0], np.cumsum([len(words) for _, words in rows])]).astype(np.int64)
        self.words = np.fromiter((self.vocabulary[w] for _, words in rows for w in words), dtype=np.int32, count=int(self.begins[-1]))
        self.least = np.minimum(width, np.diff(self.begins))
        self.tables = {}
        for w in sorted(set(self.least.tolist())):
            own = np.flatnonzero(self.least == w)
            places = np.concatenate([np.arange(self.begins[k], self.begins[k + 1] - w + 1) for k in own])
            hashes = running_hashes(self.words, w)[places]
            order = np.argsort(hashes, kind="stable")
            self.tables[w] = hashes[order], places[order]

    def words_of(self, data: bytes, fold: bytes) -> np.ndarray:
        """The ids of a text's words; -1 for those that no item has."""
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in data.translate(fold).split()), dtype=np.int32)

    def runs(self, ids: np.ndarray, most: int = 1 << 20) -> dict[int, list[tuple[int, int, int]]]:
        """item number: its maximal matches (document start, item start, length) of at least the item's seed width."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        outside = np.concatenate([[0], np.cumsum(ids < 0)])
        for width, (hashes, places) in self.tables.items():
            if len(ids) < width:
                continue
            inside = np.flatnonzero(outside[width:] == outside[:-width])
            own = running_hashes(ids, width)[inside]
            low, high = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
            hit = np.flatnonzero(high > low)
            at, low, count = inside[hit], low[hit], (high - low)[hit]
            for begin in self._pieces(count, most):
                i = np.repeat(at[begin], count[begin])
                first = np.cumsum(count[begin]) - count[begin]
                j = places[np.repeat(low[begin] - first, count[begin]) + np.arange(len(i))]
                item = np.searchsorted(self.begins, j, side="right") - 1
                # A pair whose words before are equal as well lies within a run that began earlier.
                before = (i > 0) & (j > self.begins[item]) & (ids[i - 1] == self.words[j - 1])
                for x, y, k in zip(i[~before].tolist(), j[~before].tolist(), item[~before].tolist(), strict=True):
                    n = _common(ids[x:], self.words[y : self.begins[k + 1]])
                    if n >= width:
                        found[k].append((x, y - int(self.begins[k]), n))
        return found

    @staticmethod
    def _pieces(count: np.ndarray, most: int) -> Iterator[slice]:
        """Slices of the matched places with about ``most`` pairs each, but one place at least."""
        total = np.cumsum(count)
        begin = 0
        while begin < len(count):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
            yield slice(begin, end)
            begin = end

    def hits(self, data: bytes, fold: bytes) -> list[tuple]:
        """(item_id, item words, covered words, tiles) of every item that shares a seed with the text."""
        out = []
        for k, runs in sorted(self.runs(self.words_of(data, fold)).items()):
            made = greedy(runs, int(self.least[k]))
            out.append((self.item_ids[k], int(self.begins[k + 1] - self.begins[k]), sum(n for _, _, n in made), sorted(made)))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded size, fetched one partition at a time."""
    block: list[tuple[int, bytes]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        data = (row[1] or "").encode()
        if block and held + len(data) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], data))
        held += len(data)
    if block:
        yield block


def _index(name: str, items: list[tuple[int, bytes]], width: int) -> Index:
    """The index of a block, kept for the life of the worker process; one at a time."""
    kept = sys.modules.setdefault("_logloom_benchmark", types.ModuleType("_logloom_benchmark"))
    if getattr(kept, "name", None) != name:
        kept.index = None
        kept.index, kept.name = Index(items, width), name
    return kept.index


def _with_index(docs: DataFrame, items: list[tuple[int, bytes]], width: int, made, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, fold = _index(name, sent.value, width), _fold()
        for batch in batches:
            for part in common.parts(batch, column=batch.num_columns - 1):
                yield made(part, index, fold)

    return docs.mapInArrow(mapped, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every pair of a document and an item that share a seed: doc_id, item_id, item_words, covered_words, coverage, n_tiles, tiles.

    tiles: "document word:item word:length" joined by blanks, by place in the document. Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased. Null and empty texts share nothing; an item shorter than ``min_match`` words has to occur
    whole; a text and an item of one word over and over share one run per place; repeated rows of either table each give their rows; null ids stay null; an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long, tiles string"

    def made(part: pa.RecordBatch, index: Index, fold: bytes) -> pa.RecordBatch:
        rows = []
        for doc, data in zip(part.column(0).to_pylist(), common.utf8(part.column(1)), strict=True):
            for item, n, covered, found in index.hits(data, fold):
                rows.append((doc, item, n, covered, covered / n, len(found), " ".join(f"{i}:{j}:{k}" for i, j, k in found)))
        kinds = [*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in _blocks(benchmark, block_bytes):
        one = _with_index(chosen, items, min_match, made, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` of which no benchmark item is covered to ``threshold`` or more, with their columns; rows without text stay."""
    names, schema = docs.columns, docs.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def made(part: pa.RecordBatch, index: Index, fold: bytes) -> pa.RecordBatch:
        keep = [all(covered < threshold * n for _, n, covered, _ in index.hits(data, fold)) for data in common.utf8(part.column(part.num_columns - 1))]
        return part.select(list(range(len(names)))).filter(pa.array(keep, pa.bool_()))

    out = docs
    for items in _blocks(benchmark, block_bytes):
        out = _with_index(out.withColumn("__ll_text", F.col("text").cast("string")), items, min_match, made, kinds)
    return out
