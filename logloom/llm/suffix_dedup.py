"""Removal of repeated byte strings, by distributed prefix doubling.

A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller id, or earlier in the same
one. As in the construction of a suffix array, Spark sorts pairs of ranks, those of a position and of one further on; positions whose
pair is unique drop out, and the others get ranks of longer prefixes, until the prefix is as long as the threshold.

``every_position`` does so for each byte position: pairs at offsets 8, 16, 32 and 36 rank prefixes of 16, 32, 64 and 100 bytes. That
shuffles many times the input (see the README), so ``remove_repeats`` ranks sampled positions first. Every window of ``length`` bytes
is represented by its anchor, the 32-byte string in it with the smallest hash (leftmost if tied); equal windows have equal anchors at
equal places. Consecutive windows share anchors, so that about 3 in 100 positions are sorted. Round 1 ranks anchors by their 32 bytes
and, next, by the whole context of the windows that they represent: rows with an earlier row of equal context are repeats. Round 2 takes
the first row of each context where an anchor has several, and sorts pairs of ranks of 64 bytes at offsets 19 to 21: the 83 to 85 bytes
that a quarter of its windows have in common. Round 3 sorts pairs of ranks of 64 bytes at offset 36, the windows themselves, where that
is not unique. Ranks of 32 and 64 bytes are made by doubling too: each from two of half the length. They are hashes, so that tasks agree
on them without another shuffle.

Scale: repeats within a part of a partition are resolved in the map and take no part in the sorts, so a passage that a third of all
documents share gives one row per part instead of one per document. A string that many documents share with different neighbours is
seen to be hot in the parts where it occurs ``HOT`` times: its rows go on to the next, longer prefix at once, spread over all tasks, and
one mark per part tells the rows of other parts to do so as well. No step forms pairs of positions; each reads a sorted stream and
looks at neighbours only. Text is shuffled once, to meet the few windows of round 2 and the removals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 32
#: Rows of one key in one part of a map from which on they go to the next round by themselves.
HOT = 4
#: Bytes that a map task hashes at once; it needs about 60 times as much memory.
PART_BYTES = 2 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = _RNG.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_LAST = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of lengths 32 and 64 of ``data``, each length from two of half of it. Shorter ones are not kept."""

    def __init__(self, data: np.ndarray):
        h = _BYTE[data]
        for level in range(6):
            size = 1 << level
            longer = h[: max(0, len(h) - size)] * _STEP[level]
            longer += h[size:]
            if size == GRAM:
                self.short = h
            h = longer
        self.long = h

    def ranges(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The hash of data[start : start + length] for lengths from 64 to 184: three overlapping pieces of 64 bytes cover it."""
        h = self.long
        length = np.asarray(length)
        end = start + length - 64
        middle = start + (length - 64) // 2
        out = _mixed(h[start] + np.uint64(0x9E3779B97F4A7C15) * length.astype(np.uint64))
        out = _mixed(out * np.uint64(3) + h[middle])
        return _mixed(out * np.uint64(5) + h[end])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: first window, last window, anchor, hash of its bytes, hash of the run's context.

    ``ends`` are the ends of the documents that ``data`` consists of; windows lie within one document.
    """
    n, spread = len(data), length - GRAM + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = Hashes(data)
    bits = np.uint64(max(24, n.bit_length()))
    gram = _mixed(hashes.short)
    key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= spread:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if spread > size:
        key = np.minimum(key[: size - spread], key[spread - size :])
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, dtype=np.int8)
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(at)], dtype=np.int8))
    if not len(window):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    anchor = at[window]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last, anchor = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1], anchor[new]
    context = hashes.ranges(first, last - first + length)
    return first, last, anchor, gram[anchor], _mixed(context + (anchor - first).astype(np.uint64))


def _pack(off: np.ndarray, n: np.ndarray, back: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One number of: first window, number of windows, anchor minus first window, whether it is known to be a repeat. Sorts by window."""
    return (off << 16) | (n << 8) | (back << 1) | known


def _merged(doc: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join runs of windows that follow each other in a document; the rows are sorted."""
    if not len(doc):
        return doc, off, n
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (off[1:] != off[:-1] + n[:-1])]))
    return doc[new], off[new], np.add.reduceat(n, new)


def _segments(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Lists of (doc, sub, offset, bytes) in order, each list of about PART_BYTES; a longer text is cut, with an overlap that leaves every
    window whole in one piece.
    """
    for part in common.parts(batch, PART_BYTES, column=2):
        made: list[tuple] = []
        rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part.column(2)), strict=True)
        for doc, sub, data in sorted(rows, key=lambda r: r[:2]):
            if len(data) <= PART_BYTES:
                made.append((doc, sub, 0, data))
            else:
                yield from ([(doc, sub, at, data[at : at + PART_BYTES + LENGTH - 1])] for at in range(0, len(data) - LENGTH + 1, PART_BYTES))
        yield made


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows: gram (spread anew for rows that are known to be repeats or hot), context, doc, sub, pack, n (negative if hot, 0 for a mark)."""
    for batch in batches:
        for rows in _segments(batch):
            data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
            sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
            doc, sub, base = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
            ends = np.cumsum(sizes)
            first, last, anchor, gram, context = anchors(data, ends)
            owner = np.searchsorted(ends, first, side="right")
            off = first - (ends - sizes - base)[owner] if len(first) else first
            ranked = np.lexsort((first, context, gram))
            again = np.zeros(len(first), dtype=bool)
            if len(first):
                again[ranked[1:]] = (gram[ranked[1:]] == gram[ranked[:-1]]) & (context[ranked[1:]] == context[ranked[:-1]])
            fresh = np.flatnonzero(~again)
            n = last - first + 1
            o2, f2, n2 = _merged(owner[again], off[again], n[again])
            # Hot grams: their rows are spread, and a row without windows marks the gram.
            grams, which, count = np.unique(gram[fresh], return_inverse=True, return_counts=True)
            hot = count[which] >= HOT
            marks = grams[count >= HOT].view(np.int64)
            fresh, hot = np.concatenate([fresh[~hot], fresh[hot]]), int(hot.sum())
            spread = lambda o, f: _mixed((doc[o].astype(np.uint64) << np.uint64(20)) ^ f.astype(np.uint64)).view(np.int64)
            zero = np.zeros(len(o2), dtype=np.int64)
            known = np.concatenate([np.zeros(len(fresh) - hot, dtype=np.int64), np.ones(hot, dtype=np.int64)])
            sizes_of = np.where(known == 1, -n[fresh], n[fresh])
            keys = gram[fresh].view(np.int64).copy()
            keys[known == 1] = spread(owner[fresh], off[fresh])[known == 1]
            none = np.zeros(len(marks), dtype=np.int64)
            out = [
                np.concatenate([keys, spread(o2, f2), marks]),
                np.concatenate([context[fresh].view(np.int64), zero, none]),
                np.concatenate([doc[owner[fresh]], doc[o2], none]),
                np.concatenate([sub[owner[fresh]], sub[o2], none]),
                np.concatenate([_pack(off[fresh], n[fresh], (anchor - first)[fresh], known), _pack(f2, zero, np.int64(0), np.int64(1)), none]),
                np.concatenate([sizes_of, n2, none]),
            ]
            kinds = [*[pa.int64()] * 5, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["gram", "context", "doc", "sub", "pack", "n"])


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, context, position: repeats, and the first rows of contexts whose gram has several contexts.

    Only neighbours are compared; the one row that has to wait for what follows is carried from batch to batch.
    """
    names = ["doc", "sub", "off", "n", "back", "gram", "repeat"]

    def made(rows: np.ndarray, repeat: np.ndarray | bool) -> pa.RecordBatch:
        flag = np.broadcast_to(np.asarray(repeat), rows.shape[1])[rows[5] != 0]
        gram, _, doc, sub, pack, n = rows[:, rows[5] != 0]
        out = [doc, sub, pack >> 16, np.abs(n), (pack >> 1) & 127, gram]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(flag)], names)

    waiting: np.ndarray | None = None  # the first row of its gram, while no other context has come
    before: np.ndarray | None = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
        known = (rows[4] & 1).astype(bool)
        if known.any():
            yield made(rows[:, known], rows[5, known] > 0)
            rows = rows[:, ~known]
        if not rows.shape[1]:
            continue
        joined = rows if before is None else np.concatenate([before, rows], axis=1)
        same_gram = joined[0][1:] == joined[0][:-1]
        same = same_gram & (joined[1][1:] == joined[1][:-1])
        if before is None:
            same_gram, same = (np.concatenate([[False], x]) for x in (same_gram, same))
        yield made(rows[:, same], True)
        heads = np.flatnonzero(~same)
        if len(heads):
            later = same_gram[heads]  # a head that is not the first of its gram: the gram has several contexts
            if waiting is not None:
                if later[0]:
                    yield made(waiting, False)
                waiting = None
            several = later.copy()
            several[:-1] |= later[1:]
            yield made(rows[:, heads[several]], False)
            if not later[-1]:
                waiting = rows[:, heads[-1] : heads[-1] + 1]
        before = rows[:, -1:]


#: Quarters of the places that an anchor may have in its window.
_QUARTERS = [(0, 17), (18, 35), (36, 52), (53, 68)]


_QUARTER_NAMES = {low: np.uint64((low + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for low, _ in _QUARTERS}


def _third_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document with its undecided rows: the pair of ranks of what a quarter of their windows share, and the bytes around.

    Rows of a pair that is hot in a batch are single windows already (n is 0) under their own pair, and a mark (n is -1) goes to theirs.
    """
    names = ["rank1", "rank2", "doc", "sub", "off", "n", "bytes"]
    kinds = [*[pa.int64()] * 6, pa.binary()]

    def pieces(data: bytes, packed: list[int]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """The document in pieces of bounded size: its bytes, where they begin, and the rows that lie in them."""
        rows = np.sort(np.array(packed, dtype=np.int64))
        off = rows >> 16
        at = 0
        while at < len(rows):
            base = int(off[at])
            end = int(np.searchsorted(off, base + PART_BYTES, side="right"))
            yield np.frombuffer(data[base : base + PART_BYTES + 3 * LENGTH], dtype=np.uint8), base, rows[at:end]
            at = end

    def made(columns: list[np.ndarray], data: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, data], kinds, strict=True)], names)

    for batch in batches:
        found: list[np.ndarray] = []
        around: list[bytes] = []
        for doc, sub, text, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for data, base, rows in pieces(text.encode(), packed):
                off, n, anchor = (rows >> 16) - base, (rows >> 8) & 255, (rows >> 16) - base + ((rows >> 1) & 127)
                long = Hashes(data).long
                raw = data.tobytes()
                for low, high in _QUARTERS:
                    begin, end = np.maximum(off, anchor - high), np.minimum(off + n - 1, anchor - low)
                    fits = begin <= end
                    begin, end, core = begin[fits], end[fits], anchor[fits] - low
                    size = LENGTH - (high - low)
                    found.append(np.stack([
                        _mixed(long[core] + _QUARTER_NAMES[low]).view(np.int64), long[core + size - 64].view(np.int64),
                        np.full(len(core), doc), np.full(len(core), sub), begin + base, end - begin + 1,
                    ]))
                    around += [raw[i : j + LENGTH] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        if not found:
            continue
        rows = np.concatenate(found, axis=1)
        pairs, which, count = np.unique(rows[:2], axis=1, return_inverse=True, return_counts=True)
        hot = count[which.reshape(-1)] >= HOT
        yield made(list(rows[:, ~hot]), [x for x, h in zip(around, hot.tolist(), strict=True) if not h])
        if hot.any():
            marks = pairs[:, count >= HOT]
            zero = np.zeros(marks.shape[1], dtype=np.int64)
            yield made([*marks, zero, zero, zero, zero - 1], [None] * len(zero))
            one, two, owner, at = _windows([x for x, h in zip(around, hot.tolist(), strict=True) if h])
            own = rows[:, hot]
            yield made([one, two, own[2][owner], own[3][owner], own[4][owner] + at, np.zeros(len(one), dtype=np.int64)], [None] * len(one))


def _windows(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """The pair of ranks of each window of each of ``data``, whose it is, and its place there."""
    sizes = np.array([len(x) for x in data], dtype=np.int64)
    long = Hashes(np.frombuffer(b"".join(data), dtype=np.uint8)).long
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(data)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = (np.cumsum(sizes) - sizes)[owner] + at
    return long[place].view(np.int64), long[place + LENGTH - 64].view(np.int64), owner, at


def _fourth_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by their pair, marks first, and by position: runs of windows that equal an earlier one of the same batch, and
    single windows that windows of other batches may equal: w1, w2, doc, sub, off, n, repeat.

    Equal windows have equal pairs of round 2 and so meet here; only a pair that goes on in another batch, or is marked, leaves its
    windows' first places open.
    """
    names = ["w1", "w2", "doc", "sub", "off", "n", "repeat"]
    before: tuple | None = None
    marked: tuple | None = None

    def made(columns: list[np.ndarray], repeat: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(len(columns[0]), repeat))], names)

    batches = (b for b in batches if b.num_rows)
    batch = next(batches, None)
    while batch is not None:
        after = next(batches, None)
        r1, r2, doc, sub, off, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        change = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
        begin = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        open_ = np.minimum.reduceat(n, begin) <= 0
        open_[0] |= (r1[0], r2[0]) in (before, marked)
        before = (r1[-1], r2[-1])
        if after is not None:
            open_[-1] |= before == (after.column(0)[0].as_py(), after.column(1)[0].as_py())
        # A group of which this batch has one row only, and which is not open, is unique.
        several = (np.diff(np.append(begin, len(r1))) > 1) | open_
        rows = np.flatnonzero(several[group] & (n > 0))
        parts = []
        if len(rows):
            w1, w2, owner, at = _windows([batch.column(6)[int(i)].as_py() for i in rows])
            owner = rows[owner]
            parts.append((w1, w2, owner, off[owner] + at))
        single = np.flatnonzero(n == 0)
        parts.append((r1[single], r2[single], single, off[single]))
        w1, w2, owner, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Within a group rows stand in the order of their positions; between groups only round 5 knows.
        where = group[owner]
        order = np.lexsort((np.arange(len(w1)), w2, w1, where))
        again = np.zeros(len(w1), dtype=bool)
        again[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]]) & (where[order[1:]] == where[order[:-1]])
        d, p, k = _merged_windows(owner[again], place[again])
        zero = np.zeros(len(d), dtype=np.int64)
        yield made([zero, zero, doc[d], sub[d], p, k], True)
        first = ~again & open_[where]
        yield made([w1[first], w2[first], doc[owner[first]], sub[owner[first]], place[first], np.ones(int(first.sum()), dtype=np.int64)], False)
        marked = before if open_[-1] and (n[begin[-1] :] == -1).any() else marked
        batch = after


def _merged_windows(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow each other in a row: its number, the first window and how many."""
    if not len(owner):
        return owner, place, place
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
    return owner[new], place[new], np.diff(np.append(new, len(owner)))


def _fifth_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by rank and position: all but the first of each rank."""
    before: np.ndarray | None = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        if not rows.shape[1]:
            continue
        joined = rows if before is None else np.concatenate([before, rows], axis=1)
        same = (joined[0][1:] == joined[0][:-1]) & (joined[1][1:] == joined[1][:-1])
        again = rows[:, np.concatenate([[False], same]) if before is None else same]
        before = rows[:, -1:]
        doc, sub, off = again[2], again[3], again[4]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sub), pa.array(off), pa.array(np.ones(len(doc), dtype=np.int64))], ["doc", "sub", "off", "n"])


def _removals(keep_bytes: bool, length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, column=1):
                rows = []
                for doc, data, offs, ns in zip(part.column(0).to_pylist(), common.utf8(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    kept, at, removed, spans, end = [], 0, 0, 0, -1
                    for begin, stop in sorted((o, o + n - 1 + length) for o, n in zip(offs or (), ns or (), strict=True)):
                        if begin > end:
                            kept.append(data[at:begin])
                            spans += 1
                            removed += stop - begin
                        elif stop > end:
                            removed += stop - end
                        end = at = max(end, stop)
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    rows.append((doc, len(data), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if keep_bytes else [])))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return made


def _numbered(docs: DataFrame) -> DataFrame:
    """doc, sub (0, or the number of the text among those of one id) and text."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if base.groupBy("doc").count().where("count > 1").isEmpty():
        return base.select("doc", F.lit(0).cast("long").alias("sub"), "text")
    order = Window.partitionBy("doc").orderBy("text")
    return common.stored(base.select("doc", (F.row_number().over(order) - 1).cast("long").alias("sub"), "text"))


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for every row of ``docs`` (doc_id, text).

    Null texts count as empty; texts shorter than the threshold lose nothing; an empty table gives no rows. Where doc_ids repeat, the
    rows of one id follow each other in the order of their texts, and a null doc_id comes after all others; each row gets its row.
    """
    base = _numbered(docs)
    rows = base.mapInArrow(_first_round, "gram long, context long, doc long, sub long, pack long, n int")
    ranked = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc", "sub", "pack")
    found = common.stored(ranked.mapInArrow(_second_round, "doc long, sub long, off long, n long, back long, gram long, repeat boolean"))

    undecided = found.where("not repeat").select("doc", "sub", F.expr("shiftleft(off, 16) | shiftleft(n, 8) | shiftleft(back, 1)").alias("pack"))
    by_doc = undecided.groupBy("doc", "sub").agg(F.collect_list("pack").alias("packed"))  # as many as the document has windows, at most
    pairs = base.join(by_doc, ["doc", "sub"]).select("doc", "sub", "text", "packed").mapInArrow(_third_round, "rank1 long, rank2 long, doc long, sub long, off long, n long, bytes binary")
    met = pairs.repartition("rank1").sortWithinPartitions("rank1", "rank2", F.col("n") >= 0, "doc", "sub", "off")
    decided = common.stored(met.mapInArrow(_fourth_round, "w1 long, w2 long, doc long, sub long, off long, n long, repeat boolean"))
    left = decided.where("not repeat").select("w1", "w2", "doc", "sub", "off")
    again = left.repartition("w1").sortWithinPartitions("w1", "w2", "doc", "sub", "off").mapInArrow(_fifth_round, "doc long, sub long, off long, n long")
    repeats = found.where("repeat").unionByName(decided.where("repeat"), allowMissingColumns=True).select("doc", "sub", "off", "n").unionByName(again)
    return _without(base, repeats, keep_bytes)


def _without(base: DataFrame, repeats: DataFrame, keep_bytes: bool) -> DataFrame:
    """``base`` (doc, sub, text) less the bytes that ``repeats`` (doc, sub, off, n: windows in a row) cover."""
    lists = repeats.groupBy("doc", "sub").agg(F.collect_list("off").alias("offs"), F.collect_list("n").alias("ns"))
    joined = base.join(lists, ["doc", "sub"], "left").select(F.nullif(F.col("doc"), F.lit(_LAST)).alias("doc_id"), "text", "offs", "ns")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return joined.mapInArrow(_removals(keep_bytes, LENGTH), schema)


def every_position(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """What ``remove_repeats`` returns, by doubling the prefixes of every byte position; for comparison, as it shuffles many times the input.

    Each round sorts the positions by their pair of ranks, drops those whose pair is unique, numbers the others' pairs, and brings the
    numbers back to their documents, where they pair up at the next offset. A position whose partner has dropped out is unique as well.
    """
    base = _numbered(docs)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, PART_BYTES, column=2):
                for doc, sub, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part.column(2)), strict=True):
                    n = max(0, len(text) - 15)
                    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, dtype=np.uint8), 8).copy().view(">i8").reshape(-1).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (eight[:n], eight[8 : 8 + n], np.full(n, doc), np.full(n, sub), np.arange(n))], ["a", "b", "doc", "sub", "off"])

    def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
        """Rows in blocks of whole groups of equal keys (the first columns), or pieces of one long group."""
        held: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            if held.shape[1]:
                other = np.flatnonzero((held[:keys] != held[:keys, -1:]).any(axis=0))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield held[:, :cut]
                held = held[:, cut:]
        if held is not None and held.shape[1]:
            yield held

    def ranked(last: bool):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 40
            for rows in runs(batches, 2):
                new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
                group = np.cumsum(new) - 1
                kept = ~new if last else np.bincount(group)[group] > 1
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (number + group, *rows[2:])], ["rank", "doc", "sub", "off"])
                number += int(group[-1]) + 1

        return made

    def paired(step: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc, sub, off, rank in runs(batches, 2):
                key = (np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])) << 40) + off
                at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
                there = key[at] == key + step
                yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (rank, rank[at], doc, sub, off)], ["a", "b", "doc", "sub", "off"])

        return made

    pairs = base.mapInArrow(raw, "a long, b long, doc long, sub long, off long")
    for step in (16, 32, LENGTH - 64, 0):
        met = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "doc", "sub", "off")
        ranks = met.mapInArrow(ranked(not step), "rank long, doc long, sub long, off long")
        if step:
            back = ranks.repartition("doc", "sub").sortWithinPartitions("doc", "sub", "off").select("doc", "sub", "off", "rank")
            pairs = back.mapInArrow(paired(step), "a long, b long, doc long, sub long, off long")
    return _without(base, ranks.select("doc", "sub", "off", F.lit(1).cast("long").alias("n")), keep_bytes)
