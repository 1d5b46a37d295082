"""Vector bin packing of token sequences by the dot-product heuristic.

Every example is a vector (tokens, one segment, loss-bearing tokens) and every sequence has a limit for each of the three. The open
sequence takes, again and again, the fitting example whose vector has the largest dot product with what is left of the limits, so
that examples go where their scarce resource is still plentiful.

Scale: the work is a single map over the input partitions. A partition keeps one pool of at most ``pool`` examples and one open
sequence, so memory is bounded and no shuffle, sort or driver step is needed; a partition that is computed again after the loss of an
executor gives the same rows, because it reads the same rows in the same order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment long"


class DotPacker:
    """Packs (key, tokens, loss mask sums) vectors into sequences; see the module's docstring.

    limits: most tokens, segments and loss-bearing tokens of a sequence. cut: whether an example may be cut anywhere. ``add`` and
    ``finish`` yield closed sequences as lists of (key, start, length). With ``cut``, every sequence but those that the segment or
    loss limit closes early is full, and the last one is cut into lengths that are powers of two, which need no padding.
    loss(key, start, length) gives the loss-bearing tokens of a piece.
    """

    def __init__(self, limits: tuple[int, int, int], loss, cut: bool = True, pool: int = 1024):
        self.limits, self.loss, self.cut, self.pool = limits, loss, cut, pool
        self.scale = np.array([1 / x for x in limits])
        self.need = np.zeros((2 * pool, 3))
        self.items: list[tuple] = []
        self.open: list[tuple] = []
        self.left = np.array(limits, dtype=float)

    def add(self, key, n: int) -> Iterator[list[tuple]]:
        """Take one example of ``n`` tokens."""
        start, most = 0, self.limits[0]
        while n - start >= most if self.cut else False:
            length = self._fitting(key, start, most, self.limits[2])
            yield [(key, start, length)]
            start += length
        if start < n:
            if not self.cut and (n > most or self.loss(key, 0, n) > self.limits[2]):
                raise ValueError(f"an example of {n} tokens exceeds the limits {self.limits}")
            self._put(key, start, n)
        while len(self.items) >= self.pool:
            yield from self._step()

    def finish(self) -> Iterator[list[tuple]]:
        """Pack what is still in the pool."""
        while self.items:
            yield from self._step()
        if not self.open:
            return
        if not self.cut:
            yield self._close()
            return
        rest = self._close()
        total = sum(x[2] for x in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            taken: list[tuple] = []
            while size:
                key, start, length = rest[0]
                used = min(size, length)
                taken.append((key, start, used))
                size -= used
                if used < length:
                    rest[0] = (key, start + used, length - used)
                else:
                    rest.pop(0)
            yield taken

    def _put(self, key, start: int, n: int) -> None:
        i = len(self.items)
        self.items.append((key, start, n))
        self.need[i] = (n - start, 1, self.loss(key, start, n - start))

    def _drop(self, i: int) -> None:
        last = len(self.items) - 1
        self.items[i], self.need[i] = self.items[last], self.need[last]
        self.items.pop()

    def _fitting(self, key, start: int, length: int, loss_left: float) -> int:
        """The longest head of at most ``length`` tokens whose loss-bearing tokens fit."""
        if self.loss(key, start, length) <= loss_left:
            return length
        low, high = 0, length
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.loss(key, start, middle) <= loss_left else (low, middle - 1)
        return max(low, 1)

    def _close(self) -> list[tuple]:
        done, self.open, self.left = self.open, [], np.array(self.limits, dtype=float)
        return done

    def _step(self) -> Iterator[list[tuple]]:
        """Place one example, or a head of one, into the open sequence."""
        need = self.need[: len(self.items)]
        score = need @ (self.left * self.scale * self.scale)
        fits = (need <= self.left).all(axis=1)
        if self.cut and self.left[1] == 1 and self.left[0] > 0:
            fits &= need[:, 0] == self.left[0]  # the last segment has to fill the sequence
        if fits.any():
            i = int(np.argmax(np.where(fits, score, -1)))
            key, start, n = self.items[i]
            self.open.append((key, start, n - start))
            self.left -= need[i]
            self._drop(i)
        elif self.cut and self.left[1] >= 1 and self.left[2] >= 1:
            i = int(np.argmax(np.where(need[:, 0] >= self.left[0], score + 10, score)))
            key, start, n = self.items[i]
            length = self._fitting(key, start, int(min(self.left[0], n - start)), self.left[2])
            loss = self.loss(key, start, length)
            self.open.append((key, start, length))
            self.left -= (length, 1, loss)
            if start + length < n:
                self.items[i] = (key, start + length, n)
                self.need[i] = (n - start - length, 1, self.loss(key, start + length, n - start - length))
            else:
                self._drop(i)
        else:
            self.left[0] = 0
        if self.left[0] <= 0 or self.left[1] <= 0 or self.left[2] <= 0:
            yield self._close()


def _encoder(lines: bytes, pattern: str):
    """The byte-level BPE of the ranks file, kept for the life of the worker process."""
    import sys
    import types

    kept = sys.modules.setdefault("_logloom_worker", types.ModuleType("_logloom_worker"))
    if not hasattr(kept, "encoder"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        kept.encoder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept.encoder


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    max_tokens: int = 1024,
    max_segments: int = 256,
    max_loss: int | None = None,
    end_id: int = 0,
    pool: int = 1024,
) -> DataFrame:
    """Pack the tokens of ``docs`` (doc_id, text), each followed by ``end_id``, into sequences of ``max_tokens``.

    Documents are cut freely and every token lies in exactly one piece. Loss-bearing are all tokens but the first of a document,
    which nothing precedes. One row per piece: its document's ids before it, its length, the CRC-32 of its little-endian 32-bit ids,
    the document's tokens, the sequence, its place there, its loss-bearing tokens and its number there.

    Null text counts as empty and so has the single token ``end_id``; a null doc_id stays null; repeated rows are packed each for
    itself; an empty table gives no rows; other columns are ignored. ranks_path is the vocabulary in ranks form, which gives the
    same ids as its JSON form (tests compare them); names of special tokens in a text are ordinary text. The driver reads that file, which is small and does not grow with the data.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()
    limits = (max_tokens, max_segments, max_loss or max_tokens)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines, pattern)
        base = TaskContext.get().partitionId() << 33
        packer = DotPacker(limits, lambda key, start, length: length - (start == 0), True, pool)
        rows: list[tuple] = []
        count = 0

        def closed(sequences):
            nonlocal count
            for pieces in sequences:
                at = 0
                for k, ((doc, ids, n), start, length) in enumerate(pieces):
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, base + count, at, length - (start == 0), k))
                    at += length
                count += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "segment"]
            result = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            rows.clear()
            return result

        for batch in batches:
            for part in common.parts(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encoder.encode_ordinary(text or ""), end_id], dtype="<u4")
                    closed(packer.add((doc, ids, len(ids)), len(ids)))
                if len(rows) >= 8192:
                    yield out()
        closed(packer.finish())
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, PIECES)


def pack_examples(
    examples: DataFrame,
    *,
    max_tokens: int,
    max_segments: int,
    max_loss: int,
    pool: int = 1024,
) -> DataFrame:
    """Pack whole instruction examples (example_id, tokens, loss_tokens) under three limits at once, without cutting.

    Returns example_id, tokens, loss_tokens, sequence_id and offset. An example that exceeds a limit by itself, or has a null in tokens, gets a null
    sequence_id and offset instead of a place; null loss_tokens count as zero.
    """
    limits = (max_tokens, max_segments, max_loss)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer = DotPacker(limits, lambda key, start, length: key[1], False, pool)
        rows: list[tuple] = []
        count = 0

        def closed(sequences):
            nonlocal count
            for pieces in sequences:
                at = 0
                for (example, loss), _, length in pieces:
                    rows.append((example, length, loss, base + count, at))
                    at += length
                count += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"])

        for batch in batches:
            for example, n, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if n is None or n < 1 or n > max_tokens or (loss or 0) > max_loss:
                    rows.append((example, n, loss or 0, None, None))
                else:
                    closed(packer.add((example, loss or 0), n))
            yield out()
        closed(packer.finish())
        yield out()

    chosen = examples.select(*(F.col(c).cast("long") for c in ("example_id", "tokens", "loss_tokens")))
    return chosen.mapInArrow(packed, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")


def conversation_examples(conversations: DataFrame, ranks_path: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """example_id, tokens and loss_tokens of each conversation of ``conversations`` (conv_id, role, text).

    A turn has the tokens of its text and one that ends it; those of ``loss_role`` bear loss. Null text counts as empty, a null role
    bears no loss, and rows with a null conv_id are one conversation. Turns are tokenized in a map; only their numbers are shuffled.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines, pattern)
        for batch in batches:
            for part in common.parts(batch, column=2):
                sizes = [len(encoder.encode_ordinary(x or "")) + 1 for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64())], ["conv_id", "role", "tokens"])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "conv_id long, role string, tokens long")
    loss = F.coalesce(F.sum(F.when(F.col("role") == loss_role, F.col("tokens"))), F.lit(0))
    return turns.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("tokens").alias("tokens"), loss.alias("loss_tokens"))
