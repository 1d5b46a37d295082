"""SimHash near-duplicates, compared in bit-sliced form.

Every text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes of the text's word shingles. Two fingerprints
link if at most ``radius`` bits differ. The fingerprint is cut into blocks such that any linked pair agrees on some fixed number of
them; each combination of that many blocks is a table, and only fingerprints that agree on a combination's bits are compared.

The comparison is vertical: the differences of up to 16,384 pairs are stored as 64 bit planes, carry-save counters add plane after
plane for all pairs at once, and a block is abandoned as soon as every pair in it exceeds the radius.

Scale: equal fingerprints collapse before anything is compared, by a partial aggregation. What is shuffled is fingerprints of 8 bytes,
never text. Buckets beyond ``hot_bucket`` fingerprints are split by finer keys on the bits that are left, which loses no pair. Of the
links in a bucket only a spanning forest leaves the task, which keeps every component. Components come from alternating star steps
(joins and minimum aggregations, no group is collected), with the lineage cut after every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Ids with a few numbers each go to all executors up to so many rows (about 24 bytes each), and are joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Pairs that are compared at once.
BLOCK = 16_384
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(words: list[bytes], width: int) -> int:
    """The SimHash of a word sequence; zero if there are no words."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return _majority(np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[begin : begin + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each word; all that is known of a text's words and shingles comes from these."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def set_fingerprint(words: list[bytes]) -> int:
    """The SimHash of the distinct words, which stays close where few words change."""
    return _majority(_distinct(word_hashes(words)))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of the text's distinct shingles in ascending order; a shorter text is one shingle."""
    return _shingles(word_hashes(words), width)


def _shingles(w: np.ndarray, width: int) -> np.ndarray:
    """The same from the hashes of the words, which are chained for all shingles at once."""
    n = max(1, len(w) - width + 1)
    h = np.full(n, SEED + 1, dtype=np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return _distinct(h)


def set_key(h: np.ndarray) -> int:
    """The name of a set of shingles: 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def sketch(words: list[bytes], width: int) -> bytes:
    """256 one-bit minimum hashes of the text's shingles: the share of differing bits estimates half of one minus their similarity.

    One hash per shingle; its high byte says which of 256 minima it takes part in, and an empty one borrows from the next that is not.
    """
    return _sketch(shingles(words, width))


def _sketch(h: np.ndarray) -> bytes:
    bins = (h >> np.uint64(56)).astype(np.int64)
    at = np.searchsorted(bins, np.arange(256)) % len(bins)
    away = ((bins[at] - np.arange(256)) % 256).astype(np.uint64)
    value = h[at] + away * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((value >> np.uint64(40)).astype(np.uint8) & 1).tobytes()


def with_sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, __ll_fp (of the distinct words), and __ll_sk (sketch), __ll_set (name) and __ll_n (number) of the shingles of each row of ``docs`` (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch):
                fps, sketches, keys, sizes = [], [], [], []
                for x in common.utf8(part.column(1)):
                    w = word_hashes(x.translate(_LOWER).split())
                    h = _shingles(w, width)
                    fps.append(_majority(_distinct(w)))
                    sketches.append(_sketch(h))
                    keys.append(set_key(h))
                    sizes.append(len(h))
                signed = np.array(fps, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed), pa.array(sketches, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "__ll_fp", "__ll_sk", "__ll_set", "__ll_n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, __ll_fp long, __ll_sk binary, __ll_set long, __ll_n long")


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``docs``, of which the last column is the text, with that column replaced by __ll_fp (bigint, the same bits)."""
    kept = docs.schema[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__ll_fp long"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for part in common.parts(batch, column=at):
                fps = np.array([fingerprint(x.translate(_LOWER).split(), width) for x in common.utf8(part.column(at))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(fps)], [*(f.name for f in kept), "__ll_fp"])

    return docs.mapInArrow(made, schema)


def planes(differences: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit words: row b holds bit b of every word, packed.

    Eight words are eight 8 x 8 bit matrices, each in one word, which are transposed by three rounds of swaps.
    """
    groups = -(-len(differences) // 8)
    words = np.zeros((groups, 8), dtype="<u8")
    words.reshape(-1)[: len(differences)] = differences
    x = np.ascontiguousarray(words.view(np.uint8).reshape(groups, 8, 8).transpose(2, 0, 1)).view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swap = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ swap ^ (swap << np.uint64(shift))
    return np.ascontiguousarray(x.view(np.uint8).reshape(8, groups, 8).transpose(0, 2, 1)).reshape(64, groups)


def within(differences: np.ndarray, radius: int) -> np.ndarray:
    """Which words have at most ``radius`` bits, by carry-save counting of their bit planes."""
    vertical = planes(differences)
    depth = (radius + 1).bit_length()
    counter = [np.zeros(vertical.shape[1], dtype=np.uint8) for _ in range(depth)]
    over = np.zeros(vertical.shape[1], dtype=np.uint8)
    for b in range(64):
        carry = vertical[b]
        for level in range(depth):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        over |= carry
        if b % 8 == 7:
            beyond = over | _above(counter, radius)
            if (beyond == 255).all():
                return np.zeros(len(differences), dtype=bool)
    beyond = over | _above(counter, radius)
    return np.unpackbits(~beyond, bitorder="little")[: len(differences)].astype(bool)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counter exceeds ``radius``: a bit-sliced comparison from the highest bit."""
    more = np.zeros_like(counter[0])
    same = np.full_like(counter[0], 255)
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            same = same & counter[level]
        else:
            more |= same & counter[level]
            same = same & ~counter[level]
    return more


class _Forest:
    """Union-find over positions; ``join`` says whether the two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while self.up.get(x, x) != x:
            path.append(x)
            x = self.up[x]
        for y in path:
            self.up[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """Spanning links among rows of equal key, rows being sorted by key: row i against row i + lag, all lags, in blocks.

    A block is filled from as many lags as it takes: where one bucket is larger than the others, a lag has few pairs.
    sketches: rows of four words; if given, a link also needs at most ``most`` differing bits there.
    """
    links, forest = [], _Forest()
    at = np.arange(len(keys))
    last = np.searchsorted(keys, keys, side="right")
    lag, waiting, held = 1, [], 0
    while True:
        at = at[at + lag < last[at]]
        if len(at):
            waiting.append((at, at + lag))
            held += len(at)
        if held >= BLOCK or held and not len(at):
            left, right = map(np.concatenate, zip(*waiting, strict=True))
            whole = held - held % BLOCK if len(at) else held
            waiting, held = [(left[whole:], right[whole:])], held - whole
            for begin in range(0, whole, BLOCK):
                a, b = (x[begin : min(begin + BLOCK, whole)] for x in (left, right))
                near = np.flatnonzero(within(fps[a] ^ fps[b], radius))
                if sketches is not None and len(near):
                    near = near[np.bitwise_count(sketches[a[near]] ^ sketches[b[near]]).sum(axis=1) <= most]
                links += [x for x in zip(a[near].tolist(), b[near].tolist(), strict=True) if forest.join(*x)]
        if not len(at):
            return links
        lag += 1


def tables(radius: int) -> list[list[tuple[int, int]]]:
    """For each table, the (shift, bits) of its key; any two fingerprints within ``radius`` agree on one key at least."""
    blocks, agreed = {0: (1, 1), 1: (3, 2), 2: (4, 2), 3: (5, 2), 4: (6, 2), 5: (7, 2), 6: (8, 2)}.get(radius, (radius + 2, 2))
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [list(x) for x in combinations(parts, agreed)]


def _bits(fp: Column, parts: list[tuple[int, int]]) -> Column:
    out = F.lit(0).cast("long")
    for shift, bits in parts:
        piece = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        out = piece if len(parts) == 1 else F.shiftleft(out, bits).bitwiseOR(piece)
    return out


def _fine_parts(parts: list[tuple[int, int]], radius: int) -> list[list[tuple[int, int]]]:
    """Finer keys of a table: the bits that it leaves free, cut into radius + 1 pieces of which one agrees."""
    free = [b for b in range(64) if not any(s <= b < s + n for s, n in parts)]
    cuts = [free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
    out = []
    for cut in cuts:
        runs: list[tuple[int, int]] = []
        for b in cut:
            if runs and sum(runs[-1]) == b:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((b, 1))
        out.append(runs)
    return [x for x in out if x]


def links(nodes: DataFrame, radius: int, hot_bucket: int = 2048, most: int | None = None) -> DataFrame:
    """(a, b): linked nodes among ``nodes`` (rep, __ll_fp, and __ll_sk if ``most`` is given); a spanning forest of each bucket's links."""
    all_tables = tables(radius)
    extra = [] if most is None else [F.col("__ll_sk").alias("sk")]
    names = ["rep", "fp", *(["sk"] if extra else [])]
    keyed = nodes.select(
        "rep",
        F.col("__ll_fp").alias("fp"),
        *extra,
        F.posexplode(F.array(*(_bits(F.col("__ll_fp"), parts) for parts in all_tables))).alias("t", "key"),
    )
    counts = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(counts, ["t", "key"])
    fine = F.lit(None).cast("array<struct<t:int,key:bigint>>")
    for t, parts in enumerate(all_tables):
        cuts = F.array(*(F.struct(F.lit(1000 + t * 100 + i).alias("t"), F.xxhash64("key", _bits(F.col("fp"), cut)).alias("key")) for i, cut in enumerate(_fine_parts(parts, radius))))
        fine = F.when(F.col("t") == t, cuts).otherwise(fine)
    whole = F.array(F.struct(F.col("t"), F.col("key")))
    dealt = sized.select(*names, F.explode(F.when(F.col("n") > hot_bucket, fine).otherwise(whole)).alias("k")).select("k.t", "k.key", *names)
    sorted_rows = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def run(rows: pa.Table) -> pa.RecordBatch:
            t, key, rep, fp = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
            change = np.concatenate([[0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]))]) if len(t) else t
            sk = None if most is None else np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype=np.uint64).reshape(-1, 4)
            found = bucket_links(change, fp.view(np.uint64), radius, sk, most or 0)
            a, b = (rep[[x[i] for x in found]] if found else rep[:0] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # What belongs to the last bucket waits for its other rows.
            t, key = (rows.column(i).to_numpy() for i in (0, 1))
            other = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield run(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield run(held)

    return sorted_rows.mapInArrow(compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes; each is a minimum by node and a join, which adaptive execution can
    split where a node has many neighbours. The number of rounds grows with the logarithm of the longest path.
    """
    both = edges.where("a is not null and b is not null and a != b").distinct()
    now = common.stored(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.isEmpty():
        return now.toDF("node", "component")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        wide = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = wide.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = wide.join(least, "u")
        moved = joined.where("v > u" if large else "v <= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    before = None
    while True:
        last = now
        now = common.stored(star(star(last, True), False))
        common.discard(last)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def classes(prints: DataFrame, radius: int, hot_bucket: int = 2048, most: int | None = None) -> DataFrame:
    """(__ll_fp[, __ll_sk], component_id) for each distinct print of ``prints`` (doc_id, ...): the smallest doc_id reachable from it.

    A print that only rows with a null doc_id have is no node: its component is null, and it links nothing. Rows of one doc_id count as
    one document, which links all of its prints.
    """
    keys = ["__ll_fp"] if most is None else ["__ll_fp", "__ll_sk"]
    nodes = common.stored(prints.groupBy(*keys).agg(F.min("doc_id").alias("rep")))
    edges = common.stored(links(nodes.where("rep is not null"), radius, hot_bucket, most))
    joined = nodes.join(components(edges), F.col("rep") == F.col("node"), "left")
    return joined.select(*keys, F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 2, hot_bucket: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text).

    Null text counts as empty; texts without words have fingerprint zero, which links like any other; shorter texts than a shingle are
    one shingle; repeated rows each get their row; an empty table gives no rows.
    """
    prints = common.stored(with_fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("__ll_text")), width))
    joined = prints.join(classes(prints, radius, hot_bucket), "__ll_fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("__ll_fp")), 16, "0").alias("fingerprint"), "component_id")


def _last_shingles(docs: DataFrame, width: int, share: int = 16, least: int = 8, most: int = 100_000) -> np.ndarray:
    """Shingles that many documents hold, the most frequent last, counted in one of ``share`` documents.

    They only end the order in which a document's shingles are looked at; whatever they are, no pair is lost.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch):
                tokens = [shingles(x.translate(_LOWER).split(), width) for x in common.utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64))], ["token"])

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    counts = some.mapInArrow(made, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "token").limit(most).collect()
    return np.array([r.token for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def _need(a, b, similarity: float):
    """How many shingles sets of ``a`` and ``b`` must share at least to be similar."""
    return similarity / (1 + similarity) * (a + b) - 1e-6


def _most_bits(n, similarity: float):
    """How many of 256 sketch bits may differ between similar sets, the smaller of ``n`` shingles: eight standard deviations above the mean."""
    share = (1 - similarity) / 2
    return 256 * share + 8 * np.sqrt(256 * share * (1 - share) * (1 + 256 / n))


def shared_prefixes(docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """(token, at, n, node): shingles in the prefixes of two or more of ``nodes`` (rep, __ll_set, component) of different components.

    Prefix filter: in a common order of all shingles, similar sets share one of the first n - similarity * n + 1 of each, and the first
    that they share leaves enough behind it in both. Frequent shingles come last in that order.
    """
    last = docs.sparkSession.sparkContext.broadcast(_last_shingles(docs, width))
    texts = with_ids(docs, nodes.select(F.col("rep").alias("doc_id"), "__ll_set", "component")).select("doc_id", "text", "__ll_set", "component")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = last.value
        order = np.argsort(frequent)
        known = frequent[order]
        for batch in batches:
            for part in common.parts(batch):
                out: list[tuple] = []
                for node, key, component, x in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), common.utf8(part.column(1)), strict=True):
                    h = shingles(x.translate(_LOWER).split(), width)
                    if set_key(h) != key:
                        continue
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        often = known[at] == h
                        if often.any():
                            h = np.concatenate([h[~often], h[often][np.argsort(order[at[often]])]])
                    n = len(h)
                    p = n - int(np.ceil(similarity * n - 1e-6)) + 1
                    out.append((h[:p].view(np.int64), np.arange(p), np.full(p, n), np.full(p, node), np.full(p, component)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["token", "at", "n", "node", "component"])

    def mixed(rows: pa.Table) -> list[pa.RecordBatch]:
        token, component = rows.column(0).to_numpy(), rows.column(4).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        several = np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)
        kept = np.repeat(several, np.diff(np.append(begin, len(token))))
        return rows.select(range(4)).filter(pa.array(kept)).combine_chunks().to_batches()

    rows = texts.mapInArrow(prefixes, "token long, at long, n long, node long, component long")
    dealt = rows.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(lambda batches: (x for rows in _whole_groups(batches) for x in mixed(rows)), "token long, at long, n long, node long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column: what belongs to the last one waits for its other rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != token[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def candidates(shared: DataFrame, nodes: DataFrame, similarity: float, spanning: bool) -> DataFrame:
    """(a, b): pairs of ``nodes`` (rep, component, __ll_sk) of two components that share a prefix token and whose sketches allow for similarity.

    spanning: of the pairs that one token gives, closest sketches first, only as many as it takes to connect what they connect.
    """
    state = nodes.select(F.col("rep").alias("node"), "component", "__ll_sk")
    joined = shared.join(F.broadcast(state) if 8 * state.count() <= BROADCAST_ROWS else state, "node").select("token", "at", "n", "node", "component", "__ll_sk")
    dealt = joined.repartition("token").sortWithinPartitions("token", "n", "node")

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        token, at, n, node, component = (rows.column(i).to_numpy() for i in range(5))
        sketches = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype=np.uint64).reshape(-1, 4)
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(begin, len(token)))
        end = np.repeat(begin + size, size)
        # Rows of one component in one group start out connected.
        label = np.unique(np.stack([end, component], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        several = np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)
        found = [np.zeros((0, 2), dtype=np.int64)]
        for most in (256 * (1 - similarity) / 2, None) if spanning else (None,):
            row, lag = np.flatnonzero(np.repeat(several, size)), 1
            while len(row):
                row = row[row + lag < end[row]]
                row = row[n[row] >= similarity * n[row + lag] - 1e-6]
                one = row[label[row] != label[row + lag]]
                other = one + lag
                fits = np.minimum(n[one] - at[one], n[other] - at[other]) >= _need(n[one], n[other], similarity)
                one, other = one[fits], other[fits]
                differ = np.bitwise_count(sketches[one] ^ sketches[other]).sum(axis=1)
                near = differ <= (_most_bits(np.minimum(n[one], n[other]), similarity) if most is None else most)
                one, other = one[near], other[near]
                if spanning and len(one):
                    up = np.arange(label.max() + 1)
                    chosen = []
                    for k, (x, y) in enumerate(zip(label[one].tolist(), label[other].tolist(), strict=True)):
                        while up[x] != x:
                            x = up[x]
                        while up[y] != y:
                            y = up[y]
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            chosen.append(k)
                    while (up[up] != up).any():
                        up = up[up]
                    label, one, other = up[label], one[chosen], other[chosen]
                if len(one):
                    found.append(np.sort(node[np.stack([one, other], axis=1)], axis=1))
                lag += 1
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.mapInArrow(lambda batches: map(pairs, _whole_groups(batches)), "a long, b long").distinct()


def _short(h: np.ndarray) -> bytes:
    """40 bits of each shingle hash, which are enough to compare two texts."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float, together: int = 256) -> DataFrame:
    """Those of ``pairs`` (a, b: reps of ``nodes``) whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Pairs are dealt by ``a``, of which no more than about ``together`` pairs meet in one place, so an ``a`` with very many is split.
    What is shuffled are 40-bit hashes of shingles, once for each pair and once for each place of an ``a``.
    """
    pairs = common.stored(pairs)
    sets = nodes.select(F.col("rep").alias("doc_id"), "__ll_set")
    heads = common.stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("places")))
    known = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads  # an a may have very many pairs
    firsts = heads.select(F.col("a").alias("doc_id"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(1), "places")).alias("place"))
    others = pairs.join(known, "a").select(F.col("b").alias("doc_id"), "a", "b", (F.pmod(F.xxhash64("b"), "places") + 1).alias("place"))
    needs = common.stored(firsts.unionByName(others).join(sets, "doc_id"))
    texts = with_ids(docs, needs).select("doc_id", "text", "a", "b", "place", "__ll_set")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, data, key = None, b"", 0
        for batch in batches:
            for part in common.parts(batch):
                out: list[tuple] = []
                for text, a, b, place, own in zip(common.utf8(part.column(1)), *(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    if text != before:
                        h = shingles(text.translate(_LOWER).split(), width)
                        before, data, key = text, _short(h), set_key(h)
                    if key == own:
                        out.append((a, place, b, data))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["a", "place", "b", "h"])

    # A null b, the set of a itself, sorts before the others.
    dealt = texts.mapInArrow(made, "a long, place long, b long, h binary").repartition("a", "place").sortWithinPartitions("a", "place", "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []
        for batch in batches:
            good: list[tuple] = []
            for i, (a, place, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                h = _wide(batch.column(3)[i].as_py())
                if b is None:
                    # The node of a document of several texts has several sets.
                    own = [*own, h] if current == (a, place) else [h]
                    current = (a, place)
                elif current == (a, place):
                    both = [len(np.intersect1d(x, h, assume_unique=True)) for x in own]
                    if any(k >= similarity * (len(x) + len(h) - k) for k, x in zip(both, own, strict=True)):
                        good.append((a, b))
            columns = list(zip(*good, strict=True)) if good else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return dealt.mapInArrow(similar, "a long, b long").distinct()


def with_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) joined with ``wanted`` (doc_id and more), which goes to all executors up to a checked number of rows."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id")


def similar_classes(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, radius: int = 6, hot_bucket: int = 2048) -> DataFrame:
    """doc_id and component_id by similarity of word shingles: documents link from a Jaccard similarity of ``similarity``.

    First the close pairs, of which there may be very many: fingerprints of the distinct words within ``radius`` bits and 256-bit sketches
    of the ``width``-word shingles that differ in no more bits than the similarity and 0.05 let expect; of each component of these
    links every member is verified against one. Then, by an exact prefix filter, all other pairs that can be similar, looked for between
    the components that are known: first as few as connect what each token brings together, and then whatever is still apart. Every
    link is verified by the exact similarity, and no pair is lost.
    """
    most = round(256 * (1 - min(1.0, similarity + 0.05)) / 2)
    prints = common.stored(with_sketches(docs, width))
    named = prints.where("doc_id is not null")
    # A set of shingles goes by its smallest doc_id, and so does the component that it is in: a component's name is its smallest member.
    nodes = common.stored(named.groupBy("__ll_set").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("__ll_fp", "__ll_sk"))))
    near = components(common.stored(links(nodes.select("rep", "__ll_fp", "__ll_sk"), radius, hot_bucket, most)))
    sure = common.stored(verified(docs, nodes, near.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")), width, similarity))
    # Rows of one doc_id count as one document, which joins the nodes of all of its texts.
    several = named.groupBy("doc_id").agg(F.min("__ll_set").alias("x"), F.max("__ll_set").alias("y")).where("x != y").select("doc_id")
    own = common.stored(named.join(several, "doc_id").join(nodes.select("__ll_set", "rep"), "__ll_set").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))

    def grown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """``nodes`` whose components (by name) ``edges`` join."""
        joined = nodes.join(components(edges).toDF("component", "c"), "component", "left")
        return common.stored(joined.select("rep", "__ll_set", "__ll_sk", F.coalesce("c", "component").alias("component")))

    def between(known: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components that ``pairs`` of nodes join."""
        of = known.select("rep", "component").distinct()
        return pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # The links that are sure are stars around their smallest members.
    stars = nodes.join(sure.toDF("component", "rep"), "rep", "left").select("rep", "__ll_set", "__ll_sk", F.coalesce("component", "rep").alias("component"))
    known = common.stored(stars)
    if not own.isEmpty():
        known = grown(known, between(known, own))
    shared = common.stored(shared_prefixes(docs, known, width, similarity))
    tried = common.stored(candidates(shared, known, similarity, spanning=True))
    known = grown(known, between(known, verified(docs, nodes, tried, width, similarity)))
    left = candidates(shared, known, similarity, spanning=False).join(tried, ["a", "b"], "left_anti")
    whole = grown(known, between(known, verified(docs, nodes, left, width, similarity)))
    return prints.join(whole.select("__ll_set", F.col("component").alias("component_id")), "__ll_set", "left").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each class of ``similar_classes``, with the columns of ``docs``.

    Of rows that share that doc_id the one with the first text stays. Rows with a null doc_id stay.
    """
    found = common.stored(similar_classes(docs, **options))
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__ll_id")).agg(F.count(F.lit(1)).alias("__ll_n"))
    kept = docs.join(first, F.col("doc_id") == F.col("__ll_id"), "left").where("doc_id is null or __ll_n is not null")
    if not first.where("__ll_n > 1").isEmpty():
        order = Window.partitionBy("doc_id").orderBy("text")
        kept = kept.withColumn("__ll_r", F.row_number().over(order)).where("doc_id is null or __ll_r = 1")
    return kept.select(*docs.columns)
