"""Template generators whose result depends on the order of lines.

Each runs exactly inside groups that never look at each other: drain by leaf (length and first literals), lenma by length, the frequent
word tree by message type; shiso has one global tree. Groups are read as a stream sorted by line id, so a worker holds the clusters of
one group, not its lines. Results do not depend on how the input is partitioned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.variables import DIGITS, VariableRules

WILD = T.WILDCARD


def merged(a: list[str], b: list[str]) -> list[str]:
    return [x if x == y else WILD for x, y in zip(a, b, strict=True)]


def ordered(
    lines: DataFrame,
    group: Column,
    miner: Callable[[], object],
    partitions: int | None = None,
    state: DataFrame | None = None,
    states: DataFrame | None = None,
    keep: bool = False,
) -> DataFrame:
    """lid, cid (a text: group and cluster number) and tpl (the cluster's template after the line) by streaming ordered groups.

    lines: lid and words, and counts if the miner wants them. miner() makes the state of a group; its add(words, counts) returns the
    cluster's number and its template. state: the clusters of an earlier run (``cluster_state``), which the miner takes up by
    resume(first, tpl) before the group's first line. states: whole states of an earlier run (g, state), which it takes up by
    load(text). keep: one row more for each group, of which cid is the group, tpl the one text of its dump() and lid is null.
    """
    none = F.lit(None).cast("array<string>").alias("tpl")
    extra = [F.col("counts")] if "counts" in lines.columns else [F.lit(None).cast("array<long>").alias("counts")]
    keyed = lines.select(group.cast("string").alias("g"), "lid", "words", *extra, none)
    if state is not None:
        at = F.substring_index("cid", "/", -1).cast("long")
        old = state.select(F.regexp_replace("cid", "/[0-9]+$", "").alias("g"), (F.lit(-(1 << 62)) + at).alias("lid"), F.col("first").alias("words"), F.lit(None).cast("array<long>").alias("counts"), "tpl")
        keyed = keyed.unionByName(old)
    if states is not None:
        whole = states.select("g", F.lit(-(1 << 63)).alias("lid"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<long>").alias("counts"), F.array("state").alias("tpl"))
        keyed = keyed.unionByName(whole)
    dealt = keyed.repartition(partitions, "g") if partitions else keyed.repartition("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = object(), None
        for batch in batches:
            lids, cids, tpls = [], [], []

            def kept() -> None:
                lids.append(None)
                cids.append(current)
                tpls.append([own.dump()])

            for g, lid, words, counts, old in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != current:
                    if keep and own is not None:
                        kept()
                    current, own = g, miner()
                if old is not None:
                    own.load(old[0]) if words is None else own.resume(words, old)
                    continue
                cid, tpl = own.add(words, counts)
                lids.append(lid)
                cids.append(f"{g}/{cid}")
                tpls.append(tpl)
            yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(cids, pa.string()), pa.array(tpls, pa.list_(pa.string()))], ["lid", "cid", "tpl"])
        if keep and own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([current], pa.string()), pa.array([[own.dump()]], pa.list_(pa.string()))], ["lid", "cid", "tpl"])

    return dealt.sortWithinPartitions("g", "lid").mapInArrow(run, "lid long, cid string, tpl array<string>")


def states_of(kept: DataFrame) -> DataFrame:
    """(g, state) out of a run with ``keep``: what ``states`` takes to go on with more lines."""
    return kept.where("lid is null").select(F.col("cid").alias("g"), F.col("tpl")[0].alias("state"))


class Saved:
    """A miner whose whole state is a few plain attributes, named in SAVED."""

    SAVED: tuple[str, ...] = ()

    def dump(self) -> str:
        return json.dumps([getattr(self, x) for x in self.SAVED])

    def load(self, text: str) -> None:
        for name, value in zip(self.SAVED, json.loads(text), strict=True):
            setattr(self, name, value)


def cluster_state(lines: DataFrame, mined: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """cid, first (its first line's words) and tpl of every cluster after a run: what ``state`` takes to go on with more lines."""
    made = lines.select("lid", "words").join(mined, "lid").groupBy("cid").agg(F.min_by("words", "lid").alias("first"), F.max_by("tpl", "lid").alias("tpl"))
    if before is None:
        return made
    old = before.select("cid", F.col("first").alias("f"), F.col("tpl").alias("t"))
    return made.join(old, "cid", "full").select("cid", F.coalesce("f", "first").alias("first"), F.coalesce("tpl", "t").alias("tpl"))


class Drain(Saved):
    """The clusters of one leaf: the most similar one takes a line if it is similar enough; ties go to the older."""

    SAVED = ("templates",)

    def __init__(self, threshold: float = 0.3):
        self.threshold, self.templates = threshold, []

    def resume(self, first: list[str], tpl: list[str]) -> None:
        self.templates.append(list(tpl))

    def add(self, words: list[str], counts=None) -> tuple[int, list[str]]:
        best, found = 0.0, None
        for i, tpl in enumerate(self.templates):
            similarity = sum(a == b for a, b in zip(tpl, words, strict=True)) / len(words)
            if similarity >= self.threshold and similarity > best:
                best, found = similarity, i
        if found is None:
            self.templates.append(list(words))
            found = len(self.templates) - 1
        else:
            self.templates[found] = merged(self.templates[found], words)
        return found, self.templates[found]


def drain_leaf(tokens: Column, depth: int = 3) -> Column:
    """The key of a leaf: the number of words and the first depth - 2 of them that are no variables."""
    literals = F.slice(F.filter(tokens, lambda t: t != WILD), 1, depth - 2) if depth > 2 else F.array().cast("array<string>")
    return F.to_json(F.struct(F.size(tokens).alias("n"), literals.alias("p")))


def drain(lines: DataFrame, threshold: float = 0.3, depth: int = 3, rules: VariableRules = DIGITS, state: DataFrame | None = None) -> DataFrame:
    """Fixed-depth tree: lid, cid, tpl. state goes on from an earlier run."""
    masked = lines.select("lid", rules.template(F.col("words")).alias("words"))
    return ordered(masked, drain_leaf(F.col("words"), depth), lambda: Drain(threshold), state=state)


class Lenma(Saved):
    """Clusters of lines with one number of words, by the cosine of their words' lengths with the cluster's first line.

    evolve: score against the template and the last line instead.
    """

    SAVED = ("first", "lengths", "templates")

    def __init__(self, threshold: float = 0.9, n_same: int = 3, head_rule: bool = True, evolve: bool = False):
        self.threshold, self.n_same, self.head_rule, self.evolve = threshold, n_same, head_rule, evolve
        self.first: list[list[str]] = []
        self.lengths: list[list[int]] = []
        self.templates: list[list[str]] = []

    def resume(self, first: list[str], tpl: list[str]) -> None:
        self.first.append(list(tpl if self.evolve else first))
        self.lengths.append([len(w) for w in first])
        self.templates.append(list(tpl))

    def score(self, i: int, words: list[str]) -> float:
        own = self.first[i]
        if self.head_rule and words and own[0] != words[0]:
            return 0.0
        same = sum(a == b for a, b in zip(own, words, strict=True))
        if same + own.count(WILD) == len(words):
            return 1.0
        if same < self.n_same:
            return 0.0
        x, y = self.lengths[i], [len(w) for w in words]
        norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / norm if norm else 0.0

    def add(self, words: list[str], counts=None) -> tuple[int, list[str]]:
        scores = [(self.score(i, words), -i) for i in range(len(self.first))]
        best = max((s for s in scores if s[0] >= self.threshold), default=None)
        if best is None:
            self.first.append(list(words))
            self.lengths.append([len(w) for w in words])
            self.templates.append(list(words))
            return len(self.first) - 1, self.templates[-1]
        i = -best[1]
        self.templates[i] = merged(self.templates[i], words)
        if self.evolve:
            self.first[i], self.lengths[i] = merged(self.first[i], words), [len(w) for w in words]
        return i, self.templates[i]


def lenma(lines: DataFrame, threshold: float = 0.9, n_same: int = 3, head_rule: bool = True, evolve: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Word-length clusters: lid, cid, tpl. state goes on from an earlier run."""
    return ordered(lines.select("lid", "words"), F.size("words"), lambda: Lenma(threshold, n_same, head_rule, evolve), state=state)


def letters(word: str) -> dict:
    """Unit vector of the counts of ASCII letters, digits and all else."""
    out: dict = {}
    for c in word:
        key = c if c.isascii() and c.isalpha() else "0" if c.isdigit() else "."
        out[key] = out.get(key, 0) + 1
    return _unit(out)


def character_classes(word: str) -> dict:
    """Unit vector of the counts of upper case, lower case, digits and all else."""
    out: dict = {}
    for c in word:
        key = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "."
        out[key] = out.get(key, 0) + 1
    return _unit(out)


def _unit(counts: dict) -> dict:
    norm = math.sqrt(sum(v * v for v in counts.values()))
    return {k: v / norm for k, v in counts.items()} if norm else counts


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance over words, where a wildcard equals any."""
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y and WILD not in (x, y))))
        previous = row
    return previous[-1]


class Shiso(Saved):
    """A search tree of bounded width: a line joins the first similar child, becomes a new child, or goes on below the nearest one."""

    SAVED = ("templates", "links")

    def __init__(self, threshold: float = 0.9, max_child: int = 4, vector: Callable[[str], dict] = letters):
        self.threshold, self.max_child, self.vector = threshold, max_child, vector
        self.templates: list[list[str]] = []
        self.children: dict[int, list[int]] = {-1: []}
        self.known: dict[str, dict] = {}

    @property
    def links(self) -> list[tuple[int, list[int]]]:
        return list(self.children.items())

    @links.setter
    def links(self, given: list) -> None:
        self.children = {k: v for k, v in given}

    def _vector(self, word: str) -> dict:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self.vector(word)
        return self.known[word]

    def similarity(self, a: list[str], b: list[str]) -> float:
        if len(a) != len(b):
            return 0.0
        if not a:
            return 1.0
        apart = 0.0
        for x, y in zip(a, b, strict=True):
            if x != y and WILD not in (x, y):
                u, v = self._vector(x), self._vector(y)
                apart += sum((u.get(k, 0.0) - v.get(k, 0.0)) ** 2 for k in u.keys() | v.keys())
        return 1.0 - apart / (2.0 * len(a))

    def add(self, words: list[str], counts=None) -> tuple[int, list[str]]:
        parent = -1
        while True:
            for child in self.children[parent]:
                if self.similarity(self.templates[child], words) >= self.threshold:
                    self.templates[child] = merged(self.templates[child], words)
                    return child, self.templates[child]
            if len(self.children[parent]) < self.max_child:
                self.templates.append(list(words))
                new = len(self.templates) - 1
                self.children[parent].append(new)
                self.children[new] = []
                return new, self.templates[new]
            parent = min(self.children[parent], key=lambda c: edit_distance(self.templates[c], words))


def shiso(lines: DataFrame, threshold: float = 0.9, max_child: int = 4, vector: Callable[[str], dict] = letters, states: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """One tree for all lines, hence one task, which streams them in order: the method has no independent parts."""
    return ordered(lines.select("lid", "words"), F.lit("all"), lambda: Shiso(threshold, max_child, vector), 1, states=states, keep=keep)


class FrequentTree(Saved):
    """Words by descending frequency grow a tree; nodes that get too many children are cut and stop later lines."""

    SAVED = ("tree", "templates")

    def __init__(self, max_child: int = 6, cut_depth: int = 3):
        self.max_child, self.cut_depth, self.tree = max_child, cut_depth, {}
        self.known: dict[tuple, int] = {}

    @property
    def templates(self) -> list[tuple]:
        return list(self.known)

    @templates.setter
    def templates(self, given: list[list[str]]) -> None:
        self.known = {tuple(x): i for i, x in enumerate(given)}

    def add(self, words: list[str], counts: list[int]) -> tuple[int, list[str]]:
        node, depth, kept = self.tree, 0, set()
        for _, w in sorted(zip(counts, words, strict=True), reverse=True):
            children = node.get("", {})
            if children is None:
                break
            if w not in children:
                node.setdefault("", {})[w] = {}
                if len(node[""]) >= self.max_child and depth >= self.cut_depth:
                    node[""] = None
                    break
            kept.add(w)
            node, depth = node[""][w], depth + 1
        tpl = [w if w in kept else WILD for w in words]
        return self.known.setdefault(tuple(tpl), len(self.known)), tpl


#: Words that come more than once go to all executors up to so many, as one table of counts, and are joined by a shuffle beyond.
BROADCAST_WORDS = 1_000_000


def word_counts(lines: DataFrame, most: int | None = None) -> DataFrame:
    """lid, words and counts: how often each word comes in all lines."""
    counts = lines.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    most = BROADCAST_WORDS if most is None else most
    known = counts.where("n > 1").limit(most + 1).toArrow()  # a checked number of rows
    if known.num_rows > most:
        places = lines.select("lid", F.posexplode("words").alias("p", "w"))
        counted = places.join(counts, "w").groupBy("lid").agg(F.array_sort(F.collect_list(F.struct("p", "w", "n"))).alias("a"))  # a line's words
        return counted.select("lid", F.transform("a", lambda x: x["w"]).alias("words"), F.transform("a", lambda x: x["n"]).alias("counts"))
    sent = lines.sparkSession.sparkContext.broadcast((known.column("w").combine_chunks(), known.column("n").to_numpy()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        numbers = np.append(numbers, 1)
        for batch in batches:
            lists = batch.column(1)
            own = lists.flatten()
            at = pc.fill_null(pc.index_in(own, value_set=words), len(words)) if len(words) else pa.array(np.zeros(len(own), dtype=np.int32))
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers[at.to_numpy()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, counts], ["lid", "words", "counts"])

    return lines.select(F.col("lid").cast("long"), "words").where("size(words) > 0").mapInArrow(counted, "lid long, words array<string>, counts array<long>")


class CountingTree(FrequentTree):
    """A frequent-word tree that counts the words itself, each line's own included: the online form, for streams."""

    SAVED = ("tree", "templates", "counts")

    def __init__(self, max_child: int = 6, cut_depth: int = 3):
        super().__init__(max_child, cut_depth)
        self.counts: dict[str, int] = {}

    def add(self, words: list[str], counts=None) -> tuple[int, list[str]]:
        for w in words:
            self.counts[w] = self.counts.get(w, 0) + 1
        return super().add(words, [self.counts[w] for w in words])


def tree_of(kind: str) -> Column:
    """The key of a frequent-word tree: none (one tree), top (the first word) or length."""
    return {"none": F.lit("all"), "top": F.element_at("words", 1), "length": F.size("words").cast("string")}[kind]


def frequent_tree(lines: DataFrame, max_child: int = 6, cut_depth: int = 3, message_type: str = "none", online: bool = False) -> DataFrame:
    """Frequent-word trees, one per message type (none, top or length); with type none there is one tree, hence one task.

    Offline the words are counted over all lines first; online a line's words count as often as they came up to that line.
    """
    made = running_counts(lines) if online else word_counts(lines)
    return ordered(made, tree_of(message_type), lambda: FrequentTree(max_child, cut_depth), 1 if message_type == "none" else None)


#: Lines that are counted in one piece by ``running_counts``.
COUNT_BLOCK = 4096


def running_counts(lines: DataFrame, block: int | None = None) -> DataFrame:
    """lid, words and counts: how often each word came in all lines up to and including this one.

    Lines are counted in blocks of line ids, each in order by one task at a time. What earlier blocks had of a block's words comes from
    a running sum with one row per word and block, so a word that is everywhere is dealt over as many keys as there are blocks.
    """
    numbered = lines.select(F.floor(F.col("lid") / (block or COUNT_BLOCK)).cast("long").alias("block"), "lid", "words")
    sums = numbered.select("block", F.explode("words").alias("w")).groupBy("block", "w").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("w").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("block", "w", before.alias("n")).where("n > 0").groupBy("block").agg(F.collect_list("w").alias("words"), F.collect_list("n").alias("known"))  # a block's words
    first = offsets.select("block", F.lit(-(1 << 63)).alias("lid"), "words", "known")
    dealt = numbered.withColumn("known", F.lit(None).cast("array<long>")).unionByName(first).repartition("block").sortWithinPartitions("block", "lid")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, {}
        for batch in batches:
            lids, texts, counts = [], [], []
            for at, lid, words, known in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != current:
                    current, seen = at, {}
                if known is not None:
                    seen = dict(zip(words, known, strict=True))
                    continue
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
                lids.append(lid)
                texts.append(words)
                counts.append([seen[w] for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["lid", "words", "counts"])

    return dealt.mapInArrow(counted, "lid long, words array<string>, counts array<long>")


class Joint(Saved):
    """Definitions first, then another miner whose templates become definitions: for lines of one number of words, each of them given
    twice, as it is and as the miner is to see it.

    A new template of the miner is a new definition, and one that it changes is changed there too, so later lines may match it without
    reaching the miner. search: tree (literals before wildcards, from left to right) or table (the first).
    """

    SAVED = ("definitions", "leaves")

    def __init__(self, definitions: list[tuple[int, list[str]]], make: Callable[[], object], leaf: Callable[[list[str]], str], search: str = "tree"):
        self.definitions = [(f"d{k}", list(t)) for k, t in definitions]
        self.make, self.leaf, self.search = make, leaf, search
        self.miners: dict[str, object] = {}

    @property
    def leaves(self) -> list[tuple[str, str]]:
        return [(k, m.dump()) for k, m in self.miners.items()]

    @leaves.setter
    def leaves(self, given: list) -> None:
        self.miners = {}
        for k, text in given:
            self.miners[k] = self.make()
            self.miners[k].load(text)

    def matched(self, words: list[str]) -> tuple[str, list[str]] | None:
        fits = [d for d in self.definitions if len(d[1]) == len(words) and all(t in (WILD, w) for t, w in zip(d[1], words, strict=True))]
        if not fits or self.search == "table":
            return fits[0] if fits else None
        return max(fits, key=lambda d: [t != WILD for t in d[1]])

    def add(self, words: list[str], counts=None) -> tuple[str, list[str]]:
        words, masked = words[: len(words) // 2], words[len(words) // 2 :]
        found = self.matched(words)
        if found is not None:
            return found[0], list(found[1])
        leaf = self.leaf(masked)
        miner = self.miners.setdefault(leaf, self.make())
        number, tpl = miner.add(masked, counts)
        cid = f"m{leaf}/{number}"
        for d in self.definitions:
            if d[0] == cid:
                d[1][:] = tpl
                break
        else:
            self.definitions.append((cid, list(tpl)))
        return cid, tpl


def joint(
    lines: DataFrame,
    definitions: list[tuple[int, list[str]]],
    make: Callable[[], object],
    leaf: Callable[[list[str]], str] = lambda words: "",
    search: str = "tree",
    rules: VariableRules | None = None,
    states: DataFrame | None = None,
    keep: bool = False,
) -> DataFrame:
    """lid, cid and tpl by definitions (defid, tpl) with feedback from a miner of lines of one length: ``Drain`` by leaf, with the words
    that ``rules`` hit as wildcards, or ``Lenma``.

    Only lines and templates with equally many words ever meet, so lengths run beside each other. The definitions are the site's own
    file, which the driver holds.
    """
    given = list(definitions)
    twice = F.concat("words", rules.template(F.col("words")) if rules else F.col("words"))
    return ordered(lines.select("lid", twice.alias("words")), F.size("words"), lambda: Joint(given, make, leaf, search), states=states, keep=keep)


def leaf_of(depth: int = 3) -> Callable[[list[str]], str]:
    """What ``drain_leaf`` tells apart among lines of one length."""
    return lambda words: json.dumps([w for w in words if w != WILD][: max(0, depth - 2)])


def merged_prefixes(lines: DataFrame, rules: VariableRules = DIGITS) -> DataFrame:
    """lid, tpl by prefix counts: variables by rule first; then a word is part of the template if, below some earlier place of the
    message, it stands at its depth in every message that shares the words up to that place, or if it is such an earlier place itself.

    Depth counts literals only. The fewer messages share the words up to a place, the sooner they agree further on, so the last place
    before a word that several messages share decides. Where all of them go on with one word, two totals tell; only where they part are
    their later words compared, up to the shortest message. Nothing has to be read in order, and a line of n words costs n rows and no
    n x n pairs.
    """
    primary = lines.select("lid", rules.template(F.col("words")).alias("ptpl")).withColumn("h", F.xxhash64("ptpl"))  # a short key in front of the long one
    distinct = primary.groupBy("h", "ptpl").agg(F.count(F.lit(1)).alias("c"), F.min("lid").alias("pid"))
    literals = distinct.withColumn("lits", T.description(F.col("ptpl")))
    # Where messages are sorted, a neighbour shares the longest prefix; what is longer is one message's own and is not named at all.
    dealt = literals.select("pid", "c", "lits").repartitionByRange("lits").sortWithinPartitions("lits")
    named = dealt.mapInArrow(_prefixes, "pid long, c long, n int, d int, u binary")
    # A prefix of one message decides nothing, and most are such: they go first.
    node_counts = named.groupBy("u").agg(F.sum("c").alias("total"), F.min("n").alias("least")).where("total > 1")
    shared = named.select("pid", "u", "d").join(node_counts, "u")
    followed = shared.withColumn("next", F.lead("total").over(Window.partitionBy("pid").orderBy("d")))
    alike = followed.where("next = total").select("pid", F.explode(F.array(F.col("d"), F.col("d") + 1)).alias("d"))
    parting = followed.where("(next is null or next != total) and least > d + 2").select("pid", "u", F.col("d").alias("ud"), "least")
    later = F.slice("lits", F.col("ud") + 3, F.col("least") - F.col("ud") - 2)
    words = parting.join(literals.select("pid", "lits"), "pid").select("u", "ud", F.posexplode(later).alias("at", "w"))
    agreed = words.groupBy("u", "ud", "at").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo = hi").select("u", (F.col("ud") + F.col("at") + 2).alias("d"))
    hits = parting.select("pid", "u", "ud").join(agreed, "u").select("pid", F.explode(F.array("ud", "d")).alias("d"))
    kept = alike.unionByName(hits).groupBy("pid").agg(F.collect_set("d").alias("kept"))
    finished = literals.select("h", "pid", "ptpl").join(kept, "pid", "left").select("h", "ptpl", "kept").mapInArrow(_kept_words, "h long, ptpl array<string>, tpl array<string>")
    return primary.join(finished, ["h", "ptpl"]).select("lid", "tpl")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each prefix of a message's literals that others may share: pid, c, their number n, the prefix's last place d and its name u,
    128 bits chained word by word. Messages come sorted; those at the ends of a partition name all of their prefixes. A message that
    stands for several lines names all as well.
    """

    def shared(a: list[str], b: list[str]) -> int:
        k = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            k += 1
        return k

    def made(rows: list[tuple]) -> pa.RecordBatch:
        pids, counts, sizes, depths, names = [], [], [], [], []
        for pid, c, lits, n in rows:
            name = b""
            for w in lits[:n]:
                name = xxhash.xxh3_128_digest(name + w.encode())
                names.append(name)
            pids += [pid] * n
            counts += [c] * n
            sizes += [len(lits)] * n
            depths += range(n)
        columns = [pa.array(pids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(depths, pa.int32()), pa.array(names, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["pid", "c", "n", "d", "u"])

    before: tuple | None = None
    shared_before: int | None = None  # None: unknown, so all
    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if before is not None:
                k = shared(before[2], row[2])
                whole = shared_before is None or before[1] > 1
                rows.append((*before, len(before[2]) if whole else max(shared_before, k)))
                shared_before = k
            before = row
            if len(rows) > 1000:
                yield made(rows)
                rows = []
        yield made(rows)
    if before is not None:
        yield made([(*before, len(before[2]))])


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with their templates: the literals at the places ``kept``, and wildcards."""
    for batch in batches:
        made = []
        for ptpl, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own, d, tpl = set(kept or ()), -1, []
            for w in ptpl:
                d += w != WILD
                tpl.append(w if w != WILD and d in own else WILD)
            made.append(tpl)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.string()))], ["h", "ptpl", "tpl"])


#: Generators by name: (function of lines, whether it depends on order, whether it may run on a stream).
REGISTRY: dict[str, tuple[Callable[..., DataFrame], bool, bool]] = {
    "drain": (drain, True, True),
    "lenma": (lenma, True, True),
    "shiso": (shiso, True, True),
    "fttree": (frequent_tree, True, True),
    "dlog": (merged_prefixes, False, False),
}

#: Parameter grids of the generators that have one. Fixed values.
GRIDS = {
    "drain": [{"threshold": t / 10, "depth": d} for t in range(1, 10) for d in (3, 4, 5)],
    "lenma": [{"threshold": t / 100, "n_same": n} for t in (80, 85, 90, 95) for n in (1, 2, 3)],
    "fttree": [{"max_child": m, "cut_depth": d} for m in (4, 6, 8, 10) for d in (1, 2, 3)],
}
