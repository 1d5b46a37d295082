import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import catalog, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def by_brute_force(prints, radius):
    """prints: doc_id -> fingerprint."""
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], dtype=np.uint64)
    linked = [(ids[i], ids[i + 1 + int(j)]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)]
    return smallest_reachable(ids, linked)


def test_query(spark, data, documents):
    prints = {r.doc_id: fingerprint(r.text) for r in documents.collect()}
    want = by_brute_force(prints, 2)
    got = catalog.op5_simhash(spark, data).collect()
    assert len(got) == len(prints)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(0, 10))
def test_bit_sliced_counting(words, radius):
    x = np.array([*words, 0, 1, 7, 2**64 - 1], dtype=np.uint64)
    assert (simhash.within(x, radius) == (np.bitwise_count(x) <= radius)).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 8])
def test_every_pair_within_the_radius_shares_a_table(radius):
    rng = np.random.default_rng(radius)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, radius, replace=False):
            b ^= 1 << int(bit)
        assert any(all(a >> s & ((1 << n) - 1) == b >> s & ((1 << n) - 1) for s, n in parts) for parts in simhash.tables(radius))


@pytest.mark.parametrize("hot", [2, 1000])
@pytest.mark.parametrize("radius", [2, 5])
def test_classes_with_hot_buckets(spark, radius, hot):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 4)
    fps = []
    for i in range(400):
        x = int(centers[i % 4])
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(bit)
        fps.append(x)
    prints = {i + 10: x for i, x in enumerate(fps)}
    df = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in prints.items()], "doc_id long, __ll_fp long")
    got = df.join(simhash.classes(df, radius, hot), "__ll_fp").collect()
    assert {r.doc_id: r.component_id for r in got} == by_brute_force(prints, radius)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 900), (900, 1000), (5, 5), (7, None)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 1000: 900}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_classes(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{rng.integers(5000)}" for _ in range(200)] for _ in range(20)]
    texts = []
    for k, words in enumerate(base):
        texts.append(" ".join(words))
        for j in range(3):  # near copies: one or two words changed
            changed = list(words)
            for at in rng.choice(200, 1 + j % 2, replace=False):
                changed[at] = f"new{k}{j}"
            texts.append(" ".join(changed))
    for k in range(20):  # distant relatives: half of it anew
        texts.append(" ".join(base[k][:100] + [f"z{rng.integers(5000)}" for _ in range(100)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df).collect()}
    assert got == {**{i: i // 4 * 4 for i in range(80)}, **{i: i for i in range(80, 100)}}
    kept = simhash.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 80, 4), *range(80, 100)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for keep in (290, 250, 150):
        a = [b"%d" % i for i in rng.integers(0, 10**6, 300)]
        b = a[:keep] + [b"%d" % i for i in rng.integers(0, 10**6, 300 - keep)]
        x, y = (np.frombuffer(simhash.sketch(w, 5), dtype=np.uint8) for w in (a, b))
        j = jaccard(" ".join(w.decode() for w in a), " ".join(w.decode() for w in b))
        assert abs(1 - 2 * np.bitwise_count(x ^ y).sum() / 256 - j) < 0.2


def test_recall_on_documents(spark, data):
    """Of all pairs of five-word similarity 0.8 or more at least 0.9 are in one class, and classes hold no strangers."""
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    shingles = {}
    for i, t in texts.items():
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    where = {}
    for i, s in shingles.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    similar = [(a, b) for a, b in pairs if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert similar and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)
    for a, b in got.items():
        assert a == b or any(len(shingles[a] & shingles[x]) >= 0.6 * len(shingles[a] | shingles[x]) for x in texts if x != a and got[x] == b)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: (r.fingerprint == "0" * 16, r.component_id) for r in got if r.doc_id in (1, 2, 5)} == dict.fromkeys((1, 2, 5), (True, 1))
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [None, 1, 3, 6, 7, 8]))
    assert simhash.keep_one_of_each(empty).collect() == []


def test_two_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "b b b b b b"), (1, "a a a a a a"), (2, "c d e f g h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in simhash.keep_one_of_each(df).collect()) == [(1, "a"), (2, "c")]


def test_kept_rows_are_unchanged(spark, documents):
    kept = simhash.keep_one_of_each(documents)
    assert kept.exceptAll(documents).isEmpty()
    assert kept.count() == kept.select(F.countDistinct("doc_id")).first()[0]
