"""The pipeline's near duplicates against brute force over all pairs: every one of similarity 0.8 or more, and no other link."""

import random

import numpy as np
import pytest

from logloom.llm import simhash


def by_brute_force(texts, similarity=0.8):
    sets, where, up = {}, {}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    for a, b in {(a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :]}:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("frequent", [8, 1])
def test_every_similar_pair(spark, monkeypatch, frequent):
    """Text appended, words changed here and there, boilerplate that many share, and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(60)]
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 20, 100, 400]))] + (shared if k % 2 else [])
        texts.append(base)
        for extra in (0.10, 0.15, 0.22, 0.27):
            texts.append(base + [word() for _ in range(int(extra * len(base)))])
        for share in (0.005, 0.02, 0.03):
            texts.append([word() if rng.random() < share else w for w in base])
    rng.shuffle(texts)
    texts = {i: " ".join(w) for i, w in enumerate(texts)}
    find = simhash._last_shingles
    monkeypatch.setattr(simhash, "_last_shingles", lambda docs, width: find(docs, width, least=frequent))
    want = by_brute_force(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and 60 < len(set(want.values())) < len(texts)


def test_classes_of_documents_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    want = by_brute_force({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()} == want


def test_names_of_sets():
    assert simhash.set_key(np.array([1, 2], dtype=np.uint64)) != simhash.set_key(np.array([1, 3], dtype=np.uint64))
