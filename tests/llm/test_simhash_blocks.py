"""Blocks of comparisons are filled across lags, and hashes of words are enough for shingles."""

import random

import numpy as np
import pytest
import xxhash

from logloom.llm import simhash


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("with_sketches", [False, True])
def test_one_large_bucket_among_small_ones(monkeypatch, with_sketches):
    """Few pairs per lag do not make few pairs per block, whatever the size of a block, and no link is lost."""
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.repeat(np.arange(50), 3), np.repeat(50, 300)])
    fps = rng.integers(0, 2**63, len(keys), dtype=np.uint64)
    sketches = rng.integers(0, 2**63, (len(keys), 4), dtype=np.uint64)
    for i in range(0, len(keys) - 5, 4):
        fps[i + 2], sketches[i + 2] = fps[i] ^ np.uint64(0b111), sketches[i] ^ np.uint64(1 << i % 3)
        fps[i + 5] = fps[i] ^ np.uint64(1 << 40)
    pairs = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if keys[i] == keys[j]]
    near = [(i, j) for i, j in pairs if int(fps[i] ^ fps[j]).bit_count() <= 6]
    near = [(i, j) for i, j in near if not with_sketches or np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= 4]
    find, sizes = simhash.within, []
    monkeypatch.setattr(simhash, "within", lambda differences, radius: sizes.append(len(differences)) or find(differences, radius))
    got = simhash.bucket_links(keys, fps, 6, sketches if with_sketches else None, 4)
    assert sum(sizes) == len(pairs) and len(sizes) <= len(pairs) // 4096 + 1
    assert set(got) <= set(near) and components(len(keys), got) == components(len(keys), near) and got
    assert len(got) == len(keys) - len(set(components(len(keys), near)))
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    sizes.clear()
    assert simhash.bucket_links(keys, fps, 6, sketches if with_sketches else None, 4) == got
    assert set(sizes[:-1]) == {1000} and sum(sizes) == len(pairs)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes(n):
    words = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    planes = np.unpackbits(simhash.planes(words), axis=1, bitorder="little")[:, :n]
    assert [[int(w) >> b & 1 for w in words] for b in range(64)] == planes.tolist()


def test_shingles_are_the_distinct_runs_of_words(monkeypatch):
    rng = random.Random(2)
    known = {}
    for n in [0, 1, 2, 4, 5, 6, 50, 3000]:
        words = [b"w%d" % rng.randrange(4) for _ in range(n)]
        for some in (words, words[::-1], words[1:]):
            runs = {tuple(some[i : i + 5]) for i in range(max(1, len(some) - 4))}
            h = simhash.shingles(some, 5)
            assert len(h) == len(runs) and (h[1:] > h[:-1]).all()
            for run in runs:
                assert known.setdefault(run, int(simhash.shingles(list(run), 5)[0])) in set(h.tolist())
    assert len(set(known.values())) == len(known)
    hashed = []
    digest = xxhash.xxh64_intdigest
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda x, seed=0: hashed.append(x) or digest(x, seed))
    simhash.shingles(words, 5)
    assert hashed == words
