import hashlib
import random

import pytest

from logloom.llm import catalog, suffix_dedup


def brute_force(rows, length=100):
    """rows: (doc_id, text), in order -> doc_id: (n_bytes, n_removed, n_spans, kept bytes)."""
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out[doc] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_query(spark, data, documents):
    check(catalog.op3_suffix_dedup(spark, data).collect(), brute_force(sorted((r.doc_id, r.text) for r in documents.collect())))


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, monkeypatch, seed, hot):
    """Texts put together from shared pieces around the threshold's length, with edits, periods and other scripts."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(60, 180))) for _ in range(12)] + ["ab" * 80, "x" * 130]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randrange(1, 7)):
            p = rng.choice(pieces)
            if rng.random() < 0.5:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("abcd") + p[at + rng.randrange(2) :]
            text += p[rng.randrange(30) :] if rng.random() < 0.5 else p
        rows.append((i * 3 + 1, text))
    shuffled = rng.sample(rows, len(rows))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5), keep_bytes=True).collect()
    want = brute_force(rows)
    check(got, want)
    assert all(bytes(r.kept) == want[r.doc_id][3] for r in got)
    check(suffix_dedup.every_position(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)).collect(), want)


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 500)
    rng = random.Random(2)
    long = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(1, long[:1700]), (2, "head " + long), (3, long[333:2222] + long[:900]), (4, "z" * 1500), (5, long[:498]), (6, long[:499]), (7, long[:500] + "y" * 110)]
    check(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), brute_force(rows))


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT, 10**9])
def test_common_passage_with_different_neighbours(spark, monkeypatch, hot):
    """Hot strings of every length around the threshold; in some of the parts they are hot, in others they are not."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 5000)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(140))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(50, 90))) + passage[: rng.choice([40, 84, 90, 99, 100, 101, 140])] + "".join(rng.choice("qrst ") for _ in range(60))) for i in range(400)]
    check(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), brute_force(rows))


def test_odd_rows(spark, odd, empty):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id in (1, 2)) == [(0, 0), (0, 0)]
    first, again = (sorted(r.n_removed for r in got if r.doc_id == i) for i in (3, 4))
    assert first == [0] and again[0] == again[1] > 100
    long_x = next(r for r in got if r.doc_id == 6)
    assert (long_x.n_removed, long_x.n_spans) == (300_000 - 1, 1)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_two_texts_of_one_id(spark):
    a, b = "a" + "0123456789" * 12, "b" + "0123456789" * 12
    rows = [(1, b), (1, a), (None, a)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_force([("1a", a), ("1b", b), ("n", a)])
    assert sorted(r.n_removed for r in got) == sorted(x[1] for x in want.values())
    assert [r.n_removed for r in got if r.doc_id is None] == [121]
