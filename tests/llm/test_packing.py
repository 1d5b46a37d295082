import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from logloom.llm import catalog, packing
from logloom.llm.catalog import TOKENIZER_FILE


def pack(df, **options):
    return packing.pack_documents(df, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN, **options).collect()


def check(pieces, ids_of, limits):
    """Every id once, sequences gapless and within the limits; returns tokens and padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        ids = ids_of[doc]
        copies = sum(p.start == 0 for p in own)
        assert sorted(i for p in own for i in range(p.start, p.start + p.length)) == sorted(list(range(len(ids))) * copies)
        for p in own:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= limits[0] and len(own) <= limits[1] and sum(p.loss_tokens for p in own) <= limits[2]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return sum(p.length for p in pieces), padding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_json_vocabulary(documents, tokenizer):
    rows = documents.select("doc_id", "text").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in rows}
    total, padding = check(pack(documents), ids, (1024, 256, 1024))
    assert total == sum(map(len, ids.values()))
    assert padding <= 0.01 * total


def test_ids_of_every_document_and_of_odd_texts(spark, data, tokenizer):
    """The ranks form and the JSON form of the vocabulary give the same ids: all of a larger table, and texts made to break them."""
    tokenizer.encode_special_tokens = True
    top = data.replace("0.001", "0.01")
    texts = [r.text for r in spark.read.parquet(f"{top}/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(6)
    texts += ["<|endoftext|>", "a<|endoftext|> b", "\x00\x01", "\ufffd\U0001f468\u200d\U0001f469", "e\u0301\u00e9", "\u3000 \u00a0\t\r\n \n", "'s'T'll 'RE", "0123456789" * 50, " " * 999, "\u0130I\u0131\u00df\u1e9e", "\ud7ff\ue000"]
    texts += ["".join(map(chr, rng.choice([c for c in range(1, 0x3000) if c < 0xD800], 200))) for _ in range(50)]
    with open(public_tokenizers.path(TOKENIZER_FILE), "rb") as f:
        encoder = packing._encoder(f.read(), public_tokenizers.PATTERN)
    for text, encoded in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode_ordinary(text) == encoded.ids


def test_tight_limits(documents, tokenizer):
    rows = documents.select("doc_id", "text").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in rows}
    check(pack(documents, max_tokens=256, max_segments=3, max_loss=200), ids, (256, 3, 200))


def test_odd_rows(odd, empty, tokenizer):
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd.collect()}
    pieces = pack(odd)
    check(pieces, ids, (1024, 256, 1024))
    assert {p.doc_id for p in pieces} == set(ids)
    assert pack(empty) == []


def test_whole_examples(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 400)), int(rng.integers(0, 150))) for i in range(500)] + [(900, 2000, 1), (901, None, 1), (902, 10, None), (903, 10, 999)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").coalesce(1), max_tokens=1000, max_segments=8, max_loss=300).collect()
    known = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    assert {r.example_id for r in got if r.sequence_id is None} == {900, 901, 903}
    sequences = defaultdict(list)
    for r in got:
        if r.sequence_id is not None:
            sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += known[r.example_id][1]
        assert at <= 1000 and len(own) <= 8 and sum(known[r.example_id][2] or 0 for r in own) <= 300
    need = max(sum(r[1] for r in rows[:500]) / 1000, sum(r[2] for r in rows[:500]) / 300)
    assert len(sequences) <= 1.15 * need + 2


def placed_by_definition(rows, limits, pool=1024):
    """Sequences of (example, tokens, loss): of what fits the open one goes the largest dot product with what is left of the limits."""
    waiting, done, own, left = [], [], [], list(limits)
    rows = iter(rows)
    while True:
        while len(waiting) < pool and (row := next(rows, None)) is not None:
            waiting.append(row)
        if not waiting:
            return [*done, own] if own else done
        need = [(n, 1, loss) for _, n, loss in waiting]
        fitting = [i for i, v in enumerate(need) if all(a <= b for a, b in zip(v, left))]
        if not fitting:
            done, own, left = [*done, own], [], list(limits)
            continue
        scale = np.array([1 / m for m in limits])
        score = np.array(need, dtype=float) @ (np.array(left, dtype=float) * scale * scale)
        i = max(fitting, key=lambda k: score[k])
        own.append(waiting[i][0])
        left = [x - v for x, v in zip(left, need[i])]
        waiting[i] = waiting[-1]
        waiting.pop()
        if min(left) <= 0:
            done, own, left = [*done, own], [], list(limits)


@pytest.mark.parametrize("limits", [(1000, 8, 300), (1000, 3, 900), (5000, 50, 300)])
def test_placement_by_definition(spark, limits):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(1, 400)), int(rng.integers(0, 150))) for i in range(3000)]
    df = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").coalesce(1)
    got = defaultdict(list)
    for r in sorted(packing.pack_examples(df, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], pool=64).collect(), key=lambda r: (r.sequence_id, r.offset)):
        got[r.sequence_id].append(r.example_id)
    assert [got[k] for k in sorted(got)] == placed_by_definition(rows, limits, 64)


def test_conversations(spark, data, tokenizer):
    """Every conversation once, each limit kept and each one binding somewhere."""
    top = data.replace("0.001", "0.01")
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{top}/conversations.parquet").collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n * (r.role == "assistant")
    got = catalog.packing_conversations(spark, top).collect()
    assert {r.conv_id: [r.tokens, r.loss_tokens] for r in got} == want and len(got) == len(want)
    limits = catalog.CONVERSATION_LIMITS
    sequences = defaultdict(list)
    for r in got:
        if r.sequence_id is None:
            assert r.tokens > limits["max_tokens"] or r.loss_tokens > limits["max_loss"]
        else:
            sequences[r.sequence_id].append(r)
    bound = [0, 0, 0]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.tokens
        loss = sum(r.loss_tokens for r in own)
        assert at <= limits["max_tokens"] and len(own) <= limits["max_segments"] and loss <= limits["max_loss"]
        bound = [a or b for a, b in zip(bound, (at > 0.9 * limits["max_tokens"], len(own) == limits["max_segments"], loss > 0.9 * limits["max_loss"]))]
    assert all(bound)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, None, "text"), (None, 0, None, "text"), (2, 0, "assistant", "word " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    path = public_tokenizers.path(TOKENIZER_FILE)
    examples = packing.conversation_examples(df, path, public_tokenizers.PATTERN)
    assert sorted(map(tuple, examples.where("example_id is null or example_id = 1").collect()), key=str) == [(1, 2, 1), (None, 4, 0)]
    assert {r.example_id: r.sequence_id is None for r in packing.pack_examples(examples, **catalog.CONVERSATION_LIMITS).collect()} == {1: False, None: False, 2: True}
    assert packing.conversation_examples(df.where("false"), path, public_tokenizers.PATTERN).collect() == []
