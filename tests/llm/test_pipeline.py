import re
import zlib
from collections import Counter

import brute
import public_tokenizers
import pytest
from test_packing import check
from test_pii import by_hand
from test_quality import verdicts
from test_similar_pairs import by_brute_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from logloom.llm import packing, pii  # noqa: E402


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "packing"]


def test_stages_against_brute_force(spark, data):
    """Each stage keeps the columns, and what it drops and changes is what plain Python over the rows before it finds."""
    top = data.replace("0.001", "0.01")
    docs = first = spark.read.parquet(f"{top}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        before = {r.doc_id: r.text for r in rows}
        docs = stage(spark, docs, top).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == first.columns
        if name == "quality rules":
            kept, _ = verdicts([(r.doc_id, r.text, r.lang, r.source) for r in rows])
            assert set(after) == {i for i, k in kept.items() if k}
        elif name == "near duplicates":
            assert set(after) == set(by_brute_force(before).values())
        elif name == "benchmark decontamination":
            found = brute.contaminations(before.items(), benchmark)
            bad = {i for (i, _), (n, made) in found.items() if sum(k for _, _, k in made) >= 0.6 * n}
            assert set(after) == set(before) - bad
        elif name == "personal data":
            assert set(after) == set(before)
            pattern = re.compile(pii.PATTERN, re.ASCII)
            for i, text in before.items():
                if not pattern.search(text):
                    assert after[i] == text
                elif all(by_hand(m[0]) is not None for m in pattern.finditer(text)):
                    assert after[i] == pattern.sub(lambda m: by_hand(m[0]), text)
        if name != "personal data":
            assert all(after[i] == before[i] for i in after)
        assert 0 < len(after) <= len(before)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 0] for i, text in after.items()}
    total, padding = check(corpus_pipeline.STAGES[-1][1](spark, docs, top).collect(), ids, (1024, 256, 1024))
    assert total == sum(map(len, ids.values())) and padding <= 0.01 * total


def test_run_packs_every_token_of_what_is_left(spark, data):
    pieces = corpus_pipeline.run(spark, data).collect()
    assert pieces
    lengths, totals = Counter(), {}
    for p in pieces:
        lengths[p.doc_id] += p.length
        totals[p.doc_id] = p.doc_tokens
    assert lengths == totals
    assert packing.PIECES.count(",") + 1 == len(pieces[0])
    assert all(0 <= p.ids_crc32 <= 0xFFFFFFFF for p in pieces) and zlib.crc32(b"") == 0


def test_stages_on_odd_rows(spark, odd, empty, data):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, data).columns == odd.columns
        assert stage(spark, empty, data).collect() == []
        assert stage(spark, odd, data).count() <= odd.count()
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, empty, data).collect() == []
    assert {p.doc_id for p in packed(spark, odd, data).collect()} == {r.doc_id for r in odd.collect()}
