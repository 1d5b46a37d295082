import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import catalog, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "\u00e9#", "c\n", "\x0b", "|"]), max_size=60), st.sampled_from([" ", "\n", "\t"]))
def test_base_statistics(parts, separator):
    text = separator.join(parts)
    assert quality.text_statistics(text.encode())[:5] == base(text)


def test_query_has_the_base_of_every_document(spark, data, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = catalog.op4_quality_rules(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, chars, symbols, dup, repeat = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_labels(spark, data):
    got = catalog.op4_quality_rules(spark, data.replace("0.001", "0.01")).join(spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet"), "doc_id")
    clean = got.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() <= 0.01 * clean.count()
    junk = got.where("quality = 0")
    assert junk.where("kept").count() <= 0.1 * junk.count()


def verdicts(rows, spread=quality.SPREAD, least=quality.LEAST_GROUP, least_spread=quality.LEAST_SPREAD):
    """kept of (id, text, lang, source), from sorted lists of all values of a group."""
    stats = {}
    for i, text, lang, source in rows:
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        n, _, symbols, dup, repeat = base(text)
        upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
        counts = [
            (upper, upper + lower), (symbols, n), (dup, len(lines)), (sum(a == b for a, b in zip(words, words[1:])), n),
            (words.count("|"), n), (sum(w.endswith("!!") for w in words), n),
        ]
        stats[i] = (lang, source, n < 20 or 100 * repeat > 30 * n, [math.log((c + 0.5) / (max(0, t - c) + 0.5)) for c, t in counts])

    def fence(values):
        cells = sorted(math.floor(v / quality.CELL) for v in values)
        q1, q2, q3 = ((cells[math.ceil(p * len(cells)) - 1] + 0.5) * quality.CELL for p in (0.25, 0.5, 0.75))
        assert all(abs(q - sorted(values)[math.ceil(p * len(values)) - 1]) <= quality.CELL for q, p in ((q1, 0.25), (q3, 0.75)))
        return q2, q3 + spread * max(q3 - q1, least_spread)

    passed = [x for x in stats.values() if not x[2]]
    fences = {}
    for lang, source in {x[:2] for x in passed}:
        for k in range(6):
            own, wide, whole = ([x[3][k] for x in passed if test(x)] for test in (lambda x: x[:2] == (lang, source), lambda x: x[0] == lang, lambda x: True))
            limit = fence(wide)[1] if len(wide) >= least else fence(whole)[1]
            middle, mine = fence(own)
            fences[lang, source, k] = mine if len(own) >= least and middle <= limit else limit
    return {i: not bad and all(x <= fences[lang, source, k] for k, x in enumerate(own)) for i, (lang, source, bad, own) in stats.items()}, fences


def test_kept_equals_verdicts_by_sorted_lists(spark, data):
    top = data.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{top}/documents.parquet").collect()]
    want, fences = verdicts(rows)
    assert {r.doc_id: r.kept for r in catalog.op4_quality_rules(spark, top).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_fences_differ_by_group_and_follow_its_documents(spark):
    """A source that writes with many symbols keeps its documents; one such document among plain ones goes."""
    plain = " ".join(f"word{k}" for k in range(60))
    marked = lambda k: " ".join(f"#w{j}" if j < k else f"w{j}" for j in range(60))
    rows = [(i, f"{plain} {i} " + "#x " * (1 + (i % 3 == 0)), "en", "plain") for i in range(100)] + [(100 + i, f"{marked(20 + i % 21)} {i}", "en", "code") for i in range(80)]
    rows += [(500, marked(30), "en", "plain"), (501, marked(30), "en", "code")]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.filter_documents(frame(rows)).collect()}
    want, _ = verdicts(rows)
    assert kept == {i for i, k in want.items() if k}
    assert 501 in kept and 500 not in kept
    shifted = [(i, t if s == "code" else f"{marked(20 + i % 21)} {i}", lang, s) for i, t, lang, s in rows]
    assert 500 in {r.doc_id for r in quality.filter_documents(frame(shifted)).collect()}


def test_a_source_of_junk_is_judged_by_its_language(spark):
    good = [(i, f"{i} " + " ".join(f"word{k}" for k in range(50 + i % 30)), "en", f"s{i % 4}") for i in range(400)]
    junk = [(1000 + i, f"{i} " + " ".join("| *** |" + str(k) for k in range(30)), "en", "junk") for i in range(60)]
    kept = {r.doc_id for r in quality.filter_documents(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {r[0] for r in good}


def test_odd_rows(odd, empty):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 4]
    assert quality.filter_documents(empty).collect() == []
    assert quality.judge(odd).count() == odd.count()
