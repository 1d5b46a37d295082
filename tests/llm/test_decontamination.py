import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from brute import contaminations, greedy_tiles
from logloom.llm import catalog, decontamination


def tiles(doc, item, width):
    """The operator's tiles of one document and one item, both lists of words."""
    index = decontamination.Index([(1, " ".join(item).encode())], width)
    return [x[3] for x in index.hits(" ".join(doc).encode(), decontamination._fold())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=16), st.integers(1, 5))
def test_tiles_are_those_of_the_definition(doc, item, width):
    want = greedy_tiles(doc, item, min(width, len(item)))
    assert tiles(doc, item, width) == ([want] if want else [])


def test_one_word_over_and_over():
    """The pairs of equal places are 60 million; their runs are few."""
    began = time.perf_counter()
    assert tiles(["a"] * 30_000, ["a"] * 2_000, 5) == [[(0, 0, 2000)]]
    assert tiles(["a", "b"] * 5_000, ["b", "a"] * 500, 5) == [[(1, 0, 1000)]]
    assert time.perf_counter() - began < 30


def test_reordered_passages_are_covered():
    rng = random.Random(3)
    for _ in range(30):
        item = [str(x) for x in rng.sample(range(100), 40)]
        cut = rng.randrange(8, 32)
        doc = [*map(str, range(200, 210)), *item[cut:], *map(str, range(300, 305)), *item[:cut]]
        assert sum(n for _, _, n in tiles(doc, item, 5)[0]) == 40


def test_query_equals_brute_force(spark, data):
    top = data.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{top}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    want = contaminations(docs, items)
    got = {(r.doc_id, r.item_id): r for r in catalog.op9_decontamination(spark, top).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for key, (n, made) in want.items():
        covered = sum(k for _, _, k in made)
        r = got[key]
        assert (r.item_words, r.covered_words, r.n_tiles, r.tiles) == (n, covered, len(made), " ".join(f"{i}:{j}:{k}" for i, j, k in made))
        assert r.contaminated == (covered >= 0.6 * n)


def test_planted_and_reordered_passages(spark):
    rng = random.Random(4)
    item = [f"item{i}" for i in range(30)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    docs = {
        1: noise(20) + item + noise(20),
        2: noise(5) + item[15:] + noise(9) + item[:15],
        3: noise(5) + item[:10] + noise(30),
        4: noise(50),
        5: [w.upper() + "," for w in item],
    }
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "two words"), (9, None)], "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.covered_words, r.n_tiles) for r in decontamination.find_matches(d, b).collect()}
    assert found == {1: (7, 30, 1), 2: (7, 30, 2), 3: (7, 10, 1), 5: (7, 30, 1)}
    assert sorted(r.doc_id for r in decontamination.remove_contaminated(d, b).collect()) == [3, 4]
    assert sorted(r.doc_id for r in decontamination.remove_contaminated(d, b, block_bytes=1).collect()) == [3, 4]
    short = spark.createDataFrame([(1, "these two words here"), (2, "two other words")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.find_matches(short, b).collect()] == [(1, 8)]


def test_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "words again and again in one short text"), (None, "été naïve"), (2, ""), (3, None)], "item_id long, text string")
    found = decontamination.find_matches(odd, b).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in found) == [(3, "1"), (4, "1"), (4, "1"), (8, "None")]
    left = decontamination.remove_contaminated(odd, b)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "None", "5", "6", "7"])
    assert decontamination.find_matches(empty, b).collect() == []
    assert decontamination.find_matches(odd, b.where("false")).collect() == []
    assert decontamination.remove_contaminated(odd, b.where("false")).count() == odd.count()
