"""Queries over documents against DuckDB, on lines of any length."""

import random

import duckdb
import pytest

from logloom.plans import catalog
from logloom.operators import cluster
from logloom.sources.views import document_log

from reference_miners import merged_prefixes

NAMES = sorted(n for n, sql in catalog.ORACLES.items() if "log_doc" in sql)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Lines of 1 to 120 words: copies, shared beginnings, words changed in the middle and numbers."""
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "up", "down", "x*", "m@", "back\\slash", str(rng.randrange(99))])
    base = [[word() for _ in range(n)] for n in (3, 12, 41, 60, 120)]
    lines = []
    for _ in range(80):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = word()
        lines.append(" ".join(own[: rng.choice([len(own), len(own), rng.randrange(1, len(own) + 1)])]))
    top = tmp_path_factory.mktemp("texts")
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4]) + "\n", "en", f"s{i % 3}", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{top}/documents.parquet")
    return str(top), lines


def test_no_line_is_left_out(spark, texts):
    top, lines = texts
    got = [len(r.words) for r in document_log(spark, top).orderBy("lid").collect()]
    assert got == [len(x.split(" ")) for x in lines] and max(got) > 100


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_of_all_lines(spark, texts, name):
    top, _ = texts
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{top}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    made = catalog.QUERIES[name](spark, top)
    assert sorted(tuple(str(r[n]) for n in names) for r in made.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_prefix_counts_equal_an_independent_miner(spark, texts):
    lines = document_log(spark, texts[0])
    want = merged_prefixes([(r.lid, r.words) for r in lines.collect()])
    assert {r.lid: r.tpl for r in cluster.merged_prefixes(lines).collect()} == want
