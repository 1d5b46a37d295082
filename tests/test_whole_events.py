"""labelled_variables and edit_fix over the whole event log, users of one digit and all hosts included."""

import duckdb
import pytest

from logloom.plans import catalog

LABEL = "CASE WHEN len({0}) = 1 THEN '*digit*' ELSE '*number*' END"


def sql(data, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}'")
    return sorted(con.execute(f"WITH {catalog.EV} {query}").fetchall())


@pytest.fixture(scope="module")
def one_user(spark, tmp_path_factory):
    """Events of two types; those of the second have one user only, the first's users are many."""
    top = tmp_path_factory.mktemp("events")
    rows = [(i, "b" if i % 3 == 1 else "a", 7 if i % 3 == 1 else i, i * 1.5, '{"k": %d}' % i) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, props string")
    df.selectExpr("event_id", "timestamp'2024-01-01 00:00:00' ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{top}/events.parquet")
    return str(top)


def test_labels_of_every_line(spark, data):
    want = sql(f"{data}/events.parquet", "SELECT lid, w[1] || ' user ' || " + LABEL.format("w[3]") + " || ' value ' || " + LABEL.format("w[5]") + " || ' k ' || " + LABEL.format("w[7]") + " AS tpl FROM log")
    assert sorted((r.lid, r.tpl) for r in catalog.labelled_variables(spark, data).collect()) == want
    assert any(" user *digit* " in t for _, t in want)


def test_fix_looks_at_the_whole_log(spark, data):
    want = sql(f"{data}/events.parquet", "SELECT ltid, array_to_string(tpl, ' ') AS tpl, c AS n FROM lt")
    assert sorted((r.ltid, r.tpl, r.n) for r in catalog.edit_fix(spark, data).collect()) == want  # its users are many


def test_fix_of_a_variable_with_one_value(spark, one_user):
    got = {r.ltid: (r.tpl, r.n) for r in catalog.edit_fix(spark, one_user).collect()}
    assert got == {0: ("a user ** value ** k **", 40), 1: ("b user 7 value ** k **", 20)}
