"""A writer may die between any two steps: the store opens again with all of its work or none of it."""

from datetime import datetime

import pytest

from logloom.operators import generate
from logloom.sources.formats import log_format
from logloom.store import LogStore
from logloom.streaming import online


class Died(Exception):
    pass


def dying(monkeypatch, step):
    """Let the writer die before its ``step``-th move or removal."""
    count = iter(range(100))

    def after(f):
        def run(self, *args):
            if next(count) == step:
                raise Died
            return f(self, *args)

        return run

    for name in ("_move", "_delete"):
        monkeypatch.setattr(LogStore, name, after(getattr(LogStore, name)))


def lines(spark, first, words):
    rows = [(first + i, datetime(2020, 1, 1 + i % 2, 5), "h", w.split(), [""] * (len(w.split()) + 1), w.split()) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "lid long, dt timestamp_ntz, host string, words array<string>, symbols array<string>, tpl array<string>")


def state(store):
    counts = {r.ltid: r["count"] for r in store.table("lt").collect()}
    log = store.table("log").groupBy("ltid").count().collect()
    return store.table("log").count(), counts, {r.ltid: r["count"] for r in log}


@pytest.mark.parametrize("step", range(8))
def test_added_lines(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    store = LogStore(spark, path, "reset")
    store.add_lines(lines(spark, 1, ["a b", "a b", "c"]), batch_id=0)
    dying(monkeypatch, step)
    try:
        store.add_lines(lines(spark, 1, ["a b", "d e", "d e", "a b"]), batch_id=1)
    except Died:
        pass
    monkeypatch.undo()
    again = LogStore(spark, path)
    assert state(again) == (7, {0: 4, 1: 1, 2: 2}, {0: 4, 1: 1, 2: 2})  # all was written before the first move
    again.add_lines(lines(spark, 1, ["a b", "d e", "d e", "a b"]), batch_id=1)  # the stream's replay
    assert state(again)[0] == 7
    assert sorted(r.lid for r in again.table("log").collect()) == list(range(1, 8))
    assert not [x for x in again._names() if x.startswith("_")]


def test_unfinished_batches_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = LogStore(spark, path, "reset")
    store.add_lines(lines(spark, 1, ["a b"]), batch_id=0)
    monkeypatch.setattr(LogStore, "_move_in", lambda self, batch: (_ for _ in ()).throw(Died))
    with pytest.raises(Died):
        store.add_lines(lines(spark, 1, ["c"]), batch_id=1)
    monkeypatch.undo()
    batch = next(x for x in store._names() if x.startswith("_batch_"))
    store._delete(f"{batch}/_READY")  # as if it had died while writing
    again = LogStore(spark, path)
    assert state(again)[0] == 1 and not again.has_batch(1)
    again.add_lines(lines(spark, 1, ["c"]), batch_id=1)
    assert state(again) == (2, {0: 1, 1: 1}, {0: 1, 1: 1})


@pytest.mark.parametrize("step", range(4))
def test_replaced_tables(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    store = LogStore(spark, path, "reset")
    rows = lambda n: spark.createDataFrame([(i, n) for i in range(n)], "ltid long, ltgid long")
    store.replace("ltg", rows(2))
    dying(monkeypatch, step)
    try:
        store.replace("ltg", rows(5))
    except Died:
        pass
    monkeypatch.undo()
    assert LogStore(spark, path).table("ltg").count() == (2 if step == 0 else 5)
    store.repair()
    assert not [x for x in store._names() if x.startswith("_")]


def test_a_stream_that_dies_and_goes_on(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.log").write_text("".join(f"2112-09-01 00:00:{i:02d} h Interface eth{i} went up\n" for i in range(k * 10, k * 10 + 10)))
    path = str(tmp_path / "store")
    LogStore(spark, path, "reset")
    start = lambda: online.ingest(online.stream_lines(spark, str(source), log_format("syslog"), 1), LogStore(spark, path), generate.by_rules, str(tmp_path / "cp")).awaitTermination(120)
    for step in (1, 4):
        dying(monkeypatch, step)
        with pytest.raises(Exception):  # noqa: B017
            start()
        monkeypatch.undo()
    start()
    store = LogStore(spark, path, "read")
    assert sorted(r.lid for r in store.table("log").collect()) == list(range(1, 31))
    assert sum(r["count"] for r in store.table("lt").collect()) == 30
