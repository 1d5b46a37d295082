"""From generated files to templates and back, by the command line; and the catalog against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from logloom import cli
from logloom.plans import catalog
from logloom.sources.generator import EXAMPLE_TEMPLATES, example
from logloom.store import LogStore

SQL = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    top = tmp_path_factory.mktemp("site")
    lines = example().lines()
    (top / "a.log").write_text("\n".join(lines[: len(lines) // 2]) + "\n")
    (top / "b.log").write_text("\n".join(lines[len(lines) // 2 :]) + "\n")
    (top / "answer.tpl").write_text("\n".join(EXAMPLE_TEMPLATES) + "\n")
    return top, lines


def config(top, methods):
    path = top / f"{methods.replace(',', '-')}.ini"
    path.write_text(f"[store]\npath = {top}/store-{methods}\n[generate]\nmethods = {methods}\n[import]\ndefinitions = {top}/answer.tpl\n")
    return str(path)


@pytest.mark.parametrize(("method", "least", "most"), [("import", 6, 6), ("drain", 4, 19), ("lenma", 4, 19), ("va", 4, 19), ("shiso", 4, 19), ("dlog", 4, 299), ("fttree", 4, 49), ("re", 4, 9999), ("import,drain", 6, 19)])
def test_templates_of_the_site(spark, site, method, least, most):
    top, lines = site
    conf = config(top, method)
    files = [str(top / "a.log"), str(top / "b.log")]
    cli.main(["db-make", *files, "-c", conf])
    store = LogStore(spark, f"{top}/store-{method}", "read")
    assert store.table("log").count() == len(lines)
    n = store.table("lt").count()
    assert least <= n <= most
    if method == "drain":
        cli.main(["db-add", *files, "-c", conf])
        assert store.table("log").count() == 2 * len(lines)
        assert LogStore(spark, f"{top}/store-{method}", "read").table("lt").count() == n


def test_commands_run(spark, site, capsys):
    top, _ = site
    conf = config(top, "import")
    files = [str(top / "a.log")]
    cli.main(["db-make", *files, "-c", conf])
    for command in (["db-remake-group"], ["db-tag"], ["show-db-info"], ["show-lt"], ["show-ltg"], ["show-tag"], ["show-tag-stats"], ["show-line", "--lid", "5"], ["show-host"], ["show-lt-words"], ["show-lt-variable", "-d"], ["show-lt-breakdown", "--ltid", "1"],
                    ["show-lt-positions"], ["show-log", "-w", "host_like=front%", "-n", "3"], ["show-algorithms"], ["conf-defaults"], ["conf-minimum"], ["lt-merge-dup", "-f"], ["db-repair"],
                    ["show-lt-import", "-o", f"{top}/out"], ["show-lt-import", "-e", "-o", f"{top}/out-e"], ["data-from-db", "-o", f"{top}/days"], ["db-anonymize", "-o", f"{top}/map"]):
        cli.main([*command, "-c", conf])
    cli.main(["show-accuracy", *files, "-c", conf, "--answer", f"{top}/answer.tpl", "--failures"])
    assert "1.0" in capsys.readouterr().out
    log = LogStore(spark, f"{top}/store-import", "read").table("log")
    assert log.where("host not like 'host%'").isEmpty()
    cli.main(["db-restore", "-c", conf, "-o", f"{top}/map"])
    back = LogStore(spark, f"{top}/store-import", "read")
    assert {" ".join(r.ltw) for r in back.table("lt").collect()} <= set(EXAMPLE_TEMPLATES)
    assert back.table("log").where("host like 'host%' or array_contains(words, '##')").isEmpty()
    cli.main(["db-anonymize", "-c", conf, "-o", f"{top}/map2", "--to", f"{top}/other"])
    other = LogStore(spark, f"{top}/other", "read").table("log")
    assert other.count() == back.table("log").count() and other.where("host not like 'host%'").isEmpty()
    assert LogStore(spark, f"{top}/store-import", "read").table("log").where("host like 'host%'").isEmpty()
    assert Path(f"{top}/days").exists()


def test_evaluation_commands(spark, site, capsys):
    top, lines = site
    (top / "few.log").write_text("\n".join(lines[:300]) + "\n")
    conf = config(top, "drain")
    files = [str(top / "few.log"), "-c", conf, "--answer", f"{top}/answer.tpl"]
    for command in (["measure-accuracy-offline", "-n", "2"], ["show-measured"], ["measure-accuracy-online", "-n", "1"], ["search-fail"], ["measure-time-offline", "-n", "1"], ["search-diff", "--other-config", config(top, "re")]):
        cli.main([command[0], *files, *command[1:], "-o", f"{top}/measured"])
    out = capsys.readouterr().out
    assert "trial" in out and "mean" in out
    cli.main(["db-make", str(top / "few.log"), "-c", config(top, "import")])
    cli.main(["make-crf-model", "-c", config(top, "import"), "-o", f"{top}/model"])
    (top / "crf.ini").write_text(f"[store]\npath = {top}/store-crf\n[generate]\nmethods = crf\n[crf]\nmodel = {top}/model\n")
    cli.main(["db-make", str(top / "few.log"), "-c", str(top / "crf.ini")])
    assert LogStore(spark, f"{top}/store-crf", "read").table("log").count() == 300
    cli.main(["conf-shadow", "-c", conf, "-o", f"{top}/shadow.ini"])
    (top / "groups").write_text(f"[all]\n{top}/shadow.ini\n")
    cli.main(["conf-group-edit", f"{top}/groups", "all", "drain", "depth", "5"])
    cli.main(["conf-minimum", "-c", f"{top}/shadow.ini"])
    assert "depth = 5" in capsys.readouterr().out
    both = top / "both.ini"
    both.write_text(f"[store]\npath = {top}/store-both\n[generate]\nmethods = import, drain\nfeedback = true\n[import]\ndefinitions = {top}/answer.tpl\n")
    cli.main(["db-make", str(top / "few.log"), "-c", str(both)])
    assert LogStore(spark, f"{top}/store-both", "read").table("log").count() == 300


def _norm(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, data, name):
    made = catalog.QUERIES[name](spark, data)
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(made.columns)
    rows = sorted(tuple(_norm(r[n]) for n in names) for r in made.collect())
    assert rows == sorted(tuple(map(_norm, r)) for r in want.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
