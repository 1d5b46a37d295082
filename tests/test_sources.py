"""Headers, tokens, hosts, line numbers and files."""

import bz2
import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.sources.formats import FORMATS, log_format
from logloom.sources.parse import expand_paths, normalise_hosts, number_lines, parse_lines, read_definitions, read_log, rejects, tokens

LINES = {
    "syslog": ("2112-09-01 00:00:10 rt0 Interface eth1 went down", datetime(2112, 9, 1, 0, 0, 10), "rt0", ["Interface", "eth1", "went", "down"]),
    "Android": ("03-17 16:13:38.811  1702  2395 D WindowManager: a b=1", datetime(2020, 3, 17, 16, 13, 38), None, ["a", "b", "1"]),
    "Apache": ("[Sun Dec 04 04:47:44 2005] [error] mod_jk child", datetime(2005, 12, 4, 4, 47, 44), None, ["mod_jk", "child"]),
    "BGL": ("- 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50.363779 R02-M1-N0 RAS KERNEL INFO parity error", datetime(2005, 6, 3, 15, 42, 50), "R02-M1-N0", ["parity", "error"]),
    "HDFS": ("081109 203518 143 INFO dfs.DataNode$X: Receiving block", datetime(2008, 11, 9, 20, 35, 18), None, ["Receiving", "block"]),
    "HPC": ("134681 node-246 unix.hw state_change.unavailable 1077804742 1 Component up", datetime(2004, 2, 26, 14, 12, 22), None, ["Component", "up"]),
    "Hadoop": ("2015-10-18 18:01:47,978 INFO [main] org.apache.App: Created x", datetime(2015, 10, 18, 18, 1, 47), None, ["Created", "x"]),
    "Linux": ("Jun 14 15:16:01 combo sshd(pam_unix)[19939]: check pass", datetime(2020, 6, 14, 15, 16, 1), "combo", ["check", "pass"]),
    "Mac": ("Jul  1 09:00:55 calvisitor-10 kernel[0]: Thunderbolt on", datetime(2020, 7, 1, 9, 0, 55), "calvisitor-10", ["Thunderbolt", "on"]),
    "OpenSSH": ("Dec 10 06:55:46 LabSZ sshd[24200]: Invalid user web", datetime(2020, 12, 10, 6, 55, 46), "LabSZ", ["Invalid", "user", "web"]),
    "OpenStack": ("nova.log 2017-05-16 00:00:00.008 25746 INFO nova.api [req-38 x] GET done", datetime(2017, 5, 16, 0, 0, 0), "nova.api", ["GET", "done"]),
    "Proxifier": ("[10.30 16:49:06] chrome.exe - proxy open", datetime(2020, 10, 30, 16, 49, 6), None, ["proxy", "open"]),
    "Spark": ("17/06/09 20:10:40 INFO executor.Backend: Registered x", datetime(2017, 6, 9, 20, 10, 40), None, ["Registered", "x"]),
    "Thunderbird": ("- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam)[2915]: session closed", datetime(2005, 11, 9, 12, 1, 1), "dn228", ["session", "closed"]),
    "Windows": ("2016-09-28 04:30:30, Info                  CBS    Loaded stack", datetime(2016, 9, 28, 4, 30, 30), None, ["Loaded", "stack"]),
    "Zookeeper": ("2015-07-29 17:41:44,747 - INFO  [QuorumPeer[myid=1]/0:0:0] - Notification out", datetime(2015, 7, 29, 17, 41, 44), None, ["Notification", "out"]),
}


def test_every_format_has_a_case():
    assert set(LINES) == set(FORMATS)


@pytest.mark.parametrize("name", list(LINES))
def test_headers(spark, name):
    line, dt, host, words = LINES[name]
    got = parse_lines(spark.createDataFrame([(line,)], "value string"), log_format(name, 2020)).first()
    assert (got.dt, got.host, got.words) == (dt, host, words)


def test_tokens_keep_addresses_and_symbols(spark):
    text = "from 10.0.0.5:22 at 12:30:01 to [fe:80:00:aa:bb:cc] x=2001:db8::1, done"
    w, s = tokens(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(w.alias("w"), s.alias("s")).first()
    assert got.w == ["from", "10.0.0.5", "22", "at", "12:30:01", "to", "fe:80:00:aa:bb:cc", "x", "2001:db8::1", "done"]
    assert len(got.s) == len(got.w) + 1
    assert "".join(a + b for a, b in zip(got.s, [*got.w, ""], strict=True)) == text


def test_rejects_and_escapes(spark):
    lines = spark.createDataFrame([("garbage",), ("2020-01-01 00:00:00 h ***",), ("2020-01-01 00:00:00 h ",)], "value string")
    parsed = parse_lines(lines, log_format("syslog"))
    assert [r.words for r in parsed.where("words is not null").collect()] == [["\\*\\*\\*"]]
    assert sorted(r.value for r in rejects(parsed).collect()) == ["2020-01-01 00:00:00 h ", "garbage"]


def test_read_log_numbers_lines_in_file_order(spark, tmp_path):
    def line(i):
        return f"2020-01-01 00:00:{i:02d} h{i} message {i}\n"

    (tmp_path / "b.log").write_text("".join(line(i) for i in range(5, 9)))
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write("".join(line(i) for i in range(5)) + "broken\n")
    with bz2.open(tmp_path / "c.log.bz2", "wb") as f:
        f.write(line(9).encode() + b"2020-01-01 00:00:10 h10 bad\xff byte\n")
    paths = expand_paths([str(tmp_path)])
    lines, bad = read_log(spark, paths, log_format("syslog"), first_lid=1)
    got = lines.orderBy("lid").collect()
    assert [r.lid for r in got] == list(range(1, 12))
    assert [r.host for r in got] == [f"h{i}" for i in range(11)]
    assert got[-1].words == ["bad", "byte"]
    assert [r.value for r in bad.collect()] == ["broken"]


def test_recursive_paths(tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("d/x", "a", "d/b"):
        (tmp_path / n).write_text("")
    assert [p.removeprefix(str(tmp_path)) for p in expand_paths([str(tmp_path)])] == ["/a"]
    assert [p.removeprefix(str(tmp_path)) for p in expand_paths([str(tmp_path)], True)] == ["/a", "/d/b", "/d/x"]


def test_hosts(spark):
    aliases = spark.createDataFrame([("h1", "one")], "token string, alias string")
    rows = spark.createDataFrame([(1, "H1"), (2, "x"), (3, None)], "lid long, host string")
    assert [r.host for r in normalise_hosts(rows, aliases).orderBy("lid").collect()] == ["one", "x", "dummy"]
    assert [r.host for r in normalise_hosts(rows, aliases, drop_undefined=True).orderBy("lid").collect()] == ["one", "dummy"]


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("k", F.xxhash64("id"))
    for n in (1, 7):
        got = number_lines(df.repartition(n), F.floor(F.col("id") / 64), F.col("id"), start=10).orderBy("id").select("lid").collect()
        assert [r.lid for r in got] == list(range(10, 510))


def test_definitions(spark, tmp_path):
    (tmp_path / "d.tpl").write_text("a ** b\n\nc d\na ** b\n")
    assert [(r.defid, r.tpl) for r in read_definitions(spark, str(tmp_path / "d.tpl")).orderBy("defid").collect()] == [(0, ["a", "**", "b"]), (1, ["c", "d"])]


def test_paths_of_any_file_system(spark, tmp_path):
    for name in ("b.log", "a.log", "deep/c.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"2020-01-01 00:00:00 h {name[-5]} x\n2020-01-01 00:00:01 h {name[-5]} y\n")
    ends = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert ends(expand_paths([str(tmp_path)], spark=spark)) == ["a.log", "b.log"]
    assert ends(expand_paths([str(tmp_path)], True, spark)) == ["a.log", "b.log", "c.log"]
    assert ends(expand_paths([f"file://{tmp_path}/?.log", str(tmp_path / "deep" / "c.log")], spark=spark)) == ["a.log", "b.log", "c.log"]
    with pytest.raises(FileNotFoundError):
        expand_paths([str(tmp_path / "none")], spark=spark)
    lines, _ = read_log(spark, [str(tmp_path / "b.log"), *expand_paths([f"file://{tmp_path}/a.log"], spark=spark), str(tmp_path / "deep" / "c.log")], log_format("syslog"))
    assert [r.words for r in lines.orderBy("lid").collect()] == [[a, b] for a in "bac" for b in "xy"]
    assert read_log(spark, [], log_format("syslog"))[0].collect() == []


def test_one_file_in_many_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "long.log").write_text("".join(f"2020-01-01 00:00:00 h line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines, _ = read_log(spark, [str(tmp_path / "long.log")], log_format("syslog"))
        assert [int(r.words[1]) for r in lines.orderBy("lid").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_grammar_of_the_users_own(spark, tmp_path):
    (tmp_path / "own.py").write_text("PATTERNS = [r'(?P<date8>[0-9]{8})/(?P<time6>[0-9]{6}) (?P<host>[a-z]+) > (?P<statement>.*)']\n")
    got = parse_lines(spark.createDataFrame([("20310304/050607 box > a b",)], "value string"), log_format(str(tmp_path / "own.py"))).first()
    assert (got.dt, got.host, got.words) == (datetime(2031, 3, 4, 5, 6, 7), "box", ["a", "b"])
    (tmp_path / "none.py").write_text("x = 1\n")
    with pytest.raises(ValueError, match="PATTERNS"):
        log_format(str(tmp_path / "none.py"))
