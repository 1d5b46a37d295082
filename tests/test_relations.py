"""Metrics, hosts, tags, edits, search, the store and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom import config, methods
from logloom.operators import anonymize, edit, evaluate, generate, hosts, ids, search, stats, tags
from logloom.sources.formats import log_format
from logloom.sources.parse import read_log
from logloom.store import LogStore
from logloom.streaming import online


def labels(spark, true, pred):
    rows = [(i, t, ["x"], p, ["x"]) for i, (t, p) in enumerate(zip(true, pred, strict=True))]
    return spark.createDataFrame(rows, "line_no long, tid_true long, tpl_true array<string>, tid_pred long, tpl_pred array<string>")


# Worked by hand: of seven lines three and four belong together (3 + 6 = 9 pairs); the trial puts lines 0-1, 2-4 and 5-6 together (1 + 3 + 1
# = 5 pairs), of which 0-1, 3-4 and 5-6 are right, so precision is 3/5, recall 3/9 and F1 6/14.
@pytest.mark.parametrize(
    ("true", "pred", "prf"),
    [([4, 4, 4, 9, 9, 9, 9], [1, 1, 2, 2, 2, 3, 3], (3 / 5, 3 / 9, 6 / 14)), ([8, 8, 8, 5], [2, 2, 2, 7], (1, 1, 1)), ([3, 6, 9, 12], [1, 2, 4, 8], (0, 0, 0)), ([6, 6], [1, 2], (0, 0, 0))],
)
def test_precision(spark, true, pred, prf):
    r = evaluate.rand_scores(labels(spark, true, pred)).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx(prf)


def test_ratios(spark):
    """Of three answer clusters one is divided; of four trial clusters one holds lines of two."""
    score = lambda t, p: evaluate.cluster_scores(labels(spark, t, p)).first()
    r = score([1, 1, 1, 2, 2, 3], [7, 7, 8, 9, 9, 4])
    assert (r.over_division, r.over_aggregation, r.parsing_accuracy, r.cluster_accuracy) == pytest.approx((1 / 3, 0, 3 / 6, 2 / 3))
    r = score([1, 2, 3, 3, 4, 5], [7, 7, 8, 8, 9, 6])
    assert (r.over_division, r.over_aggregation, r.parsing_accuracy, r.cluster_accuracy) == pytest.approx((0, 1 / 4, 4 / 6, 3 / 5))


def test_pairs_leave_out_nulls_together(spark):
    make = lambda x: spark.createDataFrame([(i, t, ["x"]) for i, t in enumerate(x)], "lid long, tid long, tpl array<string>")
    got = evaluate.pair_labels(make([0, 0, 1, None, None]), make([0, None, 1, 1, 2])).collect()
    assert sorted((r.tid_true, r.tid_pred) for r in got) == [(0, 0), (1, 1)]


def test_label_texts(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "**"])], "w array<string>, t array<string>")
    text = evaluate.label_text(F.col("w"), F.col("t"))
    r = df.select(text.alias("l"), evaluate.from_label_text(F.col("w"), text).alias("t"), evaluate.from_label_text(F.col("w"), text, True).alias("m")).first()
    assert (r.l, r.t, r.m) == ("DV", ["a", "**"], ["a", "*b*"])


def test_parameter_search(spark):
    lines = spark.createDataFrame([(i, ["a", "b", str(i)] if i % 2 else ["a", "c", "d"]) for i in range(1, 9)], "lid long, words array<string>")
    answer = lines.select("lid", F.col("words")[1].alias("tid"), F.col("words").alias("tpl"))
    from logloom.operators.cluster import drain

    found = evaluate.search_parameters(lines, answer, drain, [{"threshold": 0.3}, {"threshold": 0.6}])
    assert found[0] == ({"threshold": 0.6}, 1.0)


HOSTS = ["hall1.row2.box3", "hall1.row2.box4", "hall1.row7.box1", "hall2.row2.box9", "hall2.row5.box6", "hall2.row5.box7"]
TIERS = [hosts.Tier("row", [{"pattern": r"^(hall\d+\.row\d+)"}]), hosts.Tier("hall", [{"pattern": r"^(hall\d+)"}])]


@pytest.fixture
def host_log(spark):
    start = datetime(2020, 1, 1)
    rows = [(i, 0, start + timedelta(minutes=i), h, ["node", str(i), "event"]) for i, h in enumerate(HOSTS)]
    return spark.createDataFrame(rows, "lid long, ltid long, dt timestamp_ntz, host string, words array<string>")


def test_host_groups(spark, host_log):
    hg = hosts.host_groups(stats.hosts(host_log), TIERS)
    summary = {(r.tier, r.hgid): (r.n_hosts, r.n_events) for r in stats.host_group_summary(host_log, hg).collect()}
    assert len([k for k in summary if k[0] == "row"]) == 4
    assert (summary["hall", "hall1"], summary["hall", "hall2"]) == ((3, 3), (3, 3))
    assert [r.lid for r in search.search(host_log, host_groups=hg, hg=("row", "hall1.row2"), order=True).collect()] == [0, 1]
    assert [r.lid for r in search.search(host_log, host_groups=hg, hg=("none", HOSTS[2])).collect()] == [2]
    x = spark.createDataFrame([("web7",), ("web8",), ("db8",)], "host string")
    made = hosts.host_groups(x, [hosts.Tier("fine", [{"pattern": "^([a-z]+)"}]), hosts.Tier("coarse", [{"pattern": r"(\d)$"}])])
    assert [(r.fine, r.n_coarse) for r in hosts.nesting_violations(made, "fine", "coarse").collect()] == [("web", 2)]
    kept = hosts.host_groups(spark.createDataFrame([("172.16.9.77",)], "host string"), [hosts.Tier("net", [{"pattern": r"^(\d+\.\d+)\.\d+\.\d+$", "replacement": r"\1.0.0/16"}])])
    assert kept.first().hgid == "172.16.0.0/16"


def test_host_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[edge]\n<edge> EDGE.archive.invalid edge-oob.archive.invalid\n[store]\n<disk> 172.16.4.2 # c\ntape\n[new]\n<six> fd00:aa::7\n[nets]\n<lab> 172.16.8.0/24\n")
    aliases = hosts.load_aliases(spark, str(tmp_path / "a.txt"))
    ask = ["edge.ARCHIVE.invalid", "FD00:00aa:0:0:0:0:0:7", "172.16.8.9", "172.16.8.0/24", "tape", "172.16.4.2"]
    got = {r.host: r.alias for r in hosts.resolve_aliases(spark.createDataFrame([(x,) for x in ask], "host string"), aliases).collect()}
    assert got == dict(zip(ask, ["edge", "six", None, "lab", "tape", "disk"], strict=True))
    (tmp_path / "g.ini").write_text("[general]\ntiers = m\nunmatched = drop\n[tier_m]\nschemes = r, ip\n[scheme_r]\npattern = ^(R\\d)\nignorecase = true\n[scheme_ip]\nkind = ipaddr\n")
    tiers = hosts.load_tiers(str(tmp_path / "g.ini"))
    made = hosts.host_groups(spark.createDataFrame([("r1x",), ("10.0.0.1",), ("zz",)], "host string"), tiers)
    assert {r.host: r.hgid for r in made.collect()} == {"r1x": "r1", "10.0.0.1": "10.0.0.1"}
    assert [r.host for r in hosts.unmatched_hosts(spark.createDataFrame([("zz",), ("r1",)], "host string"), tiers[0]).collect()] == ["zz"]


def test_tags(spark, tmp_path):
    (tmp_path / "t.ini").write_text("[group_mgmt]\nmembers = user\n[label_boot]\nrules = i_down\ni_down = ^.*shutdown.*$\n[label_user]\nrules = c_su\nc_su = su$\n[label_rot]\nrules = c_r\nc_r = ^last$, ^message$\n")
    rules = tags.TagRules.load(str(tmp_path / "t.ini"))
    lt = spark.createDataFrame([(0, ["System", "SHUTDOWN"]), (1, ["su", "x"]), (2, ["last", "message"]), (3, ["last"])], "ltid long, ltw array<string>")
    assert {(r.ltid, r.tag) for r in tags.tag_templates(lt, rules, "label").collect()} == {(0, "boot"), (1, "user"), (2, "rot")}
    assert {(r.ltid, r.tag) for r in tags.tag_templates(lt, rules, "all").collect()} == {(0, "label_boot"), (1, "label_user"), (1, "group_mgmt"), (2, "label_rot")}
    assert tags.tag_templates(lt, None).isEmpty()


def test_edits_reject_what_cannot_be(spark, host_log):
    lt = spark.createDataFrame([(0, ["a"], None, 1), (1, ["a", "b"], None, 1)], "ltid long, ltw array<string>, lts array<string>, count long")
    with pytest.raises(ValueError, match="length"):
        edit.merge(host_log, lt, 0, 1)
    with pytest.raises(ValueError, match="condition"):
        edit.update_lines(host_log, None, ltid=1)
    with pytest.raises(ValueError, match="condition"):
        search.search(host_log)
    with pytest.raises(LookupError):
        search.line(host_log, 99)
    with pytest.raises(ValueError, match="unknown condition"):
        search.parse_conditions(["nothing=1"])


def test_anonymous_names_are_padded(spark):
    log = spark.createDataFrame([(i, f"h{i:02d}") for i in range(12)], "lid long, host string")
    assert {r.host: r.anonymous for r in anonymize.host_mapping(log).collect()} == {f"h{i:02d}": f"host{i:02d}" for i in range(12)}


def test_store(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"2112-09-0{1 + i // 4} 00:00:0{i % 4} h{i % 2} Interface eth{i} went down\n" for i in range(8)))
    lines, _ = read_log(spark, [str(tmp_path / "x.log")], log_format("syslog"))
    conf = config.open_config()
    store = LogStore(spark, str(tmp_path / "store"), "reset")
    for _ in range(2):
        made = methods.generator(spark, conf, "drain")(lines)
        store.add_lines(made, "key", "tpl")
    log, lt = store.table("log"), store.table("lt")
    assert sorted(r.lid for r in log.collect()) == list(range(1, 17))
    assert [(r.ltid, r.ltw, r["count"]) for r in lt.collect()] == [(0, ["Interface", "**", "went", "down"], 16)]
    assert stats.line_count(log).first().last_lid == 16
    store.export_days(str(tmp_path / "days"))
    days = spark.read.text(str(tmp_path / "days"))
    assert days.where("day = 21120902").count() == 8
    assert days.where("value = '2112-09-01 00:00:00 h0 Interface eth0 went down'").count() == 2
    (tmp_path / "store" / "_left").mkdir()
    import shutil

    shutil.rmtree(tmp_path / "store" / "hg")
    assert LogStore(spark, str(tmp_path / "store"), "append").repair() == []
    assert not (tmp_path / "store" / "_left").exists()
    hg = hosts.host_groups(stats.hosts(log), TIERS[:1])
    store.replace("hg", hg)
    store.reset_tier("row", hg)
    assert store.table("hg").count() == 2
    with pytest.raises(FileNotFoundError):
        LogStore(spark, str(tmp_path / "nothing"), "read")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_prune_and_push_down(spark, tmp_path):
    rows = [(i, i % 3, datetime(2020, 1, 1 + i % 9, 5), f"h{i % 4}", ["a", str(i)]) for i in range(90)]
    log = spark.createDataFrame(rows, "lid long, ltid long, dt timestamp_ntz, host string, words array<string>")
    store = LogStore(spark, str(tmp_path / "s"), "reset")
    store.append("log", log)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = search.search(store.table("log"), dts="2020-01-03", dte="2020-01-05 06:00:00", host="h1").select("lid")
    text = plan_of(found)
    assert "day" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(host,h1)" in text and "GreaterThanOrEqual(dt," in text
    assert "words" not in text.split("ReadSchema: ")[1]
    want = [r[0] for r in rows if datetime(2020, 1, 3) <= r[2] < datetime(2020, 1, 5, 6) and r[3] == "h1"]
    assert sorted(r.lid for r in found.collect()) == want
    assert sorted(r.lid for r in search.search(store.table("log"), date="2020-01-04").collect()) == [r[0] for r in rows if r[2].day == 4]
    semi = search.search(store.table("log"), groups=spark.createDataFrame([(1, 7)], "ltid long, ltgid long"), ltgid=7)
    assert "LeftSemi" in plan_of(semi)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.log").write_text("".join(f"2112-09-01 00:00:{i:02d} h Interface eth{i} went {['down', 'up'][i % 2]}\n" for i in range(k * 10, k * 10 + 10)))
    stream = online.stream_lines(spark, str(source), log_format("syslog"), 1)
    at = F.concat(F.col("file"), F.lit("/"), F.date_format("dt", "ss"))
    query = online.drain_stream(stream.withColumn("at", at)).writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("mined")
    assert got.count() == 30
    assert got.select("cid").distinct().count() == 1
    assert got.agg(F.max_by("tpl", "at")).first()[0] == ["Interface", "**", "went", "**"]

    store = LogStore(spark, str(tmp_path / "store"), "reset")
    online.ingest(stream, store, generate.by_rules, str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(r.lid for r in store.table("log").collect()) == list(range(1, 31))


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "a.log").write_text("2112-09-01 00:00:01 h a b\n2112-09-01 01:30:00 h a b\n2112-09-01 05:00:00 h a b\n")
    stream = online.stream_lines(spark, str(tmp_path), log_format("syslog"))
    q = online.counts_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] >= 2


def test_config(tmp_path):
    (tmp_path / "base.ini").write_text("[drain]\nthreshold = 0.5\ndepth = 4\n")
    (tmp_path / "own.ini").write_text("[general]\nimport = base.ini\n[drain]\ndepth = 5\n")
    conf = config.open_config(str(tmp_path / "own.ini"))
    assert (conf.getfloat("drain", "threshold"), conf.getint("drain", "depth"), conf.get("va", "method")) == (0.5, 5, "relative-variable")
    assert config.minimum(conf).get("drain", "depth") == "5"
    (tmp_path / "base.ini").write_text("[general]\nimport = own.ini\n")
    with pytest.raises(ValueError, match="itself"):
        config.open_config(str(tmp_path / "own.ini"))
    (tmp_path / "g").write_text("[a]\nx\ny # c\n[b]\nz\n")
    assert config.load_groups(str(tmp_path / "g")) == {"a": ["x", "y"], "b": ["z"]}


def test_modes():
    assert methods.mode_of(["drain"]) == "online"
    assert methods.mode_of(["re", "va"]) == "offline"


def test_append_doubles(spark, host_log):
    both = ids.append(host_log, host_log.withColumn("lid", F.col("lid") + 1))
    assert sorted(r.lid for r in both.collect()) == list(range(2 * len(HOSTS)))


def test_tables_of_a_database(spark):
    """Words go into an SQL database and come back, escapes and separators among them."""
    from logloom.store import jdbc_table, write_jdbc

    url = "jdbc:derby:memory:logloom;create=true"
    rows = [(1, ["a", "\\@\\@", "**"], ["", " ", "", "!"], 3), (2, ["one"], None, 1)]
    lt = spark.createDataFrame(rows, "ltid long, ltw array<string>, lts array<string>, n long")
    try:
        write_jdbc(lt, url, "lt")
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no database driver here")
        raise
    got = jdbc_table(spark, url, "lt").orderBy("ltid").collect()
    assert [(r.ltid, r.ltw, r.n) for r in got] == [(r[0], r[1], r[3]) for r in rows]
    assert got[0].lts == rows[0][2] and got[1].lts is None
