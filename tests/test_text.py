"""Word and template expressions against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.functions import variables as V
from logloom.operators.cluster import edit_distance


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_escape_round_trip(spark):
    words = ["a", "**", "@@x", "\\", "a\\*b@", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.escape(F.col("w")).alias("e"))
    got = rows.select("w", "e", T.unescape(F.col("e")).alias("u")).collect()
    for r in got:
        assert r.e == re.sub(r"([\\*@])", r"\\\1", r.w)
        assert r.u == r.w


@pytest.mark.parametrize(("text", "parts"), [("", []), ("a", ["a"]), ("a@@b", ["a", "b"]), ("a\\@\\@b@@c", ["a\\@\\@b", "c"])])
def test_split_unescaped(spark, text, parts):
    assert one(spark, "t string", (text,), T.split_unescaped(F.col("t")).alias("p")).p == parts


def test_variables_and_restoring(spark):
    row = (["login", "bob", "from", "h\\*1"], ["login", "**", "from", "**"], ["<", " ", " ", "=", ">"])
    schema = "w array<string>, t array<string>, s array<string>"
    got = one(
        spark, schema, row,
        T.variables(F.col("w"), F.col("t")).alias("v"), T.variable_places(F.col("t")).alias("p"), T.description(F.col("t")).alias("d"),
        T.restore_message(F.col("w"), F.col("s")).alias("m"), T.literal_bits(F.col("t")).alias("b"), T.matches_template(F.col("w"), F.col("t")).alias("ok"),
    )
    assert (got.v, got.p, got.d, got.m, got.b, got.ok) == (["bob", "h\\*1"], [1, 3], ["login", "from"], "<login bob from=h*1>", "1010", True)
    assert one(spark, schema, ([], ["a", "**"], None), T.variables(F.col("w"), F.col("t")).alias("v")).v == ["**"]


def test_merged_template_needs_equal_length(spark):
    schema = "a array<string>, b array<string>"
    merge = T.merge_templates(F.col("a"), F.col("b")).alias("m")
    assert one(spark, schema, (["a", "b"], ["a", "c"]), merge).m == ["a", "**"]
    assert one(spark, schema, (["a"], ["a", "c"]), merge).m is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c", "**"]), max_size=6), st.lists(st.sampled_from(["a", "b", "**"]), max_size=6)), min_size=1, max_size=8))
def test_edit_distance(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in df.select("a", "b", T.word_edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == edit_distance(r.a, r.b)


def test_variable_labels(spark):
    rules = V.VariableRules(["ipaddr", "host"], {"digit": r"\d+$", "path": r"/[0-9a-z_]+/[0-9a-z/_]+$", "ifname": r"eth\d+$"}, ["h1"])
    words = {"192.168.1.1": "ipaddr", "eth0": "ifname", "12345": "digit", "spam": "unknown", "/a/b": "path", "2001:db8::1": "ipaddr", "256.1.1.1": "unknown", "H1": "host", "xeth0": "unknown"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", rules.label(F.col("w")).alias("l"), rules.match(F.col("w")).alias("m"))
    assert {r.w: r.l for r in df.collect()} == words
    assert all(r.m == (r.l != "unknown") for r in df.collect())


def test_typed_variables(spark):
    rules = V.VariableRules(["ipaddr"], {"ifname": r"eth\d+$"})
    rows = [(["connect", "to", w], ["connect", "to", "**"]) for w in ("192.168.1.1", "eth0", "spam")]
    got = spark.createDataFrame(rows, "w array<string>, t array<string>").select(V.label_variables(F.col("w"), F.col("t"), rules).alias("l")).collect()
    assert [r.l[2] for r in got] == ["*ipaddr*", "*ifname*", "**"]


def test_canonical_ip(spark):
    import ipaddress

    given_ = ["10.0.0.5", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8::1", "::1", "::", "fe80::1:0:0:2", "1:0:0:2:0:0:0:3", "1::", "no", "1.2.3"]
    df = spark.createDataFrame([(x,) for x in given_], "x string").select("x", V.canonical_ip(F.col("x")).alias("c"))
    for r in df.collect():
        try:
            want = str(ipaddress.ip_address(r.x))
        except ValueError:
            want = None
        assert r.c == want, r


def test_durations():
    for text in ("30s", "5m", "2h", "3d", "1w"):
        assert V.format_duration(V.parse_duration(text)) == text
    with pytest.raises(ValueError, match="not a duration"):
        V.parse_duration("5y")


def test_networks(spark):
    from logloom.functions import variables as V

    words = {"10.0.0.0/8": True, "10.0.0.0/33": False, "2001:db8::/32": True, "fd00::1/129": False, "::/0": True, "fd00::1": False, "x/8": False}
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", V.is_network(F.col("w")).alias("n")).collect()}
    assert got == words
