"""Generators against plain Python and the fixtures of their rules."""

import random

import pytest
from pyspark.sql import functions as F

import reference_miners as ref
from logloom.functions.variables import VariableRules
from logloom.operators import cluster, crf, generate, grouping, ids
from logloom.sources.views import document_log


@pytest.fixture(scope="module")
def lines():
    """Log-like lines of a few templates with variables, in a fixed random order."""
    rng = random.Random(5)
    made = []
    for i in range(400):
        k = rng.randrange(6)
        a, b = rng.randrange(30), rng.choice(["eth0", "eth1", "lo", "wlan12"])
        made.append((i + 1, [
            ["Interface", b, "went", "down"], ["Interface", b, "came", "up", "after", str(a)], ["session", "opened", "for", f"user{a}"],
            ["Connection", "from", f"10.0.0.{a}", "port", str(a * 7)], ["System", "restart"], ["CRON", str(a), "root", "CMD", "run-parts", "--report", f"/etc/cron.{a}"],
        ][k]))
    return made


@pytest.fixture(scope="module")
def frame(spark, lines):
    return spark.createDataFrame(lines, "lid long, words array<string>").cache()


def clusters(df):
    rows = df.collect()
    final = {}
    for r in sorted(rows, key=lambda r: r.lid):
        final[r.cid] = r.tpl
    groups = {}
    for r in rows:
        groups.setdefault(r.cid, set()).add(r.lid)
    return {frozenset(v): final[k] for k, v in groups.items()}


def expected(member, templates):
    groups = {}
    for lid, c in member.items():
        groups.setdefault(c, set()).add(lid)
    return {frozenset(v): templates[c] for c, v in groups.items()}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_drain(frame, lines, threshold):
    assert clusters(cluster.drain(frame, threshold)) == expected(*ref.drain(lines, threshold))


def test_drain_on_documents_does_not_depend_on_partitions(spark, data):
    docs = document_log(spark, data).select("lid", "words").cache()
    want = expected(*ref.drain([(r.lid, r.words) for r in docs.orderBy("lid").collect()]))
    assert clusters(cluster.drain(docs)) == want
    assert clusters(cluster.drain(docs.repartition(13, F.xxhash64("lid")))) == want


def test_lenma(frame, lines):
    assert clusters(cluster.lenma(frame)) == expected(*ref.lenma(lines))


@pytest.mark.parametrize("miner", [cluster.drain, cluster.lenma])
def test_resumed_runs_equal_one_run(frame, miner):
    whole = {r.lid: (r.cid, r.tpl) for r in miner(frame).collect()}
    parts = [frame.where(F.col("lid") <= 150), frame.where((F.col("lid") > 150) & (F.col("lid") <= 300)), frame.where(F.col("lid") > 300)]
    got, state = {}, None
    for part in parts:
        mined = miner(part, state=state).cache()
        got |= {r.lid: (r.cid, r.tpl) for r in mined.collect()}
        state = cluster.cluster_state(part, mined, state).cache()
    assert got == whole


def test_lenma_scores():
    c = cluster.Lenma(evolve=True)
    c.add(["proc", "X", "Y"])
    assert c.score(0, ["proc", "X", "Y"]) == 1.0
    assert c.score(0, ["other", "X", "Y"]) == 0.0
    c.first[0] = ["proc", "X", "**"]
    assert c.score(0, ["proc", "X", "W"]) == 1.0


def test_shiso(frame, lines):
    miner, member = cluster.Shiso(), {}
    for lid, words in lines:
        member[lid], _ = miner.add(words)
    assert clusters(cluster.shiso(frame.repartition(5))) == expected(member, miner.templates)
    small = cluster.Shiso(vector=cluster.character_classes)
    assert [small.add(x.split())[0] for x in ("foo bar baz", "foo bar qux")] == [0, 0]


def test_frequent_tree(frame, lines):
    got = {r.lid: r.tpl for r in cluster.frequent_tree(frame, message_type="length").collect()}
    assert got == ref.frequent_tree(lines)


def test_merged_prefixes(spark, frame, lines, data):
    assert {r.lid: r.tpl for r in cluster.merged_prefixes(frame).collect()} == ref.merged_prefixes(lines)


@pytest.mark.parametrize("most", [0, None])
@pytest.mark.parametrize(("method", "threshold"), [("static", 1), ("relative-line", 0.5), ("relative-variable", 0.4)])
def test_frequency(spark, method, threshold, most):
    rows = [(1, "proc started ok".split()), (2, "proc started ok".split()), (3, "proc stopped err".split())]
    df = spark.createDataFrame(rows, "lid long, words array<string>")
    counts = {"proc": 3, "started": 2, "ok": 2, "stopped": 1, "err": 1}
    got = {r.lid: r.tpl for r in generate.by_frequency(df, method, threshold, most).collect()}
    for lid, words in rows:
        limit = {"static": lambda n: n > 1, "relative-line": lambda n: n > 1.5, "relative-variable": lambda n, w=words: n >= sorted(counts[x] for x in w)[1]}[method]
        assert got[lid] == [w if limit(counts[w]) else "**" for w in words]
    assert {r.word: (r.occurrences, r.n_lines) for r in generate.word_statistics(df).collect()} == {w: (n, 3) for w, n in counts.items()}


TEMPLATES = ["connect from ** port **", "connect to **", "** from ** port **", "disconnect **", "connect from localhost port 22"]
ANSWERS = {"connect from h1 port 22": 0, "connect from localhost port 22": 4, "connect to server": 1, "disconnect now": 3, "x from h1 port 22": 2, "no match here": None, "connect from h1 port": None}


def test_match_definitions(spark):
    defs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEMPLATES)], "defid long, tpl array<string>")
    lines = spark.createDataFrame([(i, q.split()) for i, q in enumerate(ANSWERS)], "lid long, words array<string>")
    got = {" ".join(r.words): r.defid for r in generate.match_definitions(lines, defs).collect()}
    assert got == ANSWERS
    first = {" ".join(r.words): r.defid for r in generate.match_definitions(lines, defs, "table").collect()}
    assert first["connect from localhost port 22"] == 0
    back = spark.createDataFrame([(1, ["**", "b"]), (2, ["a", "c"])], "defid long, tpl array<string>")
    one = spark.createDataFrame([(1, ["a", "b"])], "lid long, words array<string>")
    assert generate.match_definitions(one, back).first().defid == 1
    assert generate.match_definitions(one, generate.remove_definition(back, ["**", "b"])).first().defid is None
    assert generate.match_definitions(one, generate.add_definition(back, 9, ["a", "b"])).first().defid == 9


def test_external_templates(spark):
    df = spark.createDataFrame([(1, "open a.txt (12 bytes)", ["open", "a.txt", "12", "bytes"]), (2, "close x", ["close", "x"]), (3, "other", ["other"])], "lid long, statement string, words array<string>")
    got = {r.lid: r.tpl for r in generate.by_external(df, ["open <*> (<*> bytes)", "close <*>"]).collect()}
    assert got == {1: ["open", "**", "**", "bytes"], 2: ["close", "**"], 3: None}


def test_chain_takes_the_first(spark):
    df = spark.createDataFrame([(1, ["a", "1"]), (2, ["b", "2"])], "lid long, words array<string>")
    defs = spark.createDataFrame([(0, ["a", "**"])], "defid long, tpl array<string>")
    made = generate.chain(df, lambda x: generate.match_definitions(x, defs), lambda x: generate.by_rules(x, VariableRules()))
    assert [(r.lid, r.method, r.tpl) for r in made.orderBy("lid").collect()] == [(1, 0, ["a", "**"]), (2, 1, ["b", "2"])]


def test_common_template(spark):
    cases = [([["a", "b", "c"], ["a", "x", "c"]], ["a", "**", "c"]), ([["**", "b"], ["a", "b"]], ["a", "b"]), ([["**", "x"], ["**", "x"]], ["**", "x"])]
    rows = [(i, w) for i, (words, _) in enumerate(cases) for w in words]
    got = {r.ltid: r.tpl for r in generate.common_template(spark.createDataFrame(rows, "ltid long, words array<string>")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_ids_follow_first_lines(spark):
    df = spark.createDataFrame([(5, ["b"]), (2, ["c"]), (3, ["b"]), (9, ["a"])], "lid long, tpl array<string>")
    for n in (1, 4):
        log, lt = ids.assign(df.repartition(n))
        assert [(r.ltid, r.ltw, r["count"], r.first_lid) for r in lt.orderBy("ltid").collect()] == [(0, ["c"], 1, 2), (1, ["b"], 2, 3), (2, ["a"], 1, 9)]
        assert {r.lid: r.ltid for r in log.collect()} == {5: 1, 2: 0, 3: 1, 9: 2}


def test_crf(spark):
    text = "ssh x D\nlogin x D\nfailure x V\nfrom x D\n192.168.100.1 x V\n\nsu x D\nuser x D\nsat x V\nenabled x D\n"
    items = [(w, [crf.middle_label(x) for x in w], y) for w, _, y in crf.read_items(text)]
    model = crf.Chain().fit(items, 20)
    got = model.decode("ssh auth failure from 192.168.100.1 user sat".split())
    assert len(got) == 7 and got[0] == "D" and "V" in got
    lines = spark.createDataFrame([(1, ["user", "sat"])], "lid long, words array<string>")
    assert crf.tag(lines, model).first().tpl == ["user", "**"]
    rows = lines.withColumn("tpl", F.array(F.lit("user"), F.lit("**")))
    assert crf.items_text(rows).first().value == "user alpha D\nsat alpha V"


def test_groups(spark):
    lt = spark.createDataFrame([(0, "alpha beta gamma delta epsilon".split()), (5, "alpha beta gamma delta zeta".split()), (9, "something else altogether now here".split())], "ltid long, ltw array<string>")
    got = {r.ltid: r.ltgid for r in grouping.by_ngrams(lt).collect()}
    assert got[0] == got[5] != got[9]
    fuzzy = spark.createDataFrame([(10, ["same", "text"]), (11, ["wholly", "different"]), (20, ["same", "text"])], "ltid long, ltw array<string>")
    got = {r.ltid: r.ltgid for r in grouping.by_fuzzy_text(fuzzy).collect()}
    assert got[10] == got[20] != got[11]
    meaning = {r.ltid: r.ltgid for r in grouping.by_meaning(lt, topics=2).collect()}
    assert set(meaning) == {0, 5, 9} and all(g is not None for g in meaning.values())
    assert [(r.ltid, r.ltgid) for r in grouping.remake(lt).orderBy("ltid").collect()] == [(0, 0), (5, 5), (9, 9)]


def test_external_template_files():
    assert generate.external_templates("a <*>\n\nb\n") == ["a <*>", "b"]
    assert generate.external_templates("E1 a <*>\nE2 b c\n\n", "ids") == ["a <*>", "b c"]


def test_shuffled_definitions_keep_each_once(spark):
    d = spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEMPLATES)], "defid long, tpl array<string>")
    made = generate.shuffled(d, seed=2).orderBy("defid").collect()
    assert [r.defid for r in made] == list(range(len(TEMPLATES)))
    assert sorted(" ".join(r.tpl) for r in made) == sorted(TEMPLATES) and [" ".join(r.tpl) for r in made] != TEMPLATES


def test_many_templates_are_numbered(spark):
    df = spark.range(1, 200_001, 1, 8).selectExpr("id as lid", "array(cast(id % 150000 as string)) as tpl")
    table = ids.template_table(df)
    r = table.selectExpr("min(ltid) a", "max(ltid) b", "count(distinct ltid) n", "sum(if(ltid = first_lid - 1, 0, 1)) bad").first()
    assert (r.a, r.b, r.n, r.bad) == (0, 149_999, 150_000, 0)


def test_fuzzy_groups_by_definition(spark):
    import random

    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = list(rng.choice(texts)) if texts and rng.random() < 0.6 else [rng.choice("alpha beta gamma delta link lost found user login".split()) for _ in range(rng.randrange(1, 7))]
        words[rng.randrange(len(words))] = rng.choice(["x", "yy", "zzz", "**", "alpha"])
        texts.append(words)
    sets = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in map(" ".join, texts)]
    want = {}
    for i, x in enumerate(sets):
        near = [(len(x & sets[k]) / len(x | sets[k]), -k) for k in range(i)]
        best = max((s for s in near if s[0] >= 0.5), default=None)
        want[i] = want[-best[1]] if best else len(set(want.values()))
    lt = spark.createDataFrame(list(enumerate(texts)), "ltid long, ltw array<string>").repartition(4)
    assert {r.ltid: r.ltgid for r in grouping.by_fuzzy_text(lt).collect()} == want and 1 < len(set(want.values())) < 60
