"""Online generators, their saved states and streams, joint definitions with feedback, and the tagger."""

import random

import numpy as np
import pytest
import reference_miners as ref
from pyspark.sql import functions as F

from logloom import config, methods
from logloom.functions.variables import DIGITS
from logloom.operators import cluster, crf, generate
from logloom.streaming import online


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(8)
    verbs = ["up", "down", "lost", "found", "reset"]
    return [(i + 1, ["link", rng.choice("abc"), "went", rng.choice(verbs)] if rng.random() < 0.5 else ["user", str(rng.randrange(30)), "on", rng.choice("xyz"), rng.choice(verbs)][: rng.choice([4, 5])]) for i in range(400)]


@pytest.fixture(scope="module")
def frame(spark, lines):
    return spark.createDataFrame(lines, "lid long, words array<string>").repartition(5).cache()


def running(lines):
    seen, out = {}, {}
    for lid, words in lines:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        out[lid] = [seen[w] for w in words]
    return out


@pytest.mark.parametrize("block", [1, 37, 4096])
def test_running_counts(frame, lines, block):
    assert {r.lid: r.counts for r in cluster.running_counts(frame, block).collect()} == running(lines)


@pytest.mark.parametrize(("method", "threshold"), [("static", 5), ("relative-line", 0.1), ("relative-variable", 0.4)])
def test_running_frequency(frame, lines, method, threshold):
    counts, want = running(lines), {}
    for k, (lid, words) in enumerate(lines):
        own = counts[lid]
        limit = {"static": threshold, "relative-line": threshold * (k + 1), "relative-variable": sorted(own)[int(0.4 * len(own))]}[method]
        want[lid] = [w if (n >= limit if method == "relative-variable" else n > limit) else "**" for w, n in zip(words, own)]
    assert {r.lid: r.tpl for r in generate.by_running_frequency(frame, method, threshold, block=50).collect()} == want


def online_tree(lines, max_child=6, cut_depth=3):
    roots, out, counts = {}, {}, running(lines)
    for lid, words in lines:
        count = dict(zip(words, counts[lid]))
        node, depth, kept = roots.setdefault(len(words), {"c": {}}), 0, set()
        for w in sorted(words, key=lambda w: (count[w], w), reverse=True):
            if node["c"] is None:
                break
            if w not in node["c"]:
                node["c"][w] = {"c": {}}
                if len(node["c"]) >= max_child and depth >= cut_depth:
                    node["c"] = None
                    break
            kept.add(w)
            node, depth = node["c"][w], depth + 1
        out[lid] = [w if w in kept else "**" for w in words]
    return out


def test_online_tree(frame, lines):
    got = cluster.frequent_tree(frame, 3, 2, "length", online=True)
    assert {r.lid: r.tpl for r in got.collect()} == online_tree(lines, 3, 2)


MINERS = {
    "drain": (lambda x: cluster.drain_leaf(F.col("words")), cluster.Drain),
    "lenma": (lambda x: F.size("words"), cluster.Lenma),
    "shiso": (lambda x: F.lit("all"), cluster.Shiso),
    "tree": (lambda x: cluster.tree_of("length"), lambda: cluster.CountingTree(3, 2)),
}


@pytest.mark.parametrize("name", sorted(MINERS))
def test_saved_states_go_on(frame, name):
    group, miner = MINERS[name]
    whole = {r.lid: (r.cid, r.tpl) for r in cluster.ordered(frame, group(0), miner).collect()}
    first = cluster.ordered(frame.where("lid <= 150"), group(0), miner, keep=True).cache()
    second = cluster.ordered(frame.where("lid > 150"), group(0), miner, states=cluster.states_of(first))
    got = {r.lid: (r.cid, r.tpl) for r in first.where("lid is not null").unionByName(second).collect()}
    assert got == whole


def joint_by_definition(lines, definitions, threshold=0.3):
    """One list of definitions, and drain for what none of them matches, line by line."""
    known = [[f"d{i}", list(t)] for i, t in definitions]
    leaves, out = {}, {}
    for lid, words in lines:
        fits = [d for d in known if len(d[1]) == len(words) and all(a in ("**", b) for a, b in zip(d[1], words))]
        if fits:
            best = max(fits, key=lambda d: [t != "**" for t in d[1]])
            out[lid] = list(best[1])
            continue
        tokens = ["**" if w.isdigit() else w for w in words]
        leaf = leaves.setdefault((len(words), tuple([t for t in tokens if t != "**"][:1])), [])
        scored = [(sum(a == b for a, b in zip(d[1], tokens)) / len(tokens), -k) for k, d in enumerate(leaf)]
        good = [x for x in scored if x[0] >= threshold and x[0] > 0]
        if good:
            own = leaf[-max(good)[1]]
            own[1][:] = [a if a == b else "**" for a, b in zip(own[1], tokens)]
        else:
            own = [f"m{len(known)}", tokens]
            leaf.append(own)
            known.append(own)
        out[lid] = list(own[1])
    return out


def test_joint_feeds_back(frame, lines):
    definitions = [(0, ["link", "a", "went", "**"]), (1, ["user", "**", "on", "x"])]
    got = cluster.joint(frame, definitions, cluster.Drain, cluster.leaf_of(), rules=DIGITS)
    assert {r.lid: r.tpl for r in got.collect()} == joint_by_definition(lines, definitions)
    first = cluster.joint(frame.where("lid <= 99"), definitions, cluster.Drain, cluster.leaf_of(), rules=DIGITS, keep=True).cache()
    second = cluster.joint(frame.where("lid > 99"), definitions, cluster.Drain, cluster.leaf_of(), rules=DIGITS, states=cluster.states_of(first))
    assert {r.lid: r.cid for r in first.where("lid is not null").unionByName(second).collect()} == {r.lid: r.cid for r in got.collect()}


@pytest.mark.parametrize("name", ["drain", "lenma", "shiso", "tree"])
def test_streams_equal_batches(spark, tmp_path, lines, name):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        rows = [(f"{lid:09d}", words) for lid, words in lines[k * 60 : k * 60 + 60]]
        spark.createDataFrame(rows, "at string, words array<string>").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("at string, words array<string>").option("maxFilesPerTrigger", 1).parquet(str(source))
    made = {"drain": online.drain_stream, "lenma": online.lenma_stream, "shiso": online.shiso_stream, "tree": lambda s: online.tree_stream(s, 3, 2)}[name](stream)
    made.writeStream.format("memory").queryName(f"mined_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    given = spark.createDataFrame(lines[:120], "lid long, words array<string>")
    group, miner = MINERS[name]
    masked = given.withColumn("words", DIGITS.template(F.col("words"))) if name == "drain" else given
    want = {r.lid: r.tpl for r in cluster.ordered(masked, group(0), miner).collect()}
    assert {int(r["at"]): r.tpl for r in spark.table(f"mined_{name}").collect()} == want


def test_likelihood_and_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    chain = crf.Chain()
    words = ["a", "1", "b2", "c"]
    middles = [crf.middle_label(w) for w in words]
    found = crf.features(words, middles, chain.templates)
    for f in {x for fs in found for x in fs} | {"t=D", "t=V"}:
        for y in crf.LABELS:
            chain.weights[f, y] = rng.normal()
    own, step = chain.scores(found)
    total = {ys: sum(own[i][crf.LABELS.index(y)] for i, y in enumerate(ys)) + sum(step[crf.LABELS.index(a)][crf.LABELS.index(b)] for a, b in zip(ys, ys[1:])) for ys in product(crf.LABELS, repeat=4)}
    z = np.logaddexp.reduce(list(total.values()))
    logz, one, two = chain.marginals(found)
    assert abs(z - logz) < 1e-9
    assert abs(one[1][0] - sum(np.exp(v - z) for ys, v in total.items() if ys[1] == "D")) < 1e-9
    assert abs(two[2][1][0] - sum(np.exp(v - z) for ys, v in total.items() if ys[2:] == ("V", "D"))) < 1e-9
    best = max(total, key=total.get)
    assert tuple(chain.decode(words)) == best
    data = [(words, middles, list(best))]
    assert abs(chain.log_likelihood(data) - (total[best] - z)) < 1e-9


def test_training_raises_the_likelihood_and_models_are_saved(spark, frame):
    labelled = generate.by_rules(frame)
    rows = [(r.words, [crf.middle_label(w) for w in r.words], ["V" if t == "**" else "D" for t in r.tpl]) for r in labelled.limit(100).collect()]
    fitted = crf.Chain().fit(list(rows))
    assert fitted.log_likelihood(rows) > 0.2 * crf.Chain().log_likelihood(rows)
    again = crf.Chain.read(fitted.saved())
    assert again.weights == fitted.weights and [again.decode(r[0]) for r in rows] == [fitted.decode(r[0]) for r in rows]
    leak = crf.sample_lines(labelled, 12, "leak").collect()
    n = labelled.select("tpl").distinct().count()
    assert len({tuple(r.tpl) for r in leak}) == min(12, n)
    assert crf.sample_lines(labelled, 12, "ltgen", key=F.size("words")).groupBy(F.size("words")).count().where("count >= 5").count() == 2


def test_every_listed_method_can_be_configured(spark, frame, tmp_path):
    (tmp_path / "d").write_text("link ** went **\n")
    (tmp_path / "e").write_text("1 link <*> went <*>\n2 user <*> on <*> <*>\n")
    model = crf.train(generate.by_rules(frame), n=50)
    (tmp_path / "m").write_text(model.saved())
    c = config.open_config()
    for section, option, value in [("import", "definitions", f"{tmp_path}/d"), ("import", "shuffle", "true"), ("import-ext", "templates", f"{tmp_path}/e"), ("import-ext", "mode", "ids"), ("crf", "model", f"{tmp_path}/m")]:
        c.set(section, option, value)
    methods.register("first-word", lambda spark, conf: lambda x: x.withColumn("tpl", F.transform("words", lambda w, i: F.when(i == 0, w).otherwise("**"))))
    given = frame.withColumn("symbols", F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.when((i > 0) & (i < F.size("words")), " ").otherwise("")))
    for mode in ("offline", "online"):
        c.set("generate", "mode", mode)
        for name in methods.INFO:
            made = methods.generator(spark, c, name)(given)
            assert {"lid", "key", "tpl"} <= set(made.columns)
            assert 0 < made.where("tpl is not null").count() <= 400, name
    with pytest.raises(ValueError, match="taken"):
        methods.register("drain", None)
    assert methods.feedback(spark, c, "lenma")(given).count() == 400
    del methods.OWN["first-word"], methods.INFO["first-word"]


def test_offline_tree_is_unchanged(frame, lines):
    assert {r.lid: r.tpl for r in cluster.frequent_tree(frame, 3, 2, "length").collect()} == ref.frequent_tree(lines, 3, 2)
