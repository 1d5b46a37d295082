"""Command line: ``python -m logloom.cli COMMAND -c CONFIG [options]``. Every command is a thin wrapper around the operators."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, methods
from .functions import text as T
from .operators import anonymize, crf, edit, evaluate, grouping, hosts, search, stats, tags
from .session import build_session
from .sources import parse
from .sources.formats import log_format
from .store import LogStore


class Context:
    """What commands share: session, configuration, store and inputs."""

    def __init__(self, args: argparse.Namespace):
        self.args = args
        self.conf = config.open_config(args.config)
        self.spark = build_session("logloom")

    def store(self, mode: str = "read") -> LogStore:
        return LogStore(self.spark, self.conf.get("store", "path"), mode)

    def read(self) -> tuple[DataFrame, DataFrame]:
        c = self.conf
        paths = self.args.files or [c.get("general", "src_path")]
        year = c.get("general", "year")
        fmt = log_format(c.get("general", "format"), int(year) if year else None)
        alias = c.get("parse", "host_alias")
        aliases = hosts.load_aliases(self.spark, alias) if alias else None
        found = parse.expand_paths(paths, c.getboolean("general", "src_recur"), self.spark)
        return parse.read_log(self.spark, found, fmt, aliases, c.getboolean("parse", "undefined_host"), c.get("parse", "dummy_host"))

    def mined(self) -> DataFrame:
        """Lines by the first method that gives a template."""
        lines, _ = self.read()
        return self.mine(lines)

    def mine(self, lines: DataFrame) -> DataFrame:
        names = config.get_list(self.conf, "generate", "methods")
        if self.conf.getboolean("generate", "feedback"):
            if len(names) != 2 or names[0] != "import":
                raise ValueError("feedback needs the methods import and one other")
            return methods.feedback(self.spark, self.conf, names[1])(lines).select("lid", "dt", "host", "words", "symbols", "key", "tpl")
        left, out = lines, None
        for name in names:
            made = methods.generator(self.spark, self.conf, name)(left).select("lid", "dt", "host", "words", "symbols", "key", "tpl")
            made = made.withColumn("key", F.concat(F.lit(f"{name}:"), "key"))
            out = made if out is None else out.unionByName(made)
            left = left.join(made, "lid", "left_anti")
        return out

    def tag_rules(self) -> tags.TagRules | None:
        path = self.conf.get("tag", "rules")
        return tags.TagRules.load(path) if path else None


def show(df: DataFrame, n: int = 1000) -> None:
    df.show(n, truncate=False)


def db_make(c: Context) -> None:
    c.store("reset").add_lines(c.mined(), "key", "tpl")


def db_add(c: Context) -> None:
    c.store("append").add_lines(c.mined(), "key", "tpl")


def db_remake_group(c: Context) -> None:
    s = c.store("append")
    s.replace("ltg", grouping.remake(s.table("lt"), c.conf.get("group", "method")))


def db_tag(c: Context) -> None:
    s = c.store("append")
    s.replace("tag", tags.tag_templates(s.table("lt"), c.tag_rules(), c.conf.get("tag", "mode")))


def db_repair(c: Context) -> None:
    print("made:", ", ".join(c.store("append").repair()) or "nothing")


def db_anonymize(c: Context) -> None:
    """The log with pseudonyms, in place or as another store (--to); the mappings, which restore it, go to a folder."""
    s = c.store("append")
    log, lt, mapping = anonymize.anonymize(s.table("log"), s.table("lt"))
    mapping.coalesce(1).write.mode("overwrite").json(f"{c.args.output}/hosts")
    s.table("lt").select("ltid", "ltw", "lts").coalesce(1).write.mode("overwrite").json(f"{c.args.output}/templates")
    if c.args.mapping_only:
        return
    target = LogStore(c.spark, c.args.to, "reset") if c.args.to else s
    target.replace("log", log)
    target.replace("lt", lt)
    for name in ("ltg", "tag") if c.args.to else ():
        target.replace(name, s.table(name))


def db_restore(c: Context) -> None:
    """Hosts and templates of an anonymous store again, from the folder of mappings."""
    s = c.store("append")
    hosts_of, templates = anonymize.read_mappings(c.spark, c.args.output)
    lt = anonymize.restore_templates(s.table("lt"), templates)
    s.replace("log", anonymize.restore_log(s.table("log"), hosts_of, lt))
    s.replace("lt", lt)


def clean(c: Context) -> None:
    c.store("append").drop()


def data_parse(c: Context) -> None:
    lines, bad = c.read()
    show(lines.select("lid", "dt", "host", F.array_join("words", " ").alias("words")).orderBy("lid"), c.args.number)
    show(bad, c.args.number)


def data_from_db(c: Context) -> None:
    c.store().export_days(c.args.output)


def data_from_data(c: Context) -> None:
    lines, _ = c.read()
    text = T.restore_line(F.col("dt"), F.col("host"), T.restore_message(F.col("words"), F.col("symbols")))
    days = lines.select(F.date_format("dt", "yyyyMMdd").alias("day"), "lid", text.alias("value")).repartition("day").sortWithinPartitions("day", "lid")
    days.select("day", "value").write.partitionBy("day").mode("overwrite").text(c.args.output)


def show_db_info(c: Context) -> None:
    s = c.store()
    if c.args.term:
        show(stats.term_info(s.table("log"), s.table("ltg"), *c.args.term))
    else:
        show(stats.info(s.table("log"), s.table("lt"), s.table("ltg")))


def show_lt(c: Context) -> None:
    s = c.store()
    show(search.template_lines(s.table("lt"), s.table("tag")).orderBy("ltid"), c.args.number)


def show_ltg(c: Context) -> None:
    s = c.store()
    show(stats.group_summary(s.table("lt"), s.table("ltg"), s.table("tag")).orderBy("ltgid"), c.args.number)


def show_tag(c: Context) -> None:
    s = c.store()
    show(stats.tag_summary(s.table("lt"), s.table("tag")).orderBy("tag"), c.args.number)


def show_tags(c: Context) -> None:
    show(c.store().table("tag").orderBy("ltid", "tag"), c.args.number)


def show_lt_import(c: Context) -> None:
    """Templates as importable definitions; external ones are without escapes and have placeholders, and the symbols of their first line."""
    if not c.args.external:
        c.store().export_templates(c.args.output)
        return
    mark = c.conf.get("import-ext", "placeholder")
    words = F.transform("ltw", lambda w: F.when(w == T.WILDCARD, mark).otherwise(T.unescape(w)))
    text = T.restore_message(words, F.col("lts"), keep_escapes=True)
    spaced = F.when(F.col("lts").isNull(), F.array_join(words, " ")).otherwise(text)
    c.store().table("lt").orderBy("ltid").select(spaced.alias("value")).coalesce(1).write.mode("overwrite").text(c.args.output)


def show_line(c: Context) -> None:
    """One line with its template, by its number."""
    s = c.store()
    show(search.messages(search.with_templates(search.line(s.table("log"), c.args.lid), s.table("lt"))).select("lid", "ltid", "line"))


def conf_shadow(c: Context) -> None:
    """A configuration that imports the given one, to be changed."""
    import os

    with open(c.args.output, "w") as f:
        f.write(f"[general]\nimport = {os.path.relpath(c.args.config, os.path.dirname(c.args.output) or '.')}\n")


def conf_group_edit(c: Context) -> None:
    """Set one option in every configuration file of a group: GROUP-FILE GROUP SECTION OPTION VALUE."""
    path, group, section, option, value = c.args.files
    for name in config.load_groups(path)[group]:
        config.set_option(name, section, option, value)


def show_host(c: Context) -> None:
    show(stats.hosts(c.store().table("log")).orderBy("host"), c.args.number)


def host_group_update(c: Context) -> None:
    s = c.store("append")
    tiers = hosts.load_tiers(c.conf.get("hosts", "groups"))
    s.replace("hg", hosts.host_groups(stats.hosts(s.table("log")), tiers))


def show_host_group(c: Context) -> None:
    s = c.store()
    show(stats.host_group_summary(s.table("log"), s.table("hg")).orderBy("tier", "hgid"), c.args.number)


def host_group_check(c: Context) -> None:
    s = c.store()
    tiers = hosts.load_tiers(c.conf.get("hosts", "groups"))
    hg = hosts.host_groups(stats.hosts(s.table("log")), tiers)
    for fine, coarse in zip(tiers, tiers[1:], strict=False):
        show(hosts.nesting_violations(hg, fine.name, coarse.name))
        show(hosts.ordering_violations(hg, fine.name, coarse.name))
    for t in tiers:
        show(hosts.unmatched_hosts(stats.hosts(s.table("log")), t))


def show_log(c: Context) -> None:
    s = c.store()
    found = search.search(s.table("log"), groups=s.table("ltg"), host_groups=s.table("hg"), order=True, limit=c.args.number, **search.parse_conditions(c.args.conditions))
    show(search.messages(search.with_templates(found, s.table("lt"))).orderBy("lid").select("lid", "line"), c.args.number)


def show_algorithms(c: Context) -> None:
    for name, (stateful, mode, parallel) in methods.INFO.items():
        print(f"{name:12} stateful={stateful} mode={mode} parallel={parallel}")


def conf_defaults(c: Context) -> None:
    for section, values in config.DEFAULTS.items():
        print(f"[{section}]", *(f"{k} = {v}" for k, v in values.items()), sep="\n")


def conf_diff(c: Context) -> None:
    for row in config.difference(c.conf, config.open_config(c.args.files[0])):
        print(*row)


def conf_minimum(c: Context) -> None:
    found = config.minimum(c.conf)
    for section in found.sections():
        print(f"[{section}]", *(f"{k} = {v}" for k, v in found.items(section)), sep="\n")


def words_of(target: str):
    def run(c: Context) -> None:
        s = c.store()
        show(stats.word_counts(s.table("log"), s.table("lt"), target, c.args.digits).orderBy(F.desc("count"), "word"), c.args.number)

    return run


def show_breakdown(c: Context) -> None:
    from .operators.generate import top_values

    s = c.store()
    show(top_values(stats.variable_values(s.table("log"), s.table("lt"), c.args.ltid), c.args.number).orderBy("vid", "rank"))


def show_stable(c: Context) -> None:
    s = c.store()
    show(stats.stable_variables(s.table("log"), s.table("lt"), c.args.number))


def show_positions(c: Context) -> None:
    show(search.template_places(c.store().table("lt")).orderBy("ltid", "wid"), c.args.number)


def edited(operation):
    def run(c: Context) -> None:
        s = c.store("append")
        log, lt = operation(s.table("log"), s.table("lt"), c.args)
        if c.args.force or input("rewrite templates? [y/n] ").startswith("y"):
            s.replace("log", log)
            s.replace("lt", lt)

    return run


def accuracy(c: Context) -> None:
    """Templates of the configured methods against those of the answer definitions, over the same lines."""
    from .operators.generate import match_definitions

    lines, _ = c.read()
    definitions = parse.read_definitions(c.spark, c.args.answer)
    answer = match_definitions(lines, definitions).select("lid", F.col("defid").alias("tid"), "tpl")
    trial = c.mined().select("lid", F.col("key").alias("tid"), "tpl")
    labels = evaluate.pair_labels(answer, trial)
    for metric in (evaluate.cluster_inventory, evaluate.structure_scores, evaluate.final_structure_scores, evaluate.rand_scores, evaluate.v_measure, evaluate.cluster_scores):
        show(metric(labels))
    if c.args.failures:
        show(evaluate.first_failures(labels), c.args.number)
        show(evaluate.samples_of_divided(labels, 1), c.args.number)
        show(evaluate.samples_of_divided(labels, 1, aggregated=True), c.args.number)


def measured(c: Context) -> tuple[DataFrame, DataFrame]:
    from .operators.generate import match_definitions

    lines, _ = c.read()
    definitions = parse.read_definitions(c.spark, c.args.answer or c.conf.get("eval", "answer"))
    return lines, match_definitions(lines, definitions).select("lid", F.col("defid").alias("tid"), "tpl")


def measure_accuracy(mode: str):
    """Labels of the answer and of each trial, kept in a folder; online trials go on from the training lines before them."""

    def run(c: Context) -> None:
        c.conf.set("generate", "mode", mode)
        lines, answer = measured(c)
        answer.write.mode("overwrite").parquet(f"{c.args.output}/answer")
        for k in range(c.conf.getint("eval", "trials") if c.args.number == 1000 else c.args.number):
            c.mine(lines).select("lid", F.col("key").alias("tid"), "tpl").write.mode("overwrite").parquet(f"{c.args.output}/trials/trial={k}")

    return run


def show_measured(c: Context) -> None:
    """The scores of every kept trial, and their means."""
    answer = c.spark.read.parquet(f"{c.args.output}/answer")
    trials = c.spark.read.parquet(f"{c.args.output}/trials")
    show(evaluate.trial_scores(answer, trials).orderBy("trial"), c.args.number)


def measure_parameter(c: Context) -> None:
    """Scores of the first method for every entry of its parameter grid."""
    from .operators.cluster import GRIDS

    lines, answer = measured(c)
    name = config.get_list(c.conf, "generate", "methods")[0]
    for entry in GRIDS[name]:
        for k, v in entry.items():
            c.conf.set(name, k, str(v))
        trial = c.mine(lines).select("lid", F.col("key").alias("tid"), "tpl")
        row = evaluate.structure_scores(evaluate.pair_labels(answer, trial)).first()
        print(*(f"{k}={v}" for k, v in entry.items()), *(f"{k}={row[k]:.6f}" for k in ("word_accuracy", "line_accuracy")))


def measure_time(mode: str):
    """Seconds that each of some runs over all lines takes, and their mean."""

    def run(c: Context) -> None:
        import time

        c.conf.set("generate", "mode", mode)
        lines, _ = c.read()
        took = []
        for _ in range(c.conf.getint("eval", "trials_time") if c.args.number == 1000 else c.args.number):
            began = time.perf_counter()
            c.mine(lines).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        print(*(f"{x:.3f}" for x in took), f"mean {sum(took) / len(took):.3f}")

    return run


def search_diff(c: Context) -> None:
    """Lines whose templates two configurations give differently, of those that the first one gives right."""
    lines, answer = measured(c)
    one = evaluate.pair_labels(answer, c.mine(lines).select("lid", F.col("key").alias("tid"), "tpl"))
    c.conf = config.open_config(c.args.other_config)
    two = evaluate.pair_labels(answer, c.mine(lines).select("lid", F.col("key").alias("tid"), "tpl"))
    show(evaluate.differing_lines(one, two), c.args.number)


def search_fail(c: Context) -> None:
    lines, answer = measured(c)
    labels = evaluate.pair_labels(answer, c.mine(lines).select("lid", F.col("key").alias("tid"), "tpl"))
    show(evaluate.first_failures(labels), c.args.number)


def make_crf_model(c: Context) -> None:
    """A tagger from the store's lines, or from a training file, as one file."""
    if c.conf.get("crf", "train"):
        model = methods.crf_model(c.spark, c.conf)
    else:
        s = c.store()
        lines = search.with_templates(s.table("log"), s.table("lt")).withColumn("tpl", F.col("ltw"))
        model = crf.train(lines, c.conf.getint("crf", "n_sample"), c.conf.get("crf", "sample"), c.conf.getint("crf", "rounds"))
    with open(c.args.output, "w") as f:
        f.write(model.saved())


def make_crf_train(c: Context) -> None:
    s = c.store()
    lines = search.with_templates(s.table("log"), s.table("lt")).withColumn("tpl", F.col("ltw"))
    chosen = crf.sample_lines(lines, c.args.number, "random")
    crf.items_text(chosen).orderBy("lid").select(F.concat("value", F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(c.args.output)


COMMANDS = {
    "data-parse": data_parse, "data-from-db": data_from_db, "data-from-data": data_from_data,
    "db-make": db_make, "db-add": db_add, "db-remake-group": db_remake_group, "db-tag": db_tag, "db-repair": db_repair, "db-anonymize": db_anonymize, "db-restore": db_restore, "clean": clean,
    "show-db-info": show_db_info, "show-lt": show_lt, "show-ltg": show_ltg, "show-tag": show_tags, "show-tag-stats": show_tag, "show-lt-import": show_lt_import, "dump-lt": show_lt_import,
    "show-host": show_host, "host-group-update": host_group_update, "show-host-group": show_host_group, "host-group-check": host_group_check,
    "show-log": show_log, "show-line": show_line, "conf-shadow": conf_shadow, "conf-group-edit": conf_group_edit, "show-algorithms": show_algorithms, "conf-defaults": conf_defaults, "conf-diff": conf_diff, "conf-minimum": conf_minimum,
    "show-lt-words": words_of("all"), "show-lt-description": words_of("description"), "show-lt-variable": words_of("variable"),
    "show-lt-breakdown": show_breakdown, "show-lt-vstable": show_stable, "show-lt-positions": show_positions,
    "lt-merge": edited(lambda log, lt, a: edit.merge(log, lt, a.ltid, a.other)),
    "lt-separate": edited(lambda log, lt, a: edit.separate(log, lt, a.ltid, a.vid[0], a.value)),
    "lt-split": edited(lambda log, lt, a: edit.split(log, lt, a.ltid, a.vid[0])),
    "lt-fix": edited(lambda log, lt, a: edit.fix(log, lt, a.ltid, a.vid)),
    "lt-free": edited(lambda log, lt, a: edit.free(log, lt, a.ltid, a.wid)),
    "lt-merge-dup": edited(lambda log, lt, a: edit.merge_duplicates(log, lt)),
    "show-accuracy": accuracy, "make-crf-train": make_crf_train, "make-crf-model": make_crf_model,
    "measure-accuracy-offline": measure_accuracy("offline"), "measure-accuracy-online": measure_accuracy("online"), "show-measured": show_measured, "measure-parameter": measure_parameter,
    "measure-time-offline": measure_time("offline"), "measure-time-online": measure_time("online"), "search-diff": search_diff, "search-fail": search_fail,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("files", nargs="*", help="input files or folders")
    p.add_argument("-c", "--config")
    p.add_argument("-n", "--number", type=int, default=1000, help="rows to show, or a bound")
    p.add_argument("-t", "--term", nargs=2, metavar=("START", "END"))
    p.add_argument("-w", "--conditions", nargs="*", default=[], metavar="KEY=VALUE")
    p.add_argument("-o", "--output", default="logloom-out")
    p.add_argument("-d", "--digits", action="store_true", help="fold digits")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-e", "--external", action="store_true", help="templates as other tools write them")
    p.add_argument("--other-config", help="the configuration to compare with")
    p.add_argument("--lid", type=int)
    p.add_argument("--ltid", type=int)
    p.add_argument("--other", type=int)
    p.add_argument("--vid", type=int, nargs="*", default=[])
    p.add_argument("--wid", type=int, nargs="*", default=[])
    p.add_argument("--value")
    p.add_argument("--answer", help="definitions that are right")
    p.add_argument("--failures", action="store_true")
    p.add_argument("--to", help="a folder for another store")
    p.add_argument("--mapping-only", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](Context(args))


if __name__ == "__main__":
    main()
