"""Generators by name, their modes, and their options from a configuration."""

from __future__ import annotations

import configparser
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.variables import DIGITS, VariableRules
from .operators import cluster, crf, generate
from .sources.parse import read_definitions

#: name: (stateful, mode, may run in parallel over arbitrary partitions)
INFO = {
    "re": (False, "any", True),
    "import": (False, "any", True),
    "import-ext": (False, "any", True),
    "crf": (False, "any", True),
    "va": (True, "offline", True),
    "dlog": (True, "offline", True),
    "drain": (True, "online", False),
    "lenma": (True, "online", False),
    "shiso": (True, "online", False),
    "fttree": (True, "online", False),
}


def mode_of(methods: list[str]) -> str:
    """offline if any of the methods is, else online."""
    return "offline" if any(INFO[m][1] == "offline" for m in methods) else "online"


#: Generators of the site's own: name -> (function of session and configuration that gives one of lines, entry of INFO).
OWN: dict[str, Callable[[SparkSession, configparser.ConfigParser], Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, make: Callable[[SparkSession, configparser.ConfigParser], Callable[[DataFrame], DataFrame]], stateful: bool = False, mode: str = "any", parallel: bool = True) -> None:
    """Add a generator: make(spark, conf) gives a function from lines to lines with tpl, and cid if it has clusters."""
    if name in INFO and name not in OWN:
        raise ValueError(f"{name} is taken")
    OWN[name] = make
    INFO[name] = (stateful, mode, parallel)


def rules_of(path: str) -> VariableRules:
    return VariableRules.load(path) if path else DIGITS


def generator(spark: SparkSession, conf: configparser.ConfigParser, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function from lines to lines with key and tpl: key names the cluster, or the template where there are none."""
    c = conf

    def keyed(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(lines: DataFrame) -> DataFrame:
            out = made(lines)
            return out.withColumn("key", F.col("cid") if "cid" in out.columns else F.to_json("tpl"))

        return run

    def joined(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda lines: lines.join(made(lines), "lid")

    if name == "re":
        return keyed(lambda x: generate.by_rules(x, rules_of(c.get("re", "rules"))))
    online = c.get("generate", "mode") == "online"
    if name in OWN:
        return keyed(OWN[name](spark, c))
    if name == "va":
        by = generate.by_running_frequency if online else generate.by_frequency
        return keyed(lambda x: by(x, c.get("va", "method"), c.getfloat("va", "threshold")))
    if name == "import-ext":
        text = "\n".join(r.value for r in spark.read.text(c.get("import-ext", "templates")).collect())
        templates = generate.external_templates(text, c.get("import-ext", "mode"))
        raw = F.transform("words", T.unescape)

        def external(x: DataFrame) -> DataFrame:
            statement = T.restore_message(F.col("words"), F.col("symbols")) if "symbols" in x.columns else F.array_join(raw, " ")
            return generate.by_external(x.withColumn("statement", statement), templates, c.get("import-ext", "placeholder")).where("tpl is not null").drop("statement")

        return keyed(external)
    if name == "crf":
        model = crf_model(spark, c)
        return keyed(joined(lambda x: crf.tag(x, model)))
    if name == "import":
        definitions = read_definitions(spark, c.get("import", "definitions"))
        if c.getboolean("import", "shuffle"):
            definitions = generate.shuffled(definitions)
        return keyed(lambda x: generate.match_definitions(x, definitions, c.get("import", "search")).where("tpl is not null"))
    if name == "drain":
        return keyed(joined(lambda x: cluster.drain(x, c.getfloat("drain", "threshold"), c.getint("drain", "depth"), rules_of(c.get("drain", "rules")))))
    if name == "lenma":
        return keyed(joined(lambda x: cluster.lenma(x, c.getfloat("lenma", "threshold"), c.getint("lenma", "n_same"), c.getboolean("lenma", "head_rule"))))
    if name == "shiso":
        return keyed(joined(lambda x: cluster.shiso(x, c.getfloat("shiso", "threshold"), c.getint("shiso", "max_child"))))
    if name == "fttree":
        return keyed(joined(lambda x: cluster.frequent_tree(x, c.getint("fttree", "max_child"), c.getint("fttree", "cut_depth"), c.get("fttree", "message_type"), online)))
    if name == "dlog":
        return keyed(joined(lambda x: cluster.merged_prefixes(x, rules_of(c.get("drain", "rules")))))
    raise ValueError(f"unknown method {name}")


def crf_model(spark: SparkSession, c: configparser.ConfigParser) -> crf.Chain:
    """The tagger of the configuration: a saved model, or one from a training file."""
    text = lambda path: "\n".join(r.value for r in spark.read.text(path).collect())  # noqa: E731  a model's or a training file's, bounded by its sample
    if c.get("crf", "model"):
        return crf.Chain.read(text(c.get("crf", "model")))
    templates = crf.parse_templates(text(c.get("crf", "features")).splitlines()) if c.get("crf", "features") else None
    if not c.get("crf", "train"):
        raise ValueError("crf needs a model or a training file")
    return crf.train_items(text(c.get("crf", "train")), c.getint("crf", "rounds"), templates)


def feedback(spark: SparkSession, c: configparser.ConfigParser, other: str) -> Callable[[DataFrame], DataFrame]:
    """Definitions and, for lines that none of them matches, drain or lenma, whose templates become definitions for the lines after."""
    rows = read_definitions(spark, c.get("import", "definitions")).orderBy("defid").collect()  # the site's own file
    definitions = [(r.defid, list(r.tpl)) for r in rows]
    search = c.get("import", "search")
    if other == "drain":
        threshold, depth, rules = c.getfloat("drain", "threshold"), c.getint("drain", "depth"), rules_of(c.get("drain", "rules"))

        def run(lines: DataFrame) -> DataFrame:
            return cluster.joint(lines, definitions, lambda: cluster.Drain(threshold), cluster.leaf_of(depth), search, rules)

    elif other == "lenma":

        def run(lines: DataFrame) -> DataFrame:
            make = lambda: cluster.Lenma(c.getfloat("lenma", "threshold"), c.getint("lenma", "n_same"), c.getboolean("lenma", "head_rule"))
            return cluster.joint(lines, definitions, make, search=search)

    else:
        raise ValueError(f"feedback is for drain and lenma, not {other}")
    return lambda lines: lines.join(run(lines), "lid").withColumn("key", F.col("cid"))
