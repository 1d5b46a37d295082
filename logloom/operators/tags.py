"""Tags for templates by ordered rules over their words."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts_with(pattern: str, ignore_case: bool):
    return lambda word: word.rlike(("(?i)" if ignore_case else "") + f"^(?:{pattern})")


@dataclass
class TagRules:
    """labels: name -> rules; a rule is (regular expressions, ignore case) that each match the start of some word of the template.

    groups: name -> labels. The first label with a rule that hits counts.
    """

    labels: dict[str, list[tuple[list[str], bool]]]
    groups: dict[str, list[str]] = field(default_factory=dict)
    default_label: str | None = None
    default_group: str | None = None

    @classmethod
    def load(cls, path: str, default_label: str | None = None, default_group: str | None = None) -> TagRules:
        """Sections [label_<name>] with ``rules`` and their patterns (``c_`` regards case, ``i_`` does not), [group_<name>] with ``members``."""
        ini = configparser.ConfigParser(interpolation=None)
        if not ini.read(path):
            raise FileNotFoundError(path)
        names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
        labels, groups = {}, {}
        for section in ini.sections():
            if section.startswith("label_"):
                rules = []
                for rule in names(ini.get(section, "rules")):
                    if rule[:1] not in "ic":
                        raise ValueError(f"rule {rule} begins with neither i nor c")
                    rules.append((names(ini.get(section, rule)), rule[0] == "i"))
                labels[section.removeprefix("label_")] = rules
            elif section.startswith("group_"):
                groups[section.removeprefix("group_")] = names(ini.get(section, "members"))
        return cls(labels, groups, default_label, default_group)

    def label(self, ltw: Column) -> Column:
        out = []
        for name, rules in self.labels.items():
            for patterns, ignore in rules:
                hit = F.lit(True)
                for p in patterns:
                    hit = hit & F.exists(ltw, _starts_with(p, ignore))
                out.append(F.when(hit, name))
        return F.coalesce(*out, F.lit(self.default_label).cast("string"))

    def group(self, label: Column) -> Column:
        out = [F.when(label.isin(members), name) for name, members in self.groups.items()]
        return F.coalesce(*out, F.lit(self.default_group).cast("string"))


def tag_templates(lt: DataFrame, rules: TagRules | None, mode: str = "group") -> DataFrame:
    """ltid, tag by mode: group, label, or all (both, with prefixes). No rules give no tags."""
    if rules is None:
        return lt.select("ltid", F.lit(None).cast("string").alias("tag")).where("tag is not null")
    named = lt.withColumn("__l", rules.label(F.col("ltw"))).withColumn("__g", rules.group(F.col("__l")))
    choices = {"group": F.array("__g"), "label": F.array("__l"), "all": F.array(F.concat(F.lit("label_"), "__l"), F.concat(F.lit("group_"), "__g"))}
    return named.select("ltid", F.explode(choices[mode]).alias("tag")).where("tag is not null")
