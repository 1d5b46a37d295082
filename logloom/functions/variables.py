"""Variable rules: ordered labels for words, as ``when`` chains. Rules come from an ini file or from code."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WILDCARD

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
IPV4_NETWORK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"
_H = "[0-9A-Fa-f]{1,4}"
#: Full and compressed IPv6 addresses, each with at most eight groups.
IPV6 = "^(?:" + "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:"] + [rf"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)] + [rf":(?::{_H}){{1,7}}", "::"]
) + ")$"


#: The same with the length of a network's prefix.
IPV6_NETWORK = IPV6[:-1] + "/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])$"


def is_ip(word: Column) -> Column:
    return word.rlike(IPV4) | word.rlike(IPV6)


def is_network(word: Column) -> Column:
    return word.rlike(IPV4_NETWORK) | word.rlike(IPV6_NETWORK)


def canonical_ip(word: Column) -> Column:
    """An address in its shortest lower-case form, built without Python: groups are expanded, stripped of zeros and recompressed."""
    lower = F.lower(word)
    left, right = F.substring_index(lower, "::", 1), F.when(F.instr(lower, "::") > 0, F.substring_index(lower, "::", -1)).otherwise("")
    parts = lambda x: F.filter(F.split(x, ":"), lambda p: p != "")
    a, b = parts(left), parts(right)
    missing = F.greatest(8 - F.size(a) - F.size(b), F.lit(0))
    full = F.concat(a, F.array_repeat(F.lit("0"), missing), b)
    stripped = F.transform(full, lambda p: F.when(p.rlike("^0+$"), "0").otherwise(F.regexp_replace(p, "^0+", "")))
    text = F.concat(F.lit(":"), F.array_join(stripped, ":"), F.lit(":"))
    compressed = text
    done = F.lit(False)
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        at = F.instr(text, run)
        made = F.concat(F.substr(text, F.lit(1), at - 1), F.lit("::"), F.substr(text, at + len(run)))
        compressed = F.when(~done & (at > 0), made).otherwise(compressed)
        done = done | (at > 0)
    trimmed = F.regexp_replace(F.regexp_replace(compressed, "^:(?!:)", ""), "(?<!:):$", "")
    return F.when(word.rlike(IPV4), word).when(word.rlike(IPV6), trimmed)


EXTENSIONS = {"ipaddr": is_ip, "ipnetwork": is_network}


@dataclass
class VariableRules:
    """Ordered rules: named checks first, then regular expressions that match at a word's start."""

    extensions: list[str] = field(default_factory=list)
    patterns: dict[str, str] = field(default_factory=dict)
    hosts: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> VariableRules:
        """Sections [ext] and [re], each with ``rules`` separated by ``", "``; the [re] rules name options that hold the patterns."""
        ini = configparser.ConfigParser(interpolation=None)
        if not ini.read(path):
            raise FileNotFoundError(path)
        listed = lambda s: [x for x in ini.get(s, "rules", fallback="").split(", ") if x]
        return cls(listed("ext"), {x: ini.get("re", x) for x in listed("re")})

    def _checks(self, word: Column) -> list[tuple[str, Column]]:
        out = []
        for name in self.extensions:
            if name == "host":
                out.append((name, F.lower(word).isin(self.hosts) if self.hosts else F.lit(False)))
            elif name in EXTENSIONS:
                out.append((name, EXTENSIONS[name](word)))
            else:
                raise ValueError(f"unknown variable check {name}")
        return out + [(name, word.rlike(f"(?U)^(?:{p})")) for name, p in self.patterns.items()]

    def label(self, word: Column, default: str = "unknown") -> Column:
        """The first rule that hits, else ``default``."""
        return F.coalesce(*(F.when(c, name) for name, c in self._checks(word)), F.lit(default))

    def match(self, word: Column) -> Column:
        return reduce(lambda a, b: a | b, (c for _, c in self._checks(word)), F.lit(False))

    def template(self, words: Column) -> Column:
        """Words that a rule hits become wildcards."""
        return F.transform(words, lambda w: F.when(self.match(w), WILDCARD).otherwise(w))


#: The default: words of digits are variables.
DIGITS = VariableRules(patterns={"digit": r"\d+$"})


def label_variables(words: Column, template: Column, rules: VariableRules) -> Column:
    """The template with typed variables ``*label*`` where a rule names the word, and plain wildcards elsewhere."""
    pairs = F.zip_with(words, template, lambda w, t: F.struct(w.alias("w"), t.alias("t")))

    def typed(p: Column) -> Column:
        name = rules.label(p["w"], default="")
        return F.when(p["t"] != WILDCARD, p["t"]).when(name != "", F.concat(F.lit("*"), name, F.lit("*"))).otherwise(WILDCARD)

    return F.transform(pairs, typed)


_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_duration(text: str) -> timedelta:
    """``<int><unit>`` with unit s, m, h, d or w."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{_UNITS[m[2]]: int(m[1])})


def format_duration(value: timedelta) -> str:
    """The shortest form: the largest unit that divides the duration."""
    total = int(value.total_seconds())
    for unit, size in (("w", 604800), ("d", 86400), ("h", 3600), ("m", 60)):
        if total and total % size == 0:
            return f"{total // size}{unit}"
    return f"{total}s"
