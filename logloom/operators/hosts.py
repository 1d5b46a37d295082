"""Host aliases, host groups by tiers of schemes, and checks of how tiers nest."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variables as V

ALIAS_SCHEMA = "token string, alias string, grp string"


def normal_host(host: Column) -> Column:
    """Addresses in canonical form, names in lower case."""
    return F.coalesce(V.canonical_ip(host), F.lower(host))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """token, alias, grp from a file: ``[group]`` headers, lines of members, ``<alias>`` first if there is one, ``#`` comments."""
    rows, group = [], None
    with open(path) as f:
        for raw in f:
            line = raw.split("#")[0].strip()
            if not line:
                continue
            if m := re.fullmatch(r"\[(.+)\]", line):
                group = m[1]
                continue
            names = line.split()
            alias = names.pop(0)[1:-1] if re.fullmatch(r"<.+>", names[0]) else None
            rows += [(n, alias or n, group) for n in names] + ([(alias, alias, group)] if alias else [])
    raw = spark.createDataFrame(rows, ALIAS_SCHEMA)
    return raw.withColumn("token", normal_host(F.col("token"))).dropDuplicates(["token"])


def resolve_aliases(hosts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``hosts`` (host) with alias and grp, null where unknown. The alias table is small and Catalyst broadcasts it by its size."""
    return hosts.withColumn("__t", normal_host(F.col("host"))).join(aliases.withColumnRenamed("token", "__t"), "__t", "left").drop("__t")


def python_replacement(host: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    r"""What a match expands to: ``\1`` stands for groups, the rest of the host is dropped; null without a match."""
    regex = ("(?i)" if ignore_case else "") + pattern
    pieces = [F.regexp_extract(host, regex, int(p[1:])) if re.fullmatch(r"\\\d", p) else F.lit(p) for p in re.split(r"(\\\d)", replacement) if p]
    return F.when(host.rlike(regex), F.concat(*pieces))


@dataclass
class Tier:
    """Schemes in order; the first that gives a group decides. unmatched: keep (the host itself) or drop."""

    name: str
    schemes: list[dict] = field(default_factory=list)
    unmatched: str = "keep"

    def group(self, host: Column, alias: Column | None = None) -> Column:
        """The host's group in this tier; ``alias`` is the host's alias for schemes that use it."""
        found = []
        for s in self.schemes:
            kind = s.get("kind", "regex")
            if kind == "regex":
                replacement = s.get("replacement", r"\1")
                found.append(python_replacement(host, s["pattern"], replacement, s.get("ignore_case", False)))
            elif kind == "ipaddr":
                found.append(V.canonical_ip(host))
            elif kind == "hostalias":
                found.append(alias if alias is not None else F.lit(None).cast("string"))
            else:
                raise ValueError(f"unknown scheme {kind}")
        return F.coalesce(*found, *([host] if self.unmatched == "keep" else []), F.lit(None).cast("string"))


def load_tiers(path: str) -> list[Tier]:
    """Tiers from an ini file: [general] tiers, unmatched; [tier_<name>] schemes; [scheme_<name>] kind, pattern, replacement, ignorecase."""
    ini = configparser.ConfigParser(interpolation=None)
    if not ini.read(path):
        raise FileNotFoundError(path)
    names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    out = []
    for tier in names(ini.get("general", "tiers")):
        section = f"tier_{tier}"
        schemes = []
        for s in names(ini.get(section, "schemes")):
            own = ini[f"scheme_{s}"]
            schemes.append({"kind": own.get("kind", "regex"), "pattern": own.get("pattern"), "replacement": own.get("replacement", r"\1"), "ignore_case": own.getboolean("ignorecase", False)})
        policy = ini.get(section, "unmatched", fallback=ini.get("general", "unmatched", fallback="keep"))
        if policy not in ("keep", "drop", "drop_alert"):
            raise ValueError(f"unknown policy {policy}")
        out.append(Tier(tier, schemes, policy))
    return out


def host_groups(hosts: DataFrame, tiers: list[Tier]) -> DataFrame:
    """tier, host, hgid for every host (column host, and alias if there) and tier that has a group for it."""
    alias = F.col("alias") if "alias" in hosts.columns else None
    made = F.array(*(F.struct(F.lit(t.name).alias("tier"), t.group(F.col("host"), alias).alias("hgid")) for t in tiers))
    return hosts.select("host", F.explode(made).alias("g")).select("g.tier", "host", "g.hgid").where("hgid is not null")


def unmatched_hosts(hosts: DataFrame, tier: Tier) -> DataFrame:
    """Hosts that no scheme of the tier matches, whatever its policy."""
    strict = Tier(tier.name, tier.schemes, "drop")
    alias = F.col("alias") if "alias" in hosts.columns else None
    return hosts.where(strict.group(F.col("host"), alias).isNull()).select("host")


def nesting_violations(hg: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Groups of the fine tier whose hosts lie in several groups of the coarse one."""
    a = hg.where(F.col("tier") == fine).select("host", F.col("hgid").alias("fine"))
    b = hg.where(F.col("tier") == coarse).select("host", F.col("hgid").alias("coarse"))
    return a.join(b, "host").groupBy("fine").agg(F.countDistinct("coarse").alias("n_coarse")).where("n_coarse > 1")


def ordering_violations(hg: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Hosts that the coarse tier has and the fine one has not."""
    host = lambda t: hg.where(F.col("tier") == t).select("host")
    return host(coarse).join(host(fine), "host", "left_anti")


def group_members(hg: DataFrame, all_hosts: DataFrame, tier: str) -> DataFrame:
    """hgid and its hosts (sorted, joined by commas); a tier that was never made has every host as its own group."""
    rows = hg.where(F.col("tier") == tier)
    source = rows if not rows.isEmpty() else all_hosts.select("host", F.col("host").alias("hgid"))
    return source.groupBy("hgid").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))
