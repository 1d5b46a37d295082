"""Options: an ini file over defaults, with imports of other files, and a few value parsers."""

from __future__ import annotations

import configparser
import os

from .functions.variables import parse_duration

ENVIRONMENT = "LOGLOOM_CONFIG"
DEFAULTS = {
    "general": {"src_path": "", "src_recur": "false", "format": "syslog", "year": "", "import": ""},
    "store": {"path": "logloom-store"},
    "parse": {"undefined_host": "false", "dummy_host": "dummy", "host_alias": ""},
    "generate": {"methods": "drain", "batch": "100000", "mode": "offline", "feedback": "false"},
    "drain": {"threshold": "0.3", "depth": "3", "rules": ""},
    "lenma": {"threshold": "0.9", "n_same": "3", "head_rule": "true"},
    "shiso": {"threshold": "0.9", "max_child": "4"},
    "fttree": {"max_child": "6", "cut_depth": "3", "message_type": "none"},
    "va": {"method": "relative-variable", "threshold": "0.4"},
    "import": {"definitions": "", "search": "tree", "shuffle": "false"},
    "import-ext": {"templates": "", "placeholder": "<*>", "mode": "plain"},
    "crf": {"model": "", "train": "", "features": "", "sample": "random", "n_sample": "1000", "rounds": "10"},
    "eval": {"answer": "", "trials": "10", "trials_time": "5"},
    "re": {"rules": ""},
    "group": {"method": "none"},
    "tag": {"rules": "", "mode": "group"},
    "hosts": {"groups": ""},
}


def open_config(path: str | None = None, _seen: tuple[str, ...] = ()) -> configparser.ConfigParser:
    """Defaults, then imported files, then the file itself (or the one that the environment names); cycles are an error."""
    out = configparser.ConfigParser(interpolation=None)
    out.read_dict(DEFAULTS)
    path = path or os.environ.get(ENVIRONMENT)
    if not path:
        return out
    real = os.path.realpath(path)
    if real in _seen:
        raise ValueError(f"configuration imports itself: {path}")
    own = configparser.ConfigParser(interpolation=None)
    if not own.read(real):
        raise FileNotFoundError(path)
    if other := own.get("general", "import", fallback=""):
        merge(out, open_config(os.path.join(os.path.dirname(real), other), (*_seen, real)))
    merge(out, own)
    return out


def merge(base: configparser.ConfigParser, over: configparser.ConfigParser) -> None:
    for section in over.sections():
        if not base.has_section(section):
            base.add_section(section)
        for k, v in over.items(section):
            base.set(section, k, v)


def difference(a: configparser.ConfigParser, b: configparser.ConfigParser) -> list[tuple[str, str, str | None, str | None]]:
    """(section, option, value in a, value in b) wherever they differ."""
    out = []
    for section in sorted({*a.sections(), *b.sections()}):
        names = {*(a.options(section) if a.has_section(section) else []), *(b.options(section) if b.has_section(section) else [])}
        for name in sorted(names):
            x, y = (c.get(section, name, fallback=None) for c in (a, b))
            if x != y:
                out.append((section, name, x, y))
    return out


def minimum(conf: configparser.ConfigParser) -> configparser.ConfigParser:
    """Only what differs from the defaults."""
    plain = configparser.ConfigParser(interpolation=None)
    plain.read_dict(DEFAULTS)
    out = configparser.ConfigParser(interpolation=None)
    for section, name, _, value in difference(plain, conf):
        if value is not None:
            if not out.has_section(section):
                out.add_section(section)
            out.set(section, name, value)
    return out


def set_option(path: str, section: str, option: str, value: str) -> None:
    """Set one option in a file, which keeps everything else but its comments."""
    own = configparser.ConfigParser(interpolation=None)
    if not own.read(path):
        raise FileNotFoundError(path)
    if not own.has_section(section):
        own.add_section(section)
    own.set(section, option, value)
    with open(path, "w") as f:
        own.write(f)


def get_list(conf: configparser.ConfigParser, section: str, name: str) -> list[str]:
    return [x.strip() for x in conf.get(section, name).split(",") if x.strip()]


def get_map(conf: configparser.ConfigParser, section: str, name: str) -> dict[str, str]:
    return dict(x.split(":", 1) for x in get_list(conf, section, name))


def get_duration(conf: configparser.ConfigParser, section: str, name: str):
    return parse_duration(conf.get(section, name))


def load_groups(path: str) -> dict[str, list[str]]:
    """Group definitions: ``[group]`` headers and one member a line; ``#`` begins a comment."""
    out: dict[str, list[str]] = {}
    current = None
    with open(path) as f:
        for raw in f:
            line = raw.split("#")[0].strip()
            if line.startswith("[") and line.endswith("]"):
                current = out.setdefault(line[1:-1], [])
            elif line and current is not None:
                current.append(line)
    return out
