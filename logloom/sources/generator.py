"""Synthetic system logs for tests: events that occur hourly, daily or by chance, each with messages on their own or other hosts."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta


@dataclass
class Message:
    """mode: each (at once), delay (a random time later), drop (with a probability only) or other (on another host of a group)."""

    form: str
    mode: str = "each"
    delay: tuple[float, float] = (30.0, 60.0)
    drop: float = 0.0
    group: str | None = None


@dataclass
class Event:
    """occurrence: hourly, daily or random (``frequency`` a day and host); a random one recurs with probability ``recur``."""

    groups: list[str]
    messages: list[Message]
    occurrence: str = "random"
    frequency: float = 1.0
    recur: float = 0.0
    recur_after: tuple[float, float] = (60.0, 600.0)
    info: dict[str, list[str]] = field(default_factory=dict)


class LogGenerator:
    """Lines ``time host message`` in the order of time; the same seed gives the same lines."""

    def __init__(self, hosts: dict[str, list[str]], events: list[Event], top: datetime, end: datetime, seed: int = 0):
        self.hosts, self.events, self.top, self.end, self.rng = hosts, events, top, end, random.Random(seed)

    def _times(self, event: Event) -> Iterator[datetime]:
        if event.occurrence in ("hourly", "daily"):
            step = timedelta(hours=1 if event.occurrence == "hourly" else 24)
            now = self.top
            while now < self.end:
                yield now
                now += step
            return
        now = self.top
        while True:
            now += timedelta(days=self.rng.expovariate(event.frequency))
            if now >= self.end:
                return
            yield now
            again = now
            while self.rng.random() < event.recur:
                again += timedelta(seconds=self.rng.uniform(*event.recur_after))
                if again < self.end:
                    yield again

    def lines(self) -> list[str]:
        made: list[tuple[datetime, str, str]] = []
        for event in self.events:
            for host in [h for g in event.groups for h in self.hosts[g]]:
                for now in self._times(event):
                    values = {k: self.rng.choice(v) for k, v in event.info.items()} | {"pid": str(self.rng.randrange(1, 65536)), "host": host}
                    for m in event.messages:
                        if self.rng.random() < m.drop:
                            continue
                        at = now + timedelta(seconds=self.rng.uniform(*m.delay)) if m.mode == "delay" else now
                        where = self.rng.choice([h for h in self.hosts[m.group or event.groups[0]] if h != host]) if m.mode == "other" else host
                        if at < self.end:
                            made.append((at, where, re.sub(r"\$(\w+)\$", lambda x, v=values: v[x[1]], m.form)))
        return [f"{dt:%Y-%m-%d %H:%M:%S} {host} {text}" for dt, host, text in sorted(made)]


def example(seed: int = 11, days: int = 21) -> LogGenerator:
    """An invented archive: front ends that take requests, stores that hold volumes, and a tape robot."""
    top = datetime(2031, 3, 3)
    sites = {"front": [f"front-{c}" for c in "abcd"], "store": [f"store{i:02d}.archive.invalid" for i in range(1, 8)], "robot": ["robot-1", "robot-2"]}
    events = [
        Event(["front", "store"], [Message("keeper[$pid$]: lease for $user$ renewed, ttl=3600")], "hourly", info={"user": ["keeper", "ingest"]}),
        Event(["store"], [Message("scrub of volume $volume$ finished without errors")], "daily", info={"volume": [f"vol{i}" for i in range(40)]}),
        Event(
            ["front"],
            [Message("carrier lost on port $port$"), Message("carrier back on port $port$", "delay"), Message("requests through port $port$ are held", drop=0.6)],
            frequency=0.3, recur=0.5, info={"port": ["p1", "p2", "p3", "p4"]},
        ),
        Event(["robot"], [Message("cartridge $slot$ stuck, door opened by operator", "other", group="robot")], frequency=0.5, info={"slot": [f"s{i}" for i in range(90)]}),
    ]
    return LogGenerator(sites, events, top, top + timedelta(days=days), seed)


#: The templates of ``example``, as its tokens are split.
EXAMPLE_TEMPLATES = [
    "keeper ** lease for ** renewed ttl 3600",
    "scrub of volume ** finished without errors",
    "carrier lost on port **",
    "carrier back on port **",
    "requests through port ** are held",
    "cartridge ** stuck door opened by operator",
]
