"""Teachers behind an interface: budget, peak hours, retries, routing.  The one here answers offline, always the same."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Busy(Exception):
    """A status that asks to try again later."""


@dataclass
class Usage:
    """Tokens in, out and thought, by teacher."""

    rows: list[dict] = field(default_factory=list)

    def add(self, teacher: str, tokens_in: int, tokens_out: int, thought: int = 0) -> None:
        self.rows.append({"teacher": teacher, "in": tokens_in, "out": tokens_out, "think": thought})

    def total(self) -> int:
        return sum(r["in"] + r["out"] + r["think"] for r in self.rows)


def is_peak(hours: tuple[tuple[int, int], ...], now: dt.datetime | None = None) -> bool:
    """Whether the UTC hour falls in one of the half-open ranges."""
    hour = (now or dt.datetime.now(dt.timezone.utc)).hour
    return any(a <= hour < b for a, b in hours)


def offline(prompt: str) -> str:
    """A stub: JSON with a user and an assistant text made from the prompt's digest."""
    mark = hashlib.md5(prompt.encode()).hexdigest()
    return json.dumps({"user": f"Question {mark[:8]}?", "assistant": f"Answer {mark[8:16]}. " * 12})


@dataclass
class Router:
    """Teachers by weight, with retries, waits that double, a rest for teachers that stay busy, and a cap on tokens."""

    teachers: dict[str, Callable[[str], str]]
    weights: dict[str, float]
    cap: int = 1_000_000
    tries: int = 3
    rest: int = 10
    sleep: Callable[[float], None] = lambda s: None
    usage: Usage = field(default_factory=Usage)
    resting: dict[str, int] = field(default_factory=dict)
    asked: int = 0

    def order(self, prompt: str) -> list[str]:
        """All teachers that do not rest; the first by weight from the prompt's digest, the others by weight."""
        awake = [t for t in self.teachers if self.resting.get(t, 0) <= self.asked] or list(self.teachers)
        u = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) / 2**32 * sum(self.weights[t] for t in awake)
        first = awake[-1]
        for t in awake:
            if u < self.weights[t]:
                first = t
                break
            u -= self.weights[t]
        return [first, *sorted((t for t in awake if t != first), key=lambda t: -self.weights[t])]

    def ask(self, prompt: str) -> str | None:
        """A reply, or null if the cap is reached or all stay busy."""
        self.asked += 1
        if self.usage.total() >= self.cap:
            return None
        for t in self.order(prompt):
            for k in range(self.tries):
                try:
                    reply = self.teachers[t](prompt)
                except Busy:
                    self.sleep(2.0**k)
                    continue
                self.usage.add(t, len(prompt.split()), len(reply.split()))
                return reply
            self.resting[t] = self.asked + self.rest
        return None


def generate(prompts: DataFrame, make: Callable[[], Router], prompt_col: str = "prompt", tasks: int = 8, already: int = 0) -> DataFrame:
    """``prompts`` with ``reply``.  One cap holds for the job: what is ``already`` spent comes off it and each task has its share of the rest.

    A prompt beyond its task's share has a null reply and can be asked again in a later run.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = make()
        router.cap = max(0, router.cap - already) // tasks
        for b in batches:
            yield b.assign(reply=[router.ask(p) for p in b[prompt_col]])

    return prompts.repartition(tasks).mapInPandas(run, f"{schema}, reply string")


def spent(ledgers: DataFrame) -> DataFrame:
    """Tokens over all ledgers; missing figures count 0."""
    return ledgers.agg(F.coalesce(F.sum(F.coalesce("in", F.lit(0)) + F.coalesce("out", F.lit(0)) + F.coalesce("think", F.lit(0))), F.lit(0)).alias("tokens"))
