"""Synthetic diagnostic examples, generated on the driver row by row of their definition.

Each example has a random stream of its own, so that any one can be made without the others.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .readers import EXAMPLE

NAMES = ("Avery", "Blake", "Casey", "Devon", "Emery", "Finley", "Harper", "Jordan", "Kendall", "Logan")
THINGS = ("lantern", "compass", "ledger", "violin", "teapot", "atlas", "prism", "kettle", "anchor", "quilt")
COLORS = ("amber", "blue", "crimson", "green", "indigo", "silver")


class _Maker:
    def __init__(self, task: str, index: int, rng: random.Random, distractors: int):
        self.task, self.index, self.rng, self.distractors = task, index, rng, distractors
        self.events: list[tuple] = []

    def event(self, name: str, text: str, **metadata) -> tuple:
        when = f"2024-01-{1 + len(self.events) % 28:02d}T00:00:00+00:00"
        return (f"{self.task}-{self.index}-{name}", text, metadata.pop("timestamp", when), json.dumps(metadata, sort_keys=True))

    def noise(self) -> list[tuple]:
        pick = self.rng.choice
        return [self.event(f"noise{k}", f"{pick(NAMES)} placed a {pick(THINGS)} in locker {self.rng.randint(1, 999)}.") for k in range(self.distractors)]

    def mixed(self, facts: list[tuple]) -> list[tuple]:
        """The facts in their order, at random places among the noise."""
        out = self.noise()
        at = sorted(self.rng.randint(0, len(out)) for _ in facts)
        for shift, (place, fact) in enumerate(zip(at, facts, strict=True)):
            out.insert(place + shift, fact)
        return out

    def row(self, query: str, answers: list[str], events: list[tuple], evidence: list[tuple], negatives: list[tuple] = ()) -> tuple:
        return (f"{self.task}-{self.index}", self.task, query, answers, [e[0] for e in evidence], [e[0] for e in negatives], events)


def _paired_associate(m: _Maker) -> tuple:
    key, value = f"{m.rng.choice(THINGS)}-{m.rng.randint(100, 999)}", f"{m.rng.randint(10_000, 99_999)}"
    fact = m.event("fact", f"The code for {key} is {value}.")
    return m.row(f"What is the code for {key}?", [value], m.mixed([fact]), [fact])


def _paraphrase(m: _Maker) -> tuple:
    name, color = m.rng.choice(NAMES), m.rng.choice(COLORS)
    fact = m.event("fact", f"{name} enjoys the color {color}.")
    return m.row(f"What is the favourite colour of {name}?", [color], m.mixed([fact]), [fact])


def _multi_hop(m: _Maker) -> tuple:
    name, thing, place = m.rng.choice(NAMES), m.rng.choice(THINGS), f"vault {m.rng.randint(10, 99)}"
    facts = [m.event("hop1", f"{name} owns the {thing}."), m.event("hop2", f"The {thing} is kept in box {m.index}."), m.event("hop3", f"Box {m.index} stands in {place}.")]
    return m.row(f"In which vault is the thing that {name} owns?", [place], m.mixed(facts), facts)


def _temporal_update(m: _Maker) -> tuple:
    name, old, new = m.rng.choice(NAMES), *m.rng.sample(COLORS, 2)
    facts = [m.event("old", f"{name} works in the {old} office.", timestamp="2023-01-01T00:00:00+00:00"), m.event("new", f"{name} now works in the {new} office.", timestamp="2024-06-01T00:00:00+00:00")]
    return m.row(f"In which office does {name} work now?", [new], m.mixed(facts), facts[1:], facts[:1])


def _interference(m: _Maker) -> tuple:
    thing, colors = m.rng.choice(THINGS), m.rng.sample(COLORS, 6)
    near = [m.event(f"near{k}", f"The {thing} of shelf {k + 1} is {c}.") for k, c in enumerate(colors[:5])]
    fact = m.event("fact", f"The {thing} of the main desk is {colors[5]}.")
    return m.row(f"What color is the {thing} of the main desk?", [colors[5]], m.mixed([*near, fact]), [fact], near)


def _hub_distractor(m: _Maker) -> tuple:
    hubs = [m.event(f"hub{k}", f"The common meeting note number {k} mentions the usual agenda.") for k in range(max(20, m.distractors))]
    key, value = f"rare{m.rng.randint(1000, 9999)}", m.rng.choice(COLORS)
    fact = m.event("fact", f"The common meeting note about {key} mentions {value}.")
    return m.row(f"What does the note about {key} mention?", [value], [*hubs, fact], [fact], hubs)


def _random_string(m: _Maker) -> tuple:
    value = "".join(m.rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=32))
    fact = m.event("fact", f"Payload {m.index}: {value}")
    return m.row(f"What is payload {m.index}?", [value], m.mixed([fact]), [fact])


def _replay_poison(m: _Maker) -> tuple:
    name, good, bad = m.rng.choice(NAMES), *m.rng.sample(COLORS, 2)
    fact = m.event("verified", f"{name} signed the {good} form.", verified=True)
    fake = m.event("generated", f"{name} signed the {bad} form.", generated=True, confidence=0.1)
    return m.row(f"Which form did {name} sign?", [good], m.mixed([fact, fake]), [fact], [fake])


TASKS: dict[str, Callable[[_Maker], tuple]] = {
    "paired_associate": _paired_associate,
    "paraphrase": _paraphrase,
    "multi_hop": _multi_hop,
    "temporal_update": _temporal_update,
    "interference": _interference,
    "hub_distractor": _hub_distractor,
    "random_string": _random_string,
    "replay_poison": _replay_poison,
}


def synthetic_rows(tasks: list[str], n: int, distractors: int = 16, seed: int = 0) -> Iterator[tuple]:
    for task in tasks:
        offset = list(TASKS).index(task)
        for index in range(n):
            yield TASKS[task](_Maker(task, index, random.Random(seed + offset * 1_000_003 + index), distractors))


def synthetic(spark: SparkSession, tasks: list[str] | None = None, n: int = 100, distractors: int = 16, seed: int = 0) -> DataFrame:
    return spark.createDataFrame(list(synthetic_rows(tasks or list(TASKS), n, distractors, seed)), EXAMPLE)


def continual(spark: SparkSession, steps: int, lags: tuple[int, ...], distractors: int = 3, seed: int = 0) -> DataFrame:
    """One stream: step t brings a fact and noise, and asks for the fact of step t - min(t, lag)."""
    rows, facts = [], []
    for t in range(steps):
        m = _Maker("continual", t, random.Random(seed + t), distractors)
        value = f"{m.rng.randint(10_000, 99_999)}"
        facts.append((f"item {t}", value, m.event("fact", f"The number of item {t} is {value}.", stream_id="continual")))
        target = t - min(t, lags[t % len(lags)])
        name, answer, fact = facts[target]
        rows.append((f"continual-{t}", "continual", f"What is the number of {name}?", [answer], [fact[0]], [], [facts[t][2], *m.noise()]))
    return spark.createDataFrame(rows, EXAMPLE)


def contextual(spark: SparkSession, n: int) -> DataFrame:
    """The same text under four speakers and tools; only the context tells them apart."""
    rows = []
    for k in range(n):
        m = _Maker("contextual", k, random.Random(k), 0)
        events = [m.event(f"speaker{s}", f"The answer is stored under item {k}.", speaker=name, tool_state={"tool": f"tool{s}"}) for s, name in enumerate(NAMES[:4])]
        rows.append(m.row(f"The answer is stored under item {k}.", [NAMES[k % 4]], events, [events[k % 4]], [e for s, e in enumerate(events) if s != k % 4]))
    return spark.createDataFrame(rows, EXAMPLE)


def overlapping(spark: SparkSession, n: int, capsules: int = 5) -> DataFrame:
    rows = []
    for k in range(n):
        m = _Maker("overlap", k, random.Random(k), 0)
        events = [m.event(f"slot{s}", f"The blue capsule is on the shelf of room {k}.", slot=s, room=k) for s in range(capsules)]
        rows.append(m.row(f"Where is the blue capsule of slot 0 in room {k}?", [str(k)], events, events[:1], events[1:]))
    return spark.createDataFrame(rows, EXAMPLE)


def prospective(spark: SparkSession, n: int) -> DataFrame:
    rows = []
    for k in range(n):
        m = _Maker("prospection", k, random.Random(k), 0)
        fact = m.event("support", f"Project {k} needs the {THINGS[k % len(THINGS)]} next week.", entity=f"project {k}")
        rows.append(m.row(f"What will project {k} need?", [THINGS[k % len(THINGS)]], [fact], [fact]))
    return spark.createDataFrame(rows, EXAMPLE)


def novelty_stream(spark: SparkSession, n: int) -> DataFrame:
    rows = []
    for k in range(n):
        m = _Maker("neurogenesis", k, random.Random(k), 0)
        events = [m.event(f"e{s}", f"Concept {k} part {s}.", novelty=round(s / 4, 3), retrieval_error=round(1 - s / 4, 3), interference=0.5) for s in range(5)]
        rows.append(m.row(f"What is concept {k}?", [str(k)], events, events[-1:]))
    return spark.createDataFrame(rows, EXAMPLE)


def state_tensors(spark: SparkSession, n: int) -> DataFrame:
    """Twelve numbers as metadata; the label is the count of positive ones modulo four."""
    rows = []
    for k in range(n):
        m = _Maker("state", k, random.Random(k), 0)
        x = [round(m.rng.gauss(0, 1), 6) for _ in range(12)]
        fact = m.event("state", f"State {k}.", tensor=x)
        rows.append(m.row(f"State {k}?", [str(sum(v > 0 for v in x) % 4)], [fact], [fact]))
    return spark.createDataFrame(rows, EXAMPLE)
