"""Prices before a run: projections, admission floors, budgets; usage reports after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import compile_template
from ..functions.values import estimate_tokens
from ..plans.models import USAGE, Model
from .reduce import levels

#: Share of the allowed output that an answer is expected to take.
EXPECTED = 0.35


@dataclass(frozen=True)
class Budget:
    """Zero means unlimited."""

    cost_usd: float = 0.0
    tokens: int = 0
    attempts: int = 0


@dataclass
class StageProjection:
    stage: str
    records: int = 0
    tasks: int = 0
    calls: int = 0
    prompt_tokens: int = 0
    cached_tokens: int = 0
    expected_output: int = 0
    ceiling_output: int = 0
    expected_usd: float = 0.0
    ceiling_usd: float = 0.0
    floor_seconds: float = 0.0
    exact: bool = True


@dataclass
class Projection:
    stages: list[StageProjection] = field(default_factory=list)

    def total(self, name: str) -> float:
        return sum(getattr(s, name) for s in self.stages)

    def admission_floor(self, pipelined: bool = False) -> float:
        """Seconds that rate limits alone take: stage after stage, or the longest where stages overlap."""
        floors = [s.floor_seconds for s in self.stages] or [0.0]
        return max(floors) if pipelined else sum(floors)

    def fits(self, budget: Budget) -> bool:
        tokens = self.total("prompt_tokens") + self.total("ceiling_output")
        return not (budget.cost_usd and self.total("ceiling_usd") > budget.cost_usd or budget.tokens and tokens > budget.tokens or budget.attempts and self.total("calls") > budget.attempts)


def expected_output(max_tokens: int, ratio: float = EXPECTED) -> int:
    return max(1, int(max_tokens * ratio))


def _priced(stage: StageProjection, model: Model, max_tokens: int, ratio: float, fresh: int, read: int, write: int) -> StageProjection:
    per = expected_output(max_tokens, ratio)
    stage.expected_output, stage.ceiling_output = stage.calls * per, stage.calls * max_tokens
    stage.prompt_tokens, stage.cached_tokens = fresh + read + write, read
    stage.expected_usd = model.pricing.cost_of(fresh, stage.expected_output, read, write)
    stage.ceiling_usd = model.pricing.cost_of(fresh, stage.ceiling_output, read, write)
    minutes = 0.0
    if model.requests_per_minute:
        minutes = stage.calls / model.requests_per_minute
    if model.tokens_per_minute:
        minutes = max(minutes, (stage.prompt_tokens + stage.ceiling_output) / model.tokens_per_minute)
    stage.floor_seconds = 60 * minutes
    return stage


def project_infer(df: DataFrame, name: str, model: Model, prompt: str, *, prefix: str = "", system: str = "", max_tokens: int = 1024, batch: int = 1, ratio: float = EXPECTED, cache: bool = True) -> StageProjection:
    """Calls and tokens of an inference stage over its real records, without a call.

    What all calls share (system prompt and prefix) is cached where the stage
    has more than one task; a stage of one task pays for it with every call.
    """
    tokens = estimate_tokens(compile_template(prompt, df.schema))
    n, fresh = df.agg(F.count("*"), F.coalesce(F.sum(tokens), F.lit(0))).first()
    tasks = -(-n // max(batch, 1))
    shared = sum(len(t.encode()) // 4 + 1 for t in (system, prefix) if t)
    write, read = (shared, shared * (n - 1)) if tasks > 1 and cache else (0, 0)
    if not write:
        fresh += shared * n
    return _priced(StageProjection(name, records=n, tasks=tasks, calls=n), model, max_tokens, ratio, int(fresh), read, write)


def project_reduce(n: int, name: str, model: Model, *, item_tokens: float, prompt_tokens: int = 0, fan_in: int = 8, max_tokens: int = 1024, ratio: float = EXPECTED) -> StageProjection:
    """Calls and tokens of a reduction, level by level: upper levels read expected answers."""
    calls, fresh, items, each = 0, 0, n, item_tokens
    for made in levels(n, fan_in):
        calls += made
        fresh += int(items * each) + made * prompt_tokens
        items, each = made, expected_output(max_tokens, ratio)
    return _priced(StageProjection(name, records=n, tasks=calls, calls=calls, exact=False), model, max_tokens, ratio, fresh, 0, 0)


def project_iterate(first: int, rounds: int, bound: int, name: str, model: Model, *, prompt_tokens: int, max_tokens: int = 1024, ratio: float = EXPECTED) -> StageProjection:
    """The first frontier, then the bound on frontiers for every further round."""
    calls = first + max(rounds - 1, 0) * bound
    return _priced(StageProjection(name, records=first, tasks=calls, calls=calls, exact=False), model, max_tokens, ratio, calls * prompt_tokens, 0, 0)


def usage_by_stage(calls: DataFrame, *, run: str = "run", stage: str = "stage") -> DataFrame:
    """Usage of every stage, run and all, in one pass; totals have null names."""
    return calls.rollup(run, stage).agg(*[F.sum(c).alias(c) for c in USAGE])
