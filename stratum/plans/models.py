"""Models and their prices, tiers and ladders, usage and failure classes."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import estimate_tokens
from .limits import Limits, RateLimiter

# Failure classes.
TRANSIENT, SEMANTIC, PERMANENT, BUDGET = "transient", "semantic", "permanent", "budget"

USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "requests", "cost_usd")


class ModelError(Exception):
    def __init__(self, message: str, kind: str = PERMANENT):
        super().__init__(message)
        self.kind = kind


def classify_status(status: int | None, refused: bool = False) -> str:
    """429 and 500 up are transient, other 4xx permanent, no status (network) transient, a refusal semantic."""
    if refused:
        return SEMANTIC
    if status is None or status == 429 or status >= 500:
        return TRANSIENT
    return PERMANENT


@dataclass(frozen=True)
class Pricing:
    """Dollars per million tokens; cached reads default to 0.10 and cache writes to 1.25 of the input price."""

    input: float = 0.0
    output: float = 0.0
    cache_read: float | None = None
    cache_write: float | None = None

    @property
    def read(self) -> float:
        return 0.10 * self.input if self.cache_read is None else self.cache_read

    @property
    def write(self) -> float:
        return 1.25 * self.input if self.cache_write is None else self.cache_write

    def cost(self, inp: Column, out: Column, read: Column | None = None, write: Column | None = None) -> Column:
        read, write = read if read is not None else F.lit(0), write if write is not None else F.lit(0)
        return (inp * self.input + out * self.output + read * self.read + write * self.write) / 1e6

    def cost_of(self, inp: float, out: float, read: float = 0, write: float = 0) -> float:
        return (inp * self.input + out * self.output + read * self.read + write * self.write) / 1e6


@dataclass(frozen=True)
class Model:
    """`answer` makes a response Column from a prompt Column (expression model), or `call` a response from a prompt text (UDF model).

    An answer of null is a semantic failure.  `call` may raise ModelError.  With
    `tasks`, that many tasks call side by side, each within its share of the
    limits, so together they keep to them.
    """

    name: str
    tier: str = "fast"
    pricing: Pricing = field(default_factory=Pricing)
    answer: Callable[[Column], Column] | None = None
    call: Callable[[str], str] | None = None
    requests_per_minute: int = 0
    tokens_per_minute: int = 0
    max_concurrent: int = 0
    tasks: int = 0

    def respond(self, df: DataFrame, prompt_col: str, out_col: str) -> DataFrame:
        """Adds the response; the UDF form also adds <out>_error and <out>_class."""
        if self.answer is not None:
            return df.withColumns({out_col: self.answer(F.col(prompt_col)), f"{out_col}_error": F.lit(None).cast("string"), f"{out_col}_class": F.lit(None).cast("string")})
        call, at, names, limits = self.call, df.columns.index(prompt_col), df.columns, None
        if self.tasks:
            df, limits = df.repartition(self.tasks), Limits(self.requests_per_minute, self.tokens_per_minute, self.max_concurrent).share(self.tasks)
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in (out_col, f"{out_col}_error", f"{out_col}_class"))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limiter, own = RateLimiter(), call
            if limits is not None:

                def own(prompt: str) -> str:
                    with limiter.admit("", limits, len(prompt.encode()) // 4 + 1):
                        return call(prompt)

            for b in batches:
                got = [call_with_retry(own, p) for p in b.column(at).to_pylist()]
                extra = [pa.array(c, pa.string()) for c in (zip(*got, strict=True) if got else ([], [], []))]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, out_col, f"{out_col}_error", f"{out_col}_class"])

        return df.mapInArrow(run, schema)


def retry_delay(attempt: int, base: float = 0.2, most: float = 5.0, jitter: float = 0.2, seed: int = 0) -> float:
    """Exponential with a ceiling; jitter is a share of it, drawn from the seed."""
    delay = min(most, base * 2 ** max(attempt - 1, 0))
    return delay * (1 + jitter * (2 * random.Random(f"{seed}:{attempt}").random() - 1))


def call_with_retry(call: Callable[[str], str], prompt: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(response, error, class): transient failures are tried again, others are not."""
    error, kind = None, None
    for k in range(1, attempts + 1):
        try:
            return call(prompt), None, None
        except ModelError as e:
            error, kind = str(e), e.kind
        except TimeoutError as e:
            error, kind = str(e), TRANSIENT
        except Exception as e:
            error, kind = str(e), PERMANENT
        if kind != TRANSIENT:
            break
        if k < attempts:
            sleep(min(retry_delay(k), 0.01 * k))
    return None, error, kind


class Registry:
    """Models by name and tier; the first of a tier answers for it."""

    def __init__(self, *models: Model):
        self.models: dict[str, Model] = {}
        for m in models:
            self.add(m)

    def add(self, model: Model) -> Model:
        if model.name in self.models:
            raise ValueError(f"model {model.name!r} is registered twice")
        self.models[model.name] = model
        return model

    def tier(self, tier: str) -> Model:
        for m in self.models.values():
            if m.tier == tier:
                return m
        raise KeyError(f"no model of tier {tier!r}")


@dataclass(frozen=True)
class Binding:
    """A model by name, or a tier; and the tiers or names that a semantic failure climbs to."""

    model: str = ""
    tier: str = ""
    escalate: tuple[str, ...] = ()

    def candidates(self, registry: Registry) -> list[Model]:
        """The ladder, without repeats."""
        out: list[Model] = []
        for ref in (self.model or self.tier, *self.escalate):
            m = registry.models[ref] if ref in registry.models else registry.tier(ref)
            if m not in out:
                out.append(m)
        return out

    def resolve(self, registry: Registry, rung: int) -> Model:
        ladder = self.candidates(registry)
        return ladder[min(max(rung, 0), len(ladder) - 1)]


def usage_columns(prompt: Column, response: Column, pricing: Pricing) -> dict[str, Column]:
    """Usage of a call without prefix caching."""
    inp, out = estimate_tokens(prompt), estimate_tokens(F.coalesce(response, F.lit("")))
    zero = F.lit(0).cast("bigint")
    return {"input_tokens": inp, "output_tokens": out, "cache_read_tokens": zero, "cache_write_tokens": zero, "requests": F.lit(1).cast("bigint"), "cost_usd": pricing.cost(inp, out)}
