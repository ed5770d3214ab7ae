"""Rate limits of models: buckets of requests and tokens that refill evenly, slots for calls in flight, planned admission."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import with_key_seq


@dataclass(frozen=True)
class Limits:
    """Per minute, and at once; 0: no limit."""

    requests_per_minute: float = 0
    tokens_per_minute: float = 0
    max_concurrent: int = 0

    def share(self, tasks: int) -> Limits:
        """One task's part where `tasks` tasks call side by side."""
        n = max(tasks, 1)
        return Limits(self.requests_per_minute / n, self.tokens_per_minute / n, -(-self.max_concurrent // n))


class _Bucket:
    """A minute's worth, full at first.  A share of under one request holds one all the same, so that it fills."""

    def __init__(self, per_minute: float, now: float, least: float = 0.0):
        self.rate, self.cap, self.at = per_minute / 60, max(per_minute, least if per_minute else 0.0), now
        self.level = self.cap

    def wait(self, need: float, now: float) -> float:
        """Seconds until it covers the need; 0 where it does."""
        if not self.rate:
            return 0.0
        self.level, self.at = min(self.cap, self.level + max(0.0, now - self.at) * self.rate), max(self.at, now)
        short = need - self.level
        return short / self.rate if short > 1e-9 else 0.0


class RateLimiter:
    """Admission by model.  A request of more tokens than a minute's waits for a full bucket.  Rates come first, then the slot: none is held while waiting."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.buckets: dict[str, tuple[_Bucket, _Bucket]] = {}
        self.slots: dict[str, threading.BoundedSemaphore] = {}

    def __reduce__(self):
        return RateLimiter, ()

    def _rates(self, model: str, limits: Limits, tokens: float) -> float:
        """Takes what a request needs and returns 0, or takes nothing and returns how long to wait."""
        with self.lock:
            now = self.clock()
            if model not in self.buckets:
                self.buckets[model] = (_Bucket(limits.requests_per_minute, now, 1.0), _Bucket(limits.tokens_per_minute, now))
            requests, spend = self.buckets[model]
            need = min(float(tokens), spend.cap)
            wait = max(requests.wait(1.0, now), spend.wait(need, now))
            if not wait:
                requests.level -= 1.0
                spend.level -= need
            return wait

    @contextmanager
    def admit(self, model: str, limits: Limits, tokens: float = 0) -> Iterator[None]:
        """Waits for admission; the slot is held for as long as the block runs."""
        while wait := self._rates(model, limits, tokens):
            self.sleep(max(wait, 0.01))
        if not limits.max_concurrent:
            yield
            return
        with self.lock:
            slot = self.slots.setdefault(model, threading.BoundedSemaphore(limits.max_concurrent))
        with slot:
            yield


def admission(calls: DataFrame, limits: Limits, *, model: str = "model", tokens: Column | None = None, order: str = "id", chunk: int = 4096) -> DataFrame:
    """Adds `admitted`: seconds after the start at which each call is let in, where all calls of a model stand ready in an order.

    For one rate, of requests or of tokens: a bucket that calls wait for never
    overflows, so a call's time follows from the sum of what it and all before
    it need.  Sums go by chunks of the order, so no task sees all of a model's
    calls.  Two rates together hold at run time only (`RateLimiter`).
    """
    if bool(limits.requests_per_minute) == bool(limits.tokens_per_minute):
        raise ValueError("one rate, of requests or of tokens")
    cap = float(limits.requests_per_minute or limits.tokens_per_minute)
    need = F.lit(1.0) if limits.requests_per_minute else F.least(F.coalesce(tokens, F.lit(0)).cast("double"), F.lit(cap))
    d = with_key_seq(calls.withColumn("__need", need), model, order).withColumn("__chunk", F.floor(F.col("_seq") / chunk))
    upto = lambda *by: Window.partitionBy(*by)
    sums = d.groupBy(F.col(model).alias("__model"), F.col("__chunk").alias("__c")).agg(F.sum("__need").alias("__sum"))
    before = F.sum("__sum").over(upto("__model").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__model", "__c", F.coalesce(before, F.lit(0.0)).alias("__before"))
    own = F.sum("__need").over(upto(model, "__chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__own", own).join(sums, F.col(model).eqNullSafe(F.col("__model")) & (F.col("__chunk") == F.col("__c")))
    late = F.greatest(F.lit(0.0), (F.col("__before") + F.col("__own") - cap) / (cap / 60))
    return d.withColumn("admitted", late).select(*calls.columns, "admitted")
