"""Several pipelines in one session: fair pools, a shared blackboard, an event bus."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import canonical_json, content_hash
from ..storage import append, read_appended


class Bus:
    """Events as rows: handlers see each one, and the rows make a frame for reports."""

    def __init__(self):
        self.rows: list[dict] = []
        self.handlers: list[Callable[[dict], None]] = []

    def on(self, handler: Callable[[dict], None]) -> None:
        self.handlers.append(handler)

    def publish(self, kind: str, **fields) -> None:
        event = {"at": time.time(), "kind": kind, **fields}
        self.rows.append(event)
        for h in self.handlers:
            h(event)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e["at"], e["kind"], str(e.get("agent", "")), canonical_json({k: v for k, v in e.items() if k not in ("at", "kind", "agent")})) for e in self.rows]
        return spark.createDataFrame(rows, "at double, kind string, agent string, detail string")


class Board:
    """An append-only table of posts in a shared folder; versions are hashes of content, equal posts of one topic count once."""

    SCHEMA = "topic string, agent string, version string, value string, at double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def post(self, topic: str, agent: str, value) -> str:
        version = content_hash(value)
        append(self.spark.createDataFrame([(topic, agent, version, canonical_json(value), time.time())], self.SCHEMA).coalesce(1), self.path)
        return version

    def posts(self, topic: str) -> DataFrame:
        d = read_appended(self.spark, self.path, self.SCHEMA)
        return d.where(F.col("topic") == topic).groupBy("version").agg(F.min_by("value", "at").alias("value"), F.min_by("agent", "at").alias("agent"), F.min("at").alias("at")).orderBy("at", "version")

    def wait(self, topic: str, n: int, timeout: float = 60.0, poll: float = 0.2) -> list:
        """The posts of a topic once n are there; TimeoutError where they don't come."""
        import json

        end = time.monotonic() + timeout
        while True:
            rows = self.posts(topic).collect()
            if len(rows) >= n:
                return [json.loads(r["value"]) for r in rows]
            if time.monotonic() > end:
                raise TimeoutError(f"{topic}: {len(rows)} of {n} posts")
            time.sleep(poll)


@dataclass
class AgentReport:
    name: str
    seconds: float
    error: str = ""


class Fleet:
    """Runs functions of (session, board) side by side, each in its own scheduler pool (FAIR where the session is set so)."""

    def __init__(self, spark: SparkSession, board: Board, workers: int = 4, bus: Bus | None = None):
        self.spark, self.board, self.workers, self.bus = spark, board, workers, bus or Bus()
        self.agents: dict[str, Callable] = {}

    def add(self, name: str, agent: Callable) -> None:
        if name in self.agents:
            raise ValueError(f"agent {name!r} is there already")
        self.agents[name] = agent

    def run(self) -> tuple[dict, list[AgentReport]]:
        """(results, reports); one agent's error doesn't end the others."""

        def one(item: tuple[str, Callable]) -> tuple:
            name, agent = item
            start = time.monotonic()
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            self.bus.publish("agent-start", agent=name)
            try:
                out, error = agent(self.spark, self.board), ""
            except Exception as e:
                out, error = None, f"{type(e).__name__}: {e}"
            self.bus.publish("agent-end", agent=name, error=error)
            return name, out, AgentReport(name, time.monotonic() - start, error)

        with ThreadPoolExecutor(self.workers) as pool:
            done = list(pool.map(one, self.agents.items()))
        return {n: o for n, o, _ in done}, [r for _, _, r in done]
