"""Run reports from event rows, and the checks that stand before a run: grants, egress, sandboxes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reduce import nearest_ranks

EVENT = "run string, stage string, kind string, record_id string, model string, valid boolean, error_class string, latency_ms double, input_tokens bigint, output_tokens bigint, cost_usd double"


def stage_report(events: DataFrame) -> DataFrame:
    """Per run and stage: calls, failures by class, tokens, cost, latency (nearest rank)."""
    sums = events.groupBy("run", "stage").agg(
        F.count("*").alias("calls"), F.count_if(F.col("valid")).alias("accepted"),
        *[F.count_if(F.col("error_class") == c).alias(c) for c in ("transient", "semantic", "permanent", "budget")],
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
    )
    ranks = nearest_ranks(events, ["run", "stage"], F.col("latency_ms"), {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnsRenamed({"run": "__run", "stage": "__stage"})
    same = F.col("run").eqNullSafe(F.col("__run")) & F.col("stage").eqNullSafe(F.col("__stage"))
    return sums.join(ranks, same, "left").drop("__run", "__stage")


@dataclass(frozen=True)
class Grants:
    """Capabilities as `kind:name`; a name of * grants all of a kind."""

    names: frozenset[str] = frozenset()

    def has(self, capability: str) -> bool:
        kind = capability.partition(":")[0]
        return capability in self.names or f"{kind}:*" in self.names


@dataclass(frozen=True)
class Egress:
    """Hosts that may be reached; `*.example.org` allows subdomains."""

    hosts: tuple[str, ...] = ()

    def allowed(self, host: str) -> bool:
        host = host.lower()
        return any(host == h or h == "*" or (h.startswith("*.") and host.endswith(h[1:])) for h in map(str.lower, self.hosts))


@dataclass
class Audit:
    rows: list[tuple[str, str, str, bool]] = field(default_factory=list)

    def check(self, task: str, kind: str, name: str, ok: bool) -> None:
        self.rows.append((task, kind, name, ok))
        if not ok:
            raise PermissionError(f"{task}: {kind} {name!r} is not granted")


@dataclass
class Envelope:
    """What a stage may use; everything is checked on the driver before a plan is made."""

    stage: str
    grants: Grants
    egress: Egress = field(default_factory=Egress)
    sandbox: str = "inline"
    audit: Audit = field(default_factory=Audit)

    def __post_init__(self):
        if self.sandbox != "inline":
            raise NotImplementedError(f"sandbox {self.sandbox!r}: only inline is there, others are refused")

    def model(self, name: str) -> None:
        self.audit.check(self.stage, "model", name, self.grants.has(f"model:{name}"))

    def secret(self, name: str, store: dict[str, str]) -> str:
        self.audit.check(self.stage, "secret", name, self.grants.has(f"secret:{name}") and name in store)
        return store[name]

    def host(self, name: str) -> None:
        self.audit.check(self.stage, "egress", name, self.egress.allowed(name))

    def tool(self, name: str) -> None:
        self.audit.check(self.stage, "tool", name, self.grants.has(f"tool:{name}"))


class Tools:
    """Python callables by name; `dispatch` calls, for each row, the one that a column names."""

    def __init__(self, **tools):
        self.tools = tools

    def dispatch(self, df: DataFrame, envelope: Envelope, name_col: str, args_col: str, out: str) -> DataFrame:
        import json

        import pyarrow as pa

        for name in self.tools:
            envelope.tool(name)
        tools, names = dict(self.tools), df.columns
        a, b = names.index(name_col), names.index(args_col)
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in (out, f"{out}_error"))])

        def run(batches):
            for batch in batches:
                got = []
                for name, args in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                    try:
                        got.append((json.dumps(tools[name](**json.loads(args or "{}"))), None))
                    except Exception as e:
                        got.append((None, f"{type(e).__name__}: {e}"))
                cols = list(zip(*got, strict=True)) if got else [[], []]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in cols)], [*names, out, f"{out}_error"])

        return df.mapInArrow(run, schema)
