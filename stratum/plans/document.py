"""Pipelines as JSON documents: steps, validation, order, edits, building."""

from __future__ import annotations

import copy
import json
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as txt
from ..functions.conditions import OPS, Cond
from ..functions.templates import compile_template
from ..operators.cost import project_infer, project_reduce
from ..operators.graph import refine
from ..operators.infer import Answer, InferSpec, infer
from ..operators.reduce import levels, numbered_prompt, reduce_ai
from ..sources.files import folder_records, table_records
from ..storage import with_seq
from .models import Binding, Registry

# The kinds of step.
KINDS = ("source", "derive", "keep", "ask", "fold", "merge", "write")


class DocumentError(ValueError):
    """A document that can't be built."""


@dataclass
class Document:
    """Steps by id: {id, kind, after, ...}; a merge lists several in `after`."""

    name: str
    steps: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Document:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        return cls(raw["name"], raw["steps"])

    def save(self, path: str) -> None:
        """Written beside the file, then put in its place."""
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({"name": self.name, "steps": self.steps}, f, indent=2, ensure_ascii=False)
        os.replace(temporary, path)

    def step(self, id_: str) -> dict:
        for s in self.steps:
            if s["id"] == id_:
                return s
        raise DocumentError(f"no step {id_!r}")

    @staticmethod
    def ups(step: dict) -> list[str]:
        after = step.get("after", [])
        return [after] if isinstance(after, str) else list(after)

    def order(self) -> list[dict]:
        """Every step after those that it reads; listed order among equals; a cycle is an error."""
        done, out, left = set(), [], list(self.steps)
        while left:
            ready = next((s for s in left if all(u in done for u in self.ups(s))), None)
            if ready is None:
                raise DocumentError(f"a cycle or a step that is not there, among {[s['id'] for s in left]}")
            left.remove(ready)
            done.add(ready["id"])
            out.append(ready)
        return out

    def depth(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in self.order():
            out[s["id"]] = max((out[u] + 1 for u in self.ups(s)), default=0)
        return out

    def layout(self) -> dict[str, tuple[int, int]]:
        """Column (depth) and row of each step."""
        rows: dict[int, int] = {}
        out = {}
        for id_, d in self.depth().items():
            out[id_] = (d, rows.get(d, 0))
            rows[d] = rows.get(d, 0) + 1
        return out

    def validate(self) -> None:
        ids = [s.get("id", "") for s in self.steps]
        if not all(ids) or len(set(ids)) != len(ids):
            raise DocumentError("step ids must be there and differ")
        kinds = {s["id"]: s["kind"] for s in self.steps}
        for s in self.order():
            ups = self.ups(s)
            if s["kind"] not in KINDS:
                raise DocumentError(f"{s['id']}: unknown kind {s['kind']!r}")
            if s["kind"] == "source" and ups or s["kind"] != "source" and not ups:
                raise DocumentError(f"{s['id']}: a source reads nothing, every other step reads one")
            if s["kind"] != "merge" and len(ups) > 1:
                raise DocumentError(f"{s['id']}: only a merge reads several steps")
            if s["kind"] == "merge" and any(kinds[u] not in ("fold", "merge") for u in ups):
                raise DocumentError(f"{s['id']}: a merge reads folds")
            for c in s.get("where", []):
                if c["op"] not in OPS:
                    raise DocumentError(f"{s['id']}: unknown condition {c['op']!r}")

    def apply(self, edits: list[dict]) -> Document:
        """A changed copy: add, update, remove (children move to its upstream), set-cap, set-workers."""
        out = copy.deepcopy(self)
        for e in edits:
            if e["op"] == "add":
                out.steps.append(copy.deepcopy(e["step"]))
            elif e["op"] == "update":
                out.step(e["id"]).update(copy.deepcopy(e["set"]))
            elif e["op"] == "remove":
                gone = out.step(e["id"])
                ups = self.ups(gone)
                for s in out.steps:
                    if e["id"] in self.ups(s):
                        s["after"] = [v for u in self.ups(s) for v in (ups if u == e["id"] else [u])]
                out.steps.remove(gone)
            elif e["op"] in ("set-cap", "set-workers"):
                out.step(e["id"])[e["op"][4:]] = e["value"]
            else:
                raise DocumentError(f"unknown edit {e['op']!r}")
        out.validate()
        return out

    def build(self, spark: SparkSession, registry: Registry, *, dry: bool = False) -> dict[str, DataFrame]:
        """Every step's records; merges are part of the same plan."""
        self.validate()
        out: dict[str, DataFrame] = {}
        for s in self.order():
            ups = [out[u] for u in self.ups(s)]
            out[s["id"]] = _build(s, ups, spark, registry, dry)
        return out

    def price(self, spark: SparkSession, registry: Registry) -> dict[str, dict]:
        """Expected and ceiling cost of each asking step, over real source records and without a call."""
        self.validate()
        counts: dict[str, int] = {}
        frames: dict[str, DataFrame] = {}
        out: dict[str, dict] = {}
        for s in self.order():
            ups = self.ups(s)
            if s["kind"] in ("source", "derive", "keep"):
                frames[s["id"]] = _build(s, [frames[u] for u in ups], spark, registry, True)
                counts[s["id"]] = frames[s["id"]].count()
                continue
            model = _binding(s).candidates(registry)[0] if s["kind"] != "write" else None
            n = sum(counts[u] for u in ups)
            if s["kind"] == "ask":
                known = frames.get(ups[0])
                try:
                    p = project_infer(known, s["id"], model, s["prompt"], max_tokens=s.get("cap", 1024)) if known is not None else None
                except ValueError:
                    p = None
                if p is None:
                    p = project_reduce(0, s["id"], model, item_tokens=0)
                counts[s["id"]] = n
                if known is not None:
                    frames[s["id"]] = known
            elif s["kind"] in ("fold", "merge"):
                p = project_reduce(n, s["id"], model, item_tokens=64, fan_in=s.get("fan_in", 8), max_tokens=s.get("cap", 1024))
                counts[s["id"]] = min(n, 1)
            else:
                counts[s["id"]] = n
                continue
            out[s["id"]] = {"calls": p.calls, "expected_usd": p.expected_usd, "ceiling_usd": p.ceiling_usd}
        total = sum(v["expected_usd"] for v in out.values())
        for v in out.values():
            v["share"] = v["expected_usd"] / total if total else 0.0
        return out


def _binding(s: dict) -> Binding:
    return Binding(model=s.get("model", ""), tier=s.get("tier", "" if s.get("model") else "fast"), escalate=tuple(s.get("escalate", ())))


def _build(s: dict, ups: list[DataFrame], spark: SparkSession, registry: Registry, dry: bool) -> DataFrame:
    kind = s["kind"]
    if kind == "source":
        spec = s["source"]
        if spec["from"] == "records":
            df = with_position(spark.createDataFrame(spec["records"], spec["schema"]), spec["records"])
        elif spec["from"] == "folder":
            df = folder_records(spark, spec["path"], spec.get("glob", "*"), since=spec.get("since"), until=spec.get("until"), line=spec.get("line"))
            df = with_seq(df, "id")
        else:
            df = with_seq(table_records(spark, spec["path"], spec["format"]), "id")
        if "emails" in s.get("scrub", ()):
            df = df.withColumn("text", txt.scrub_emails(F.col("text")))
        if "speakers" in s.get("scrub", ()):
            df = txt.pseudonymize_speakers(df, "text")
        if spec["from"] != "records":
            df = df.withColumnsRenamed(spec.get("rename", {}))
        if spec.get("limit"):
            df = df.orderBy("_seq").limit(spec["limit"])
        return df
    up = ups[0]
    if kind == "derive":
        for name, template in s["fields"].items():
            up = up.withColumn(name, compile_template(template, up.schema, strict=False))
        return up
    if kind == "keep":
        for c in s["where"]:
            up = up.where(Cond(c["field"], c["op"], c.get("value", "")).column(up.schema))
        return up
    if kind == "ask":
        answers = tuple(Answer(**a) for a in s.get("answers", ()))
        schema = T.StructType([T.StructField(a.name, T.ArrayType(T.StringType()) if a.kind == "list" else T.StringType()) for a in answers]) if answers else None
        spec = InferSpec(_binding(s), s["prompt"], system=s.get("system", ""), max_tokens=s.get("cap", 1024), schema=schema, answers=answers, output=s.get("output", "output"))
        if "loop" not in s:
            return infer(up, spec, registry, max_attempts=s.get("attempts", 1)).records
        loop = s["loop"]
        until = Cond(loop["until"]["field"], loop["until"]["op"], loop["until"].get("value", ""))

        def once(active: DataFrame, _: int) -> DataFrame:
            got = infer(active, spec, registry, max_attempts=1).records
            return got.withColumn("__accepted", until.column(got.schema))

        start = up
        for a in answers:
            if a.name not in start.columns:
                start = start.withColumn(a.name, F.lit(None).cast("array<string>" if a.kind == "list" else "string"))
        start = start.withColumn("__accepted", F.lit(False))
        return refine(start, once, accept="__accepted", note=loop["note"], max_rounds=loop.get("rounds", 3)).vertices.drop("__accepted")
    if kind in ("fold", "merge"):
        item, output = s["item"], s.get("output", "summary")
        if kind == "merge":
            parts = [u.select(F.lit(k).cast("bigint").alias("_seq"), F.coalesce(*[F.col(c).cast("string") for c in (item, output) if c in u.columns]).alias(item)) for k, u in enumerate(ups)]
            up = parts[0]
            for p in parts[1:]:
                up = up.unionByName(p)
            up = up.withColumn("_seq", F.row_number().over(Window.orderBy("_seq")) - 1)  # one row per fold
        else:
            for c in s.get("where", []):
                up = up.where(Cond(c["field"], c["op"], c.get("value", "")).column(up.schema))
            up = with_seq(up.withColumn("__o", F.col("_seq")).drop("_seq"), "__o") if "_seq" in up.columns else with_seq(up, "id")
        return reduce_ai(up, _binding(s).candidates(registry)[0], numbered_prompt(s.get("title", "Summarize:"), s.get("words", 0)), item=item, output=output, fan_in=s.get("fan_in", 8))[0]
    if kind == "write":
        from ..sources.sinks import write_records

        return write_records(up, s["path"], s["file"], s["body"], dry=dry)
    raise DocumentError(kind)


def with_position(df: DataFrame, rows: list) -> DataFrame:
    """Inline records keep their listed order by a number in them."""
    return df if "_seq" in df.columns else with_seq(df, "id")


def calls_of(n: int, fan_in: int = 8) -> int:
    return sum(levels(n, fan_in))
