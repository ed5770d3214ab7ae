"""Per-record inference: prompts, answers, JSON merging, validation, ladders with failure classes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import compile_template
from ..functions.values import estimate_tokens, strip
from ..plans.models import PERMANENT, SEMANTIC, Binding, Model, Pricing, Registry, usage_columns
from ..storage import materialize


@dataclass(frozen=True)
class Answer:
    """An expected field of a JSON answer: its name, kind (text or list), a note, and whether it must be filled."""

    name: str
    kind: str = "text"
    note: str = ""
    required: bool = False


@dataclass(frozen=True)
class InferSpec:
    binding: Binding
    prompt: str
    system: str = ""
    prefix: str = ""
    context: tuple[str, ...] = ()
    max_tokens: int = 1024
    schema: T.StructType | None = None
    output: str = "output"
    validate: Callable[[], Column] | None = None
    answers: tuple[Answer, ...] = ()
    broadcasts: dict = field(default_factory=dict, hash=False)


def json_object(text: Column) -> Column:
    """From the first `{` to the last `}` of an answer, of its first fenced block where it has one; null where there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.nullif(F.regexp_extract(F.when(text.contains("```"), fenced).otherwise(text), r"(?s)\{.*\}", 0), F.lit(""))


def parse_json(text: Column, schema: T.StructType) -> Column:
    """The first object of an answer, as a struct; null where it can't be read."""
    return F.from_json(json_object(text), schema, {"mode": "PERMISSIVE"})


def parse_open(text: Column) -> Column:
    """The first object of an answer as a VARIANT, for fields that are known at run time only."""
    return F.try_parse_json(json_object(text))


def merge_fields(df: DataFrame, struct_col: str, schema: T.StructType) -> DataFrame:
    """A parsed object's fields over the record's own; fields that the object lacks keep their value."""
    own = df.columns
    cols = [F.coalesce(F.col(f"{struct_col}.{f.name}"), F.col(f.name)).alias(f.name) if f.name in own else F.col(f"{struct_col}.{f.name}").alias(f.name) for f in schema.fields]
    named = set(schema.names)
    return df.select(*[c for c in own if c not in named and c != struct_col], *cols)


def answer_instruction(answers: tuple[Answer, ...]) -> str:
    """The instruction for a JSON answer that is added to a prompt."""
    if not answers:
        return ""
    lines = [f'- "{a.name}": ' + ("a list of short texts" if a.kind == "list" else "a text") + (f" ({a.note})" if a.note else "") + (", required" if a.required else "") for a in answers]
    return "\n\nAnswer with one JSON object and nothing else. Its fields:\n" + "\n".join(lines)


def answers_filled(answers: tuple[Answer, ...]) -> Column:
    """Whether all required answers are filled."""
    conds = [F.coalesce(F.size(a.name) > 0 if a.kind == "list" else strip(F.col(a.name)) != "", F.lit(False)) for a in answers if a.required]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def shared_prefix(prefix: str, context: tuple[str, ...] = (), continuation: str = "") -> str:
    """What all prompts of a stage begin with; rendered once."""
    parts = [continuation, *(f"<context>\n{c}\n</context>" for c in context), prefix]
    return "\n".join(p for p in parts if p)


def prefix_usage(df: DataFrame, prompt: Column, response: Column, prefix: str, pricing: Pricing, order: str, *partition: str, enabled: bool = True) -> DataFrame:
    """Adds usage with prefix caching: the first call of a (model, system, prefix) in the order writes the prefix, later ones read it.

    partition names the columns that tell such triples apart.  The first call is
    found by an aggregate, so no task sees all calls of a triple; order must tell
    its rows apart.
    """
    if not enabled or not prefix:
        return df.withColumns(usage_columns(F.concat(F.lit(prefix), prompt), response, pricing))
    shared = len(prefix.encode()) // 4 + 1
    keys = [F.col(c).alias(f"__{k}") for k, c in enumerate(partition)]
    firsts = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(partition)], F.col(order).eqNullSafe(F.col("__first")))
    d = df.join(firsts, same, "left")
    first = F.col("__first").isNotNull()
    inp, out = estimate_tokens(prompt), estimate_tokens(F.coalesce(response, F.lit("")))
    read = F.when(first, 0).otherwise(shared).cast("bigint")
    write = F.when(first, shared).otherwise(0).cast("bigint")
    d = d.withColumns({"input_tokens": inp, "output_tokens": out, "cache_read_tokens": read, "cache_write_tokens": write, "requests": F.lit(1).cast("bigint"), "cost_usd": pricing.cost(inp, out, read, write)})
    return d.drop("__first", *[f"__{k}" for k in range(len(partition))])


@dataclass
class Inferred:
    """Records that passed, attempts (one row per call) and failures (records that no attempt satisfied)."""

    records: DataFrame
    attempts: DataFrame
    failures: DataFrame


def _attempt(df: DataFrame, spec: InferSpec, model: Model) -> DataFrame:
    """One call per record: __prompt, __response, __valid, __class and the merged fields."""
    text = spec.prompt + answer_instruction(spec.answers)
    prefix = shared_prefix(spec.prefix, spec.context)
    prompt = compile_template(text, df.schema, broadcasts=spec.broadcasts)
    d = df.withColumn("__prompt", F.concat(F.lit(prefix + "\n"), prompt) if prefix else prompt)
    d = model.respond(d, "__prompt", "__response")
    if model.answer is None:
        d = materialize(d)  # a called model answers once, whatever reads it
    if spec.schema is None:
        d = d.withColumn(spec.output, strip(F.col("__response")))
        parsed = F.col("__response").isNotNull()
    else:
        d = d.withColumn("__parsed", parse_json(F.col("__response"), spec.schema))
        d = d.withColumn("__ok", F.col("__parsed").isNotNull() & json_object(F.col("__response")).isNotNull())
        d = merge_fields(d, "__parsed", spec.schema)
        parsed = F.col("__ok")
    valid = parsed & answers_filled(spec.answers)
    if spec.validate is not None:
        valid = valid & F.coalesce(spec.validate(), F.lit(False))
    d = d.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    return d.withColumn("__class", F.when(~F.col("__valid"), F.coalesce("__response_class", F.lit(SEMANTIC))))


def infer(df: DataFrame, spec: InferSpec, registry: Registry, *, id_col: str = "id", max_attempts: int = 3, start_rung: Column | None = None) -> Inferred:
    """Runs the ladder as passes over what is left: semantic failures climb a rung (and stay at the top), permanent ones end."""
    ladder = spec.binding.candidates(registry)
    own = df.columns
    todo = df.withColumn("__rung", F.coalesce(start_rung, F.lit(0)) if start_rung is not None else F.lit(0))
    done, attempts, failed = [], [], []
    live = {0} if start_rung is None else set(range(len(ladder)))
    for attempt in range(1, max_attempts + 1):
        left, following = [], set()
        for rung in sorted(live):
            model = ladder[rung]
            # only called models fail transiently, which leaves a record on its rung
            following |= {min(rung + 1, len(ladder) - 1)} | ({rung} if model.answer is None else set())
            part = todo.where(F.col("__rung") == rung).drop("__rung")
            got = _attempt(part, spec, model)
            if spec.binding.escalate or max_attempts > 1:
                got = materialize(got)
            usage = usage_columns(F.col("__prompt"), F.col("__response"), model.pricing)
            attempts.append(got.select(F.col(id_col).cast("string").alias("record_id"), F.lit(attempt).alias("attempt"), F.lit(rung).alias("rung"), F.lit(model.name).alias("model"), F.col("__valid").alias("valid"), F.col("__class").alias("error_class"), *[c.alias(k) for k, c in usage.items()]))
            done.append(got.where("__valid").drop("__prompt", "__response", "__response_error", "__response_class", "__valid", "__class", "__ok"))
            bad = got.where("not __valid")
            last = attempt == max_attempts
            over = bad if last else bad.where(F.col("__class") == PERMANENT)
            failed.append(over.select(F.col(id_col).cast("string").alias("record_id"), F.col("__class").alias("error_class"), F.lit(attempt).alias("attempts"), F.coalesce("__response_error", F.lit("answer not accepted")).alias("error")))
            if not last:
                again = bad.where(F.col("__class") != PERMANENT)
                climbs = F.when(F.col("__class") == SEMANTIC, F.lit(min(rung + 1, len(ladder) - 1))).otherwise(F.lit(rung))
                left.append(again.withColumn("__next", climbs).select(*own, F.col("__next").alias("__rung")))
        if not left:
            break
        todo, live = reduce(DataFrame.unionByName, left), following
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Inferred(union(done), union(attempts), union(failed))


def fail_batches(records: DataFrame, failures: DataFrame, batch: int, *, id_col: str = "id", seq_col: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """With batches of n, one failed record fails its whole batch: (records that stay, dead letters)."""
    d = records.withColumn("__batch", F.floor(F.col(seq_col) / batch))
    bad = d.join(failures.select(F.col("record_id").alias(id_col)), id_col, "left_semi").select("__batch").distinct()
    return d.join(bad, "__batch", "left_anti").drop("__batch"), d.join(bad, "__batch", "left_semi").drop("__batch")


def spend_until(attempts: DataFrame, cap: float, *, order: str = "_seq", cost: str = "cost_usd", chunk: int = 4096) -> DataFrame:
    """Adds `ran`: in order, calls run while what was spent before them is under the cap (checked before, charged after).

    Running sums go by chunks of the order: sums of chunks first, then within each chunk.
    """
    d = attempts.withColumn("__chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("__chunk").agg(F.sum(cost).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("__own", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).join(sums.drop("__sum"), "__chunk")
    return d.withColumn("spent_before", F.col("__before") + F.col("__own")).withColumn("ran", F.col("spent_before") < cap).drop("__chunk", "__own", "__before")
