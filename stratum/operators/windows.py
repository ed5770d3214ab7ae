"""Event-time windows over finished data: assignment, panes, triggers by count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds from the year 1 to the Unix epoch: windows are cut from the year 1.
ZERO_TO_EPOCH = 62_135_596_800


def origin(size_seconds: int) -> str:
    """Spark's startTime for windows that are aligned to the year 1."""
    return f"{(-ZERO_TO_EPOCH) % size_seconds} seconds"


@dataclass(frozen=True)
class WindowSpec:
    """Seconds; slide 0 means tumbling, size 0 the one global window."""

    size: int = 0
    slide: int = 0
    key: str | None = None
    lateness: int = 0
    late_policy: str = "drop"
    at_count: int = 0
    max_records: int = 0
    max_windows: int = 0
    triggers: tuple[str, ...] = field(default_factory=tuple)

    def validate(self) -> None:
        if self.size < 0 or self.lateness < 0 or self.max_records < 0 or self.max_windows < 0 or self.at_count < 0:
            raise ValueError("sizes, lateness and bounds can't be negative")
        if self.slide and (self.slide > self.size or self.slide < 0):
            raise ValueError("a slide can't be larger than its window")
        if not self.size and not (self.at_count or self.max_records or self.triggers):
            raise ValueError("a global window needs a trigger or a bound on records")
        if self.late_policy not in ("drop", "fail"):
            raise ValueError("late_policy is drop or fail")

    def column(self, ts: Column) -> Column:
        size = f"{self.size} seconds"
        slide = self.slide or self.size
        return F.window(ts, size, f"{slide} seconds", origin(slide))


def assign(df: DataFrame, ts: str, spec: WindowSpec) -> DataFrame:
    """A row per record and window; half-open, oldest first."""
    spec.validate()
    if not spec.size:
        return df.withColumns({"window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp")})
    d = df.withColumn("__w", spec.column(F.col(ts)))
    return d.withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")


def pane_id(stage: str, start: Column, end: Column, key: Column, seq: Column) -> Column:
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return F.concat(F.lit(stage + "/"), F.coalesce(F.date_format(start, form), F.lit("global")), F.lit("-"), F.coalesce(F.date_format(end, form), F.lit("")), F.lit("/"), F.coalesce(key, F.lit("")), F.lit("#"), seq.cast("string"))


def numbered(df: DataFrame, ts: str, record_id: str, spec: WindowSpec) -> DataFrame:
    """Assigned rows with their pane's number, from 1, in the pane order of their window (event time, then id).

    `at_count` (or max_records) fires and empties a window at so many records.
    """
    keys = ["window_start", "window_end", *([spec.key] if spec.key else [])]
    d = assign(df, ts, spec).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, record_id)))
    every = spec.at_count or spec.max_records
    return d.withColumn("pane_seq", (F.floor((F.col("__n") - 1) / every) + 1).cast("int") if every else F.lit(1)).drop("__n")


def panes(df: DataFrame, ts: str, record_id: str, spec: WindowSpec, *, stage: str = "window", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """The panes of finished data, numbered from 1: every window that has records, closed.  With aggregates alone nothing is numbered or collected."""
    keys = ["window_start", "window_end", *([spec.key] if spec.key else [])]
    d = numbered(df, ts, record_id, spec) if spec.at_count or spec.max_records else assign(df, ts, spec).withColumn("pane_seq", F.lit(1))
    out = d.groupBy(*keys, "pane_seq").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (aggregates or {}).items()])
    every = spec.at_count or spec.max_records
    # a pane that fires because it is full is not its window's last word; what is left when the window closes is
    out = out.withColumn("final", F.col("n") < every if every else F.lit(True))
    key = F.col(spec.key).cast("string") if spec.key else F.lit("")
    return out.withColumn("pane", pane_id(stage, F.col("window_start"), F.col("window_end"), key, F.col("pane_seq")))


def contents(ts: str, record_id: str) -> Column:
    """A pane's ids in order, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct(ts, record_id))), lambda r: r[record_id])


def late_rows(df: DataFrame, ts: str, arrival: str, spec: WindowSpec, source_lateness: int = 0) -> DataFrame:
    """Adds `late`: whether a record's windows had all closed when it arrived, in arrival order.

    The watermark before a record is the largest event time that arrived before
    it less the source's lateness; a window closes at its end plus its lateness.
    Running maxima go by chunks of the arrival order.
    """
    chunk = F.floor(F.col(arrival) / 4096)
    d = df.withColumn("__chunk", chunk)
    tops = d.groupBy("__chunk").agg(F.max(ts).alias("__top"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__chunk", F.max("__top").over(before).alias("__before"))
    own = F.max(ts).over(Window.partitionBy("__chunk").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__own", own).join(tops, "__chunk")
    mark = F.greatest("__own", "__before") - F.expr(f"INTERVAL {source_lateness} SECONDS")
    last = assign(d, ts, WindowSpec(size=spec.size, slide=0)) if not spec.slide else assign(d, ts, spec)
    if spec.slide:
        names = [c for c in d.columns]
        last = last.groupBy(*names).agg(F.max("window_end").alias("window_end"))
    closes = F.col("window_end") + F.expr(f"INTERVAL {spec.lateness} SECONDS")
    return last.withColumn("late", F.coalesce(mark >= closes, F.lit(False))).drop("__chunk", "__own", "__before", "window_start", "window_end")
