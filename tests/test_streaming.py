import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.windows import WindowSpec
from stratum.sources import files, sinks
from stratum.streaming import jobs
from stratum.streaming.watermarks import MAX, Watermarks
from stratum.streaming.windower import LateRecord, Windower, any_of, at_count, at_interval, at_watermark

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("service", T.StringType()), T.StructField("at", T.StringType()), T.StructField("text", T.StringType())])
ROWS = [("a1", "api", 5), ("a2", "api", 20), ("a3", "db", 50), ("b1", "api", 65), ("b2", "db", 80), ("b3", "db", 110)]


def lines(rows):
    return "\n".join(json.dumps({"id": i, "service": s, "at": f"2026-03-01T12:{t // 60:02d}:{t % 60:02d}Z", "text": s}) for i, s, t in rows) + "\n"


def test_windower_fires_once_by_watermark():
    w = Windower(60, lateness=20)
    assert w.add("a", 10) == [] and w.advance(65) == []
    w.add("b", 30)
    (p,) = w.advance(80)
    assert (p.ids, p.final, p.late, p.seq) == (["a", "b"], True, True, 1)
    assert w.add("c", 30) == [] and w.stats["dropped"] == 1 and w.advance(70) == []
    with pytest.raises(LateRecord):
        x = Windower(60, late_policy="fail")
        x.advance(100)
        x.add("z", 10)


def test_windower_triggers_and_bounds():
    w = Windower(60, trigger=at_count(2))
    w.add("a", 1)
    (p,) = w.add("b", 2)
    assert p.ids == ["a", "b"] and not p.final
    w.add("c", 3)
    (p,) = w.advance(60)
    assert (p.ids, p.seq, p.final) == (["c"], 2, True)
    g = Windower(trigger=at_count(2))
    g.add("a", 1)
    assert g.add("b", 9999)[0].count == 2
    i = Windower(60, trigger=any_of(at_watermark(), at_interval(10)))
    i.add("a", 1)
    assert i.advance(5) == [] and [p.final for p in i.advance(16)] == [False] and i.advance(60)[0].ids == ["a"]
    m = Windower(60, max_records=2)
    m.add("a", 1)
    assert m.add("b", 2)[0].ids == ["a", "b"] and m.stats["evicted"] == 1
    n = Windower(60, max_windows=1)
    n.add("a", 1)
    assert n.add("b", 61)[0].final
    s = Windower(60, 30)
    s.add("a", 45)
    assert [(p.start, p.end) for p in s.drain()] == [(0, 60), (30, 90)]
    a, b = Windower(60), Windower(60)
    a.add("a", 1)
    b.restore(a.snapshot())
    assert b.advance(60)[0].ids == ["a"]
    with pytest.raises(ValueError):
        Windower()
    assert Windower(7 * 86400).windows(1772366400)[0][0] % (7 * 86400) == 4 * 86400


def test_windower_counts_as_windows_and_panes():
    w = Windower(60, 30, lateness=10, trigger=at_count(2))
    w.advance(95)
    w.add("a", 85)  # of 30-90, which is late, and 60-120
    assert (w.stats["records"], w.stats["assigned"], w.stats["dropped"]) == (1, 2, 0)
    w.add("b", 45)  # 0-60 has closed, 30-90 has not: it fires full, and late
    assert (w.stats["records"], w.stats["assigned"], w.stats["dropped"], w.stats["late"], w.stats["panes"]) == (2, 3, 1, 1, 1)
    w.add("c", 86)
    assert [(p.start, p.seq, p.late, p.final) for p in w.advance(200)] == [(30, 2, True, True)]
    assert w.add("d", 10) == [] and w.stats["dropped"] == 3 and w.stats["records"] == 3
    assert w.advance(200) == [] and w.advance(150) == [] and w.mark == 200
    x = Windower(60, 30, late_policy="fail")
    x.advance(61)
    with pytest.raises(LateRecord):
        x.add("z", 45)  # one of its windows is open, the other is not
    g = Windower(60, trigger=at_interval(10))
    g.add("a", 1)
    assert g.advance(9) == [] and [p.seq for p in g.advance(31)] == [1] and g.advance(39) == [] and [p.seq for p in g.advance(40)] == [2]


def test_watermarks():
    w = Watermarks(lateness=5, idle=100)
    w.open("a")
    w.open("b")
    w.observe("a", 50)
    assert w.value() is None
    w.observe("b", 30)
    assert w.value() == 25
    w.observe("b", 10)
    assert w.value() == 25
    w.retire("b")
    assert w.value() == 45
    assert w.value(now=1000) == MAX
    assert [x["events"] for x in w.lags()] == [1, 2]


@pytest.mark.parametrize("key", [None, "service"])
def test_stream_and_drain_equal_backfill(spark, tmp_path, key):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-0.json").write_text(lines(ROWS[:3]))
    (tmp_path / "in/part-1.json").write_text(lines(ROWS[3:]))
    spec = WindowSpec(size=60, key=key)
    batch = jobs.with_event_time(files.json_lines(spark, str(tmp_path / "in"), SCHEMA), "at")
    want = {r["pane"]: [x["id"] for x in r["rows"]] for r in jobs.backfill_panes(batch, "event_time", "id", spec).collect()}
    assert sorted(map(len, want.values())) == ([3, 3] if key is None else [1, 1, 2, 2])
    stream = jobs.with_event_time(files.json_lines(spark, str(tmp_path / "in"), SCHEMA, stream=True), "at")
    panes = jobs.stream_panes(stream, "event_time", "id", spec, source_lateness=30)
    out = panes.select("pane", jobs.ordered_ids(F.col("rows"), "id").alias("ids"), "n")
    q = jobs.run_stream(out, sinks.pane_sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = {r["pane"]: r["ids"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    closed = {sinks.safe(k): v for k, v in want.items() if "12:01:00Z/" in k and "12:00:00Z-" in k}
    assert got == closed
    assert jobs.progress_report(spark, q).count() >= 1
    jobs.fail_on_late(q)
    # a restart reads nothing again
    jobs.run_stream(out, sinks.pane_sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert {r["pane"]: r["ids"] for r in spark.read.json(str(tmp_path / "out")).collect()} == got


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text(lines(ROWS[:2]) + "not json\n" + '{"service": "db", "at": "x", "text": "t"}\n')
    got = files.json_lines(spark, str(tmp_path / "x.json"), SCHEMA).collect()
    assert len(got) == 3 and any(r["id"].startswith("x.json:") for r in got)
    assert files.bad_lines(spark, str(tmp_path / "x.json"), SCHEMA) == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "x.json"), SCHEMA, bad="fail").collect()


def test_ids_are_byte_offsets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = ['{"service": "é"}', '{"service": "é"}', "", '{"id": "own", "service": "x"}', '{"service": "é"}'] * 40
    for name in ("a b.json", "c.json"):
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = files.json_lines(spark, str(tmp_path / "in"), T.StructType([T.StructField("service", T.StringType())])).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, at = [], 0
    for line in rows:
        if line:
            want += ["own"] * 2 if "own" in line else [f"{n}:{at}" for n in ("a b.json", "c.json")]
        at += len(line.encode()) + 1
    assert sorted(r["id"] for r in got) == sorted(want)


def test_folders_tables_and_writing(spark, tmp_path):
    for g, n, body in (("a", "2026-03-01", lines(ROWS[:2])), ("a", "2026-03-02", " \n"), ("b", "2026-03-02", lines(ROWS[2:3]))):
        (tmp_path / "in" / g).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / g / f"{n}.jsonl").write_text(body)
    got = files.folder_records(spark, str(tmp_path / "in"), "*.jsonl", line="{{.id}}: {{.text}}").orderBy("id").collect()
    assert [(r["id"], r["count"], r["text"]) for r in got] == [("a/2026-03-01", 2, "a1: api\na2: api"), ("b/2026-03-02", 1, "a3: db")]
    assert files.folder_records(spark, str(tmp_path / "in"), since="2026-03-02").count() == 1
    (tmp_path / "t.csv").write_text("key,v\nk1,1\n,2\nk3\n")
    rows = files.table_records(spark, str(tmp_path / "t.csv"), "csv").collect()
    assert [r["id"] for r in rows] == ["k1", "row-2", "k3"] and rows[2]["v"] is None
    d = spark.createDataFrame([("x/y1", "one"), ("y2", "two")], "id string, t string")
    out = sinks.write_records(d, str(tmp_path / "out"), "{{.id}}.txt", "<{{.t}}>").orderBy("t").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in out] == ["y1.txt", "y2.txt"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()) == ["<one>", "<two>"]
    assert not (tmp_path / "dry").exists() and sinks.write_records(d, str(tmp_path / "dry"), "a", "b", dry=True).count() == 2 and not (tmp_path / "dry").exists()


def words_pipeline():
    from stratum.operators.infer import InferSpec
    from stratum.operators.reduce import numbered_prompt
    from stratum.plans.models import Binding, Model, Pricing, Registry
    from stratum.plans.pipeline import Pipeline

    price = Pricing(1.0, 2.0)
    judge = Model("judge", "fast", price, answer=lambda p: F.concat(F.lit('{"size": '), F.length(p).cast("string"), F.lit("}")))
    joiner = Model("joiner", "deep", price, answer=lambda p: F.concat_ws("+", F.regexp_extract_all(p, F.lit(r"(?m)^\d+\. (.*)$"), F.lit(1))))
    spec = InferSpec(Binding(tier="fast"), "say {{.text}}", schema=T.StructType([T.StructField("size", T.LongType())]))
    return Pipeline("feed"), spec, Binding(tier="deep"), numbered_prompt("Join:"), Registry(judge, joiner)


def test_a_pipeline_runs_as_a_stream(spark, tmp_path):
    """Panes reduced by key, drained at the end, equal those of finished data; calls are counted; a restart does nothing again."""
    from stratum.streaming.pipelines import run_pipeline

    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-0.json").write_text(lines(ROWS[:3]))
    (tmp_path / "in/part-1.json").write_text(lines(ROWS[3:]))
    p, spec, deep, prompt, registry = words_pipeline()
    kept = p.from_stream("feed").map("tag", {"text": F.concat_ws("/", "service", "id")}).filter("some", F.col("id") != "b3")
    kept.window("minute", "event_time", WindowSpec(size=60, key="service")).infer("size", spec, max_attempts=1).reduce_ai("joined", deep, prompt, item="text", output="all", key="service")
    load = lambda stream: jobs.with_event_time(files.json_lines(spark, str(tmp_path / "in"), SCHEMA, stream=stream), "at")
    got = {}

    def sink(df, number):
        for r in df.collect():
            got.setdefault(r["pane"], []).append((number, r["all"], r["service"]))

    report = run_pipeline(p, spark, load(True), {"joined": sink}, str(tmp_path / "cp"), registry=registry, lateness=10, drain=lambda: load(False))
    want = {}
    for i, s, t in ROWS:
        if i != "b3":
            want.setdefault((s, t // 60), []).append(f"{s}/{i}")
    assert sorted(x[0][1] for x in got.values()) == sorted("+".join(v) for v in want.values())
    assert all(len(x) == 1 for x in got.values()) and all(k.startswith("minute/2026-03-01T12:0") and k.endswith("#1") for k in got)
    assert (report.panes, report.rows["joined"], report.calls["size"], report.calls["joined"]) == (4, 4, 5, 4)
    assert report.drained == 2 and sum(x[0][0] == -1 for x in got.values()) == 2
    again = run_pipeline(p, spark, load(True), {"joined": sink}, str(tmp_path / "cp"), registry=registry, lateness=10)
    assert again.panes == 0 and all(len(x) == 1 for x in got.values())


def test_an_unwindowed_stage_runs_on_each_batch_once(spark, tmp_path):
    from stratum.plans.pipeline import PipelineError
    from stratum.streaming.pipelines import run_pipeline

    (tmp_path / "in").mkdir()
    (tmp_path / "in/part-0.json").write_text(lines(ROWS[:4]))
    p, spec, deep, prompt, registry = words_pipeline()
    sized = p.from_stream("feed").infer("size", spec, max_attempts=1)
    load = lambda: files.json_lines(spark, str(tmp_path / "in"), SCHEMA, stream=True)
    out = []
    sink = lambda df, n: out.extend((n, r["id"], r["size"]) for r in df.collect())
    run = lambda: run_pipeline(p, spark, load(), {"size": sink}, str(tmp_path / "cp"), registry=registry)
    assert run().calls == {"size": 4}
    (tmp_path / "in/part-1.json").write_text(lines(ROWS[4:]))
    assert run().calls == {"size": 2} and run().calls == {}
    assert sorted((i, s) for _, i, s in out) == sorted((i, len(f"say {s}")) for i, s, _ in ROWS) and {n for n, _, _ in out} == {0, 1}
    sized.reduce_ai("all", deep, prompt, item="text", output="all")
    with pytest.raises(PipelineError, match="without a window"):
        run()
    with pytest.raises(PipelineError, match="bind"):
        q, *_ = words_pipeline()
        q.from_stream("feed")
        run_pipeline(q, spark, load(), {"nothing": sink}, str(tmp_path / "cp2"))
