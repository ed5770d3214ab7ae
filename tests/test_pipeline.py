import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators import cache, cost, graph, reduce, report, route
from stratum.operators.infer import Answer, InferSpec, answers_filled, infer, parse_json, shared_prefix
from stratum.operators.windows import WindowSpec
from stratum.plans.document import Document, DocumentError
from stratum.plans.models import SEMANTIC, TRANSIENT, Binding, Model, ModelError, Pricing, Registry, call_with_retry, classify_status, retry_delay
from stratum.plans.pipeline import Options, Pipeline, PipelineError, cacheable
from stratum.streaming.jobs import validate_stream

TICKETS = [("t1", "URGENT refund"), ("t2", "crash on start"), ("t3", "hello"), ("t4", "URGENT crash")]


def classify(prompt):
    urgent = prompt.contains("URGENT")
    category = F.when(prompt.contains("refund"), "billing").when(prompt.contains("crash"), "bug").otherwise("general")
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(category.alias("category"), urgent.alias("urgent"))), F.lit("\n```"))


FAST = Model("fast-1", "fast", Pricing(0.8, 4.0), answer=classify)
SUM = Model("deep-1", "deep", Pricing(3, 15), answer=lambda p: F.concat(F.lit("SUM["), F.size(F.regexp_extract_all(p, F.lit(r"(?m)^\d+\. "), F.lit(0))).cast("string"), F.lit("]")))
SCHEMA = T.StructType([T.StructField("category", T.StringType()), T.StructField("urgent", T.BooleanType())])


def test_triage(spark):
    p = Pipeline("triage")
    tickets = p.from_records("tickets", TICKETS, "id string, subject string").map("tag", {"source": F.lit("mail")})
    found = tickets.infer("classify", InferSpec(Binding(tier="fast"), "Sort: {{.subject}}", schema=SCHEMA), max_attempts=1).filter("urgent", F.col("urgent"))
    found.reduce_ai("sum", Binding(tier="deep"), reduce.numbered_prompt("Sum:"), item="category", output="summary", fan_in=2)
    plan, got = p.run(spark, Registry(FAST, SUM))
    assert sorted((r["id"], r["category"]) for r in got.outputs["urgent"].collect()) == [("t1", "billing"), ("t4", "bug")]
    assert got.output(plan).first()["summary"] == "SUM[2]"
    assert plan.terminals() == ["sum"] and got.attempts["classify"].count() == 4


def test_refusals(spark):
    p = Pipeline("x")
    a = p.from_records("a", TICKETS, "id string, subject string")
    a.filter("a", F.lit(True))
    with pytest.raises(PipelineError, match="differ"):
        p.compile()
    p = Pipeline("x")
    p.from_stream("s").combine("c", F.col("v"), lambda a, b: a)
    with pytest.raises(PipelineError, match="stream"):
        p.run(spark)
    with pytest.raises(PipelineError, match="without a window"):
        validate_stream(p.compile())
    p = Pipeline("x")
    p.from_records("a", TICKETS, "id string, subject string").infer("i", InferSpec(Binding(tier="none"), "x"))
    with pytest.raises(PipelineError):
        p.compile(Registry())
    with pytest.raises(PipelineError, match="no stage"):
        validate_stream(Pipeline("e").compile())
    with pytest.raises(ValueError):
        WindowSpec(size=10, slide=20).validate()
    with pytest.raises(ValueError):
        WindowSpec().validate()


def test_strict_filter_and_branches(spark):
    p = Pipeline("x")
    a = p.from_records("a", [("1", None), ("2", True)], "id string, ok boolean")
    a.filter("loose", F.col("ok"))
    a.filter("strict", F.col("ok"), strict=True)
    _, got = p.run(spark)
    assert got.outputs["loose"].count() == 1
    with pytest.raises(Exception, match="null"):
        got.outputs["strict"].collect()


def test_fusion_and_fingerprints():
    def build(version, tone):
        p = Pipeline("x")
        a = p.from_records("a", [], "id string").map("m1", {}, Options(version=version)).map("m2", {}, Options(version="1"))
        b = a.infer("i", InferSpec(Binding(tier="fast"), "x"), Options(broadcasts=("tone",)))
        b.filter("f", F.lit(True))
        b.filter("g", F.lit(True))
        return p, p.compile(Registry(FAST), {"tone": tone})

    p, one = build("1", "calm")
    _, two = build("1", "loud")
    assert one.fused == [["m1", "m2"], ["f"], ["g"]]
    assert one.fingerprints["m1"] == two.fingerprints["m1"] and one.fingerprints["i"] != two.fingerprints["i"]
    assert cacheable(p.stages[1:3]) and not cacheable(build("", "calm")[0].stages[1:3])


def test_called_models_and_ladder(spark):
    def small(prompt):
        if "slow" in prompt:
            raise ModelError("busy", TRANSIENT)
        return "bad" if "hard" in prompt else '{"v": "small"}'

    reg = Registry(Model("small", "fast", call=small), Model("large", "deep", call=lambda p: '{"v": "large"}'))
    d = spark.createDataFrame([("1", "easy"), ("2", "hard"), ("3", "slow")], "id string, kind string")
    got = infer(d, InferSpec(Binding(tier="fast", escalate=("deep",)), "{{.kind}}", schema=T.StructType([T.StructField("v", T.StringType())])), reg, max_attempts=2)
    assert {r["id"]: r["v"] for r in got.records.collect()} == {"1": "small", "2": "large"}
    assert [(r["record_id"], r["error_class"]) for r in got.failures.collect()] == [("3", TRANSIENT)]


def test_failure_classes():
    assert [classify_status(s) for s in (429, 500, 404, None)] == [TRANSIENT, TRANSIENT, "permanent", TRANSIENT]
    assert classify_status(200, refused=True) == SEMANTIC
    tries = []

    def call(_):
        tries.append(1)
        raise TimeoutError("late")

    assert call_with_retry(call, "x", sleep=lambda s: None)[2] == TRANSIENT and len(tries) == 3
    assert retry_delay(9, jitter=0) == 5.0
    reg = Registry(FAST, SUM)
    b = Binding(tier="fast", escalate=("deep", "fast"))
    assert [m.name for m in b.candidates(reg)] == ["fast-1", "deep-1"] and b.resolve(reg, 9).name == "deep-1"
    assert Pricing(10, 1).read == 1.0 and Pricing(10, 1).write == 12.5


def test_answers(spark):
    d = spark.createDataFrame([('x {"a": ["1"], "b": "t"} y',), ("none",), ('{"a": [], "b": " "}',)], "t string")
    s = T.StructType([T.StructField("a", T.ArrayType(T.StringType())), T.StructField("b", T.StringType())])
    ans = (Answer("a", "list", required=True), Answer("b", required=True))
    got = d.select(parse_json(F.col("t"), s).alias("p")).select("p.a", "p.b").select(answers_filled(ans).alias("ok"))
    assert [r["ok"] for r in got.collect()] == [True, False, False]
    assert shared_prefix("p", ("c",), "k") == "k\n<context>\nc\n</context>\np"


def test_levels_and_projection(spark):
    assert reduce.levels(2000) == [250, 32, 4, 1] and sum(reduce.levels(2000)) == 287
    assert reduce.levels(1) == [1] and reduce.levels(0) == [] and reduce.levels(3, 1) == [1]
    p = cost.Projection([cost.project_reduce(2000, "r", SUM, item_tokens=10), cost.project_iterate(2, 5, 6, "i", FAST, prompt_tokens=10)])
    assert p.stages[0].calls == 287 and p.stages[1].calls == 26
    assert p.fits(cost.Budget()) and not p.fits(cost.Budget(cost_usd=1e-9))
    assert cost.expected_output(1024) == 358
    empty = spark.createDataFrame([], "_seq bigint, t string")
    assert reduce.reduce_ai(empty, SUM, reduce.numbered_prompt("x"), item="t", output="s")[0].count() == 0
    assert reduce.fold(empty, F.col("t"), lambda a, b: F.concat(a, b)).count() == 0


def test_bsp_halts_and_limits(spark):
    v = spark.createDataFrame([(f"p{k}", -1) for k in range(1, 5)], "id string, hop int")
    e = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("p4", "gone")], "src string, dst string")

    def step(active, number):
        d = active.withColumn("hop", F.lit(number))
        return d, d.select(F.lit("").alias("to"), F.col("id").alias("from"), F.concat(F.lit("hop:"), F.col("hop").cast("string")).alias("body"), F.lit(1.0).alias("rank"))

    got = graph.bsp(v, e, step, seeds="id = 'p1'", directed=True, max_rounds=10)
    assert got.halt == "quiet" or got.halt == "fixpoint"
    assert {r["id"]: r["hop"] for r in got.vertices.collect()} == {"p1": 0, "p2": 1, "p3": 2, "p4": 3}
    assert [r.active for r in got.rounds] == [1, 1, 1, 1]
    assert graph.bsp(v, e, step, seeds="id = 'p1'", directed=True, max_rounds=2).halt == "rounds"
    assert graph.bsp(v, e, step, seeds="id = 'p1'", directed=True, budget=lambda n: n >= 1).halt == "budget"
    grown = graph.bsp(v, e, step, seeds="id = 'p4'", directed=True, grow=lambda lost: lost.select(F.col("to").alias("id"), F.lit(-1).alias("hop")))
    assert "gone" in [r["id"] for r in grown.vertices.collect()]
    with pytest.raises(ValueError):
        graph.check_vertices(v.union(v))
    with pytest.raises(ValueError):
        graph.check_vertices(v.withColumn("Inbox", F.lit(1)))


def test_beam(spark):
    start = spark.createDataFrame([("s", "1", 1.0)], "id string, body string, rank double")

    def expand(frontier, number):
        d = frontier.select(F.col("id").alias("from"), F.explode(F.array(F.concat("body", F.lit("0")), F.concat("body", F.lit("1")))).alias("body"))
        return d.select(graph.successor(F.col("body")).alias("to"), "from", "body", F.col("body").cast("double").alias("rank"))

    got = graph.beam(start, expand, width=2, depth=3)
    assert sorted(r["body"] for r in got.vertices.where("round = 3").collect()) == ["1110", "1111"]
    assert got.halt == "rounds"


def test_cache_and_tools(spark, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "c"))
    d = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, t string")
    up = lambda x: x.withColumn("out", F.upper("t"))
    out, hits, misses = store.apply(d, "s", "fp", ["t"], up, "out")
    assert (hits, misses) == (0, 2) and sorted(r["out"] for r in out.collect()) == ["A", "A", "B"]
    assert store.apply(d, "s", "fp", ["t"], up, "out")[1:] == (3, 0)
    assert store.apply(d, "s", "other", ["t"], up, "out")[2] == 2
    b = cache.Broadcasts()
    b.register("x", {"k": 1})
    assert b.read("x", ("x",)) == {"k": 1}
    with pytest.raises(PermissionError):
        b.read("x", ())
    env = report.Envelope("s", report.Grants(frozenset({"tool:add"})), report.Egress(("*.example.org",)))
    got = report.Tools(add=lambda a, b: a + b).dispatch(spark.createDataFrame([("add", '{"a": 1, "b": 2}'), ("nope", "{}")], "tool string, args string"), env, "tool", "args", "out").collect()
    assert got[0]["out"] == "3" and "KeyError" in got[1]["out_error"]
    env.host("api.example.org")
    with pytest.raises(PermissionError):
        env.host("example.com")
    with pytest.raises(NotImplementedError):
        report.Envelope("s", report.Grants(), sandbox="container")
    assert env.audit.rows[-1] == ("s", "egress", "example.com", False)


def test_fair_service(spark):
    rows = spark.createDataFrame([("long", 0.0, 8, 1.0), ("short", 1.0, 2, 1.0)], "program string, arrives double, tasks bigint, seconds double")
    got = {r["program"]: r["seconds"] for r in route.fair_service(rows, 2)}
    assert got["short"] < got["long"]


DOC = {
    "name": "digest",
    "steps": [
        {"id": "in", "kind": "source", "source": {"from": "records", "records": [("1", "refund please", "a"), ("2", "crash", "b"), ("3", "URGENT crash", "b")], "schema": "id string, subject string, grp string"}},
        {"id": "d", "kind": "derive", "after": "in", "fields": {"line": "{{.grp}}: {{.subject}}"}},
        {"id": "ask", "kind": "ask", "after": "d", "prompt": "{{.line}}", "answers": [{"name": "category", "required": True}]},
        {"id": "fa", "kind": "fold", "after": "ask", "tier": "deep", "item": "category", "where": [{"field": "grp", "op": "is", "value": "a"}]},
        {"id": "fb", "kind": "fold", "after": "ask", "tier": "deep", "item": "category", "where": [{"field": "grp", "op": "is", "value": "b"}]},
        {"id": "all", "kind": "merge", "after": ["fb", "fa"], "tier": "deep", "item": "summary"},
    ],
}


def test_document(spark, tmp_path):
    doc = Document(DOC["name"], DOC["steps"])
    out = doc.build(spark, Registry(FAST, SUM))
    assert [out[k].first()["summary"] for k in ("fa", "fb", "all")] == ["SUM[1]", "SUM[2]", "SUM[2]"]
    assert doc.depth()["all"] == 4 and doc.layout()["fb"] == (3, 1)
    price = doc.price(spark, Registry(FAST, SUM))
    assert price["ask"]["calls"] == 3 and abs(sum(v["share"] for v in price.values()) - 1) < 1e-9
    path = str(tmp_path / "d.json")
    doc.save(path)
    assert [s["id"] for s in Document.load(path).steps] == [s["id"] for s in doc.steps]
    less = doc.apply([{"op": "remove", "id": "d"}, {"op": "set-cap", "id": "ask", "value": 10}])
    assert less.step("ask")["after"] == ["in"] and less.step("ask")["cap"] == 10 and doc.step("ask")["after"] == "d"
    for bad in ([{"id": "x", "kind": "keep", "after": "x"}], [{"id": "x", "kind": "keep"}], [{"id": "x", "kind": "what", "after": "in"}], [{"id": "in", "kind": "source"}]):
        with pytest.raises((DocumentError, KeyError)):
            Document("b", DOC["steps"][:1] + bad).validate()


def test_fleet(spark, tmp_path):
    from stratum.plans.fleet import Board, Fleet

    board = Board(spark, str(tmp_path / "board"))
    fleet = Fleet(spark, board)
    fleet.add("writer", lambda s, b: b.post("news", "writer", {"n": s.range(5).count()}))
    fleet.add("reader", lambda s, b: b.wait("news", 1))
    fleet.add("broken", lambda s, b: 1 / 0)
    out, reports = fleet.run()
    assert out["reader"] == [{"n": 5}] and [r.error[:17] for r in reports] == ["", "", "ZeroDivisionError"]
    board.post("news", "again", {"n": 5})
    assert board.posts("news").count() == 1
    assert fleet.bus.frame(spark).where("kind = 'agent-end'").count() == 3


def test_explain_projects_without_a_call(spark):
    from stratum.operators.infer import InferSpec
    from stratum.operators.reduce import numbered_prompt
    from stratum.plans.explain import explain
    from stratum.plans.models import Binding, Model, Pricing, Registry
    from stratum.plans.pipeline import Options, Pipeline

    def never(prompt):
        raise AssertionError("a projection calls no model")

    price = Pricing(1.0, 4.0)
    registry = Registry(Model("f", "fast", price, call=never, requests_per_minute=60), Model("d", "deep", price, call=never))
    p = Pipeline("tickets")
    rows = [(str(k), "en" if k % 2 else "fr", "t" * (4 * k)) for k in range(20)]
    spec = InferSpec(Binding(tier="fast"), "{{.text}}", system="s" * 40, prefix="p" * 80, max_tokens=100, schema=T.StructType([T.StructField("urgent", T.BooleanType())]))
    kept = p.from_records("tickets", rows, "id string, lang string, text string").filter("long", F.length("text") >= 16)
    asked = kept.infer("classify", spec, Options(batch=4))
    asked.filter("urgent", F.col("urgent")).reduce_ai("digest", Binding(tier="deep"), numbered_prompt("Sum:"), item="text", output="out", key="lang")
    got = explain(p, spark, registry)
    s = {x.stage: x for x in got.projection.stages}
    assert [x.records for x in got.projection.stages] == [20, 16, 16, 16, 16]
    fresh = sum(k + 1 for k in range(4, 20))
    shared = 11 + 21
    assert (s["classify"].tasks, s["classify"].calls, s["classify"].cached_tokens, s["classify"].prompt_tokens) == (4, 16, 15 * shared, fresh + 16 * shared)
    assert s["classify"].expected_usd == pytest.approx(price.cost_of(fresh, 16 * 35, 15 * shared, shared)) and s["classify"].floor_seconds == pytest.approx(16.0)
    assert s["digest"].calls == 2 and s["digest"].records == 16
    assert got.tainted == {"classify", "urgent", "digest"} and [x.exact for x in got.projection.stages] == [True, True, True, False, False]
    assert got.samples["long"][0]["lang"] in ("en", "fr") and set(got.samples["digest"][0]) == {"lang", "id", "out", "aggregated"}
    assert got.frame(spark).count() == 5 and not got.warnings
    one = Pipeline("one")
    one.from_records("r", rows, "id string, lang string, text string").infer("c", spec, Options(batch=50))
    assert "uncached" in explain(one, spark, registry).warnings[0]
