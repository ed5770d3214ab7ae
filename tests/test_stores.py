"""Stores that are appended to, limits of models, guards, table functions."""

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratum.operators import findings, route
from stratum.plans.fleet import Board
from stratum.plans.limits import Limits, RateLimiter, admission
from stratum.plans.models import Model
from stratum.storage import append, read_appended, shared_dir


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def admitted(limits, needs):
    clock = Clock()
    limiter, out = RateLimiter(clock, clock.sleep), []
    for n in needs:
        with limiter.admit("m", limits, n):
            out.append(round(clock.now, 6))
    return out


def test_requests_burst_and_then_go_by_their_rate():
    assert admitted(Limits(requests_per_minute=3), [0] * 6) == [0, 0, 0, 20, 40, 60]


def test_a_request_of_more_than_a_minute_waits_for_a_full_bucket():
    assert admitted(Limits(tokens_per_minute=60), [30, 500, 10]) == [0, 30, 40]


def test_both_rates_hold():
    assert admitted(Limits(2, 60), [60, 0, 60]) == [0, 0, 60]


def test_shares_add_up_and_each_can_serve_a_request():
    assert Limits(10, 100, 5).share(4) == Limits(2.5, 25, 2)
    assert admitted(Limits(requests_per_minute=0.5), [0, 0]) == [0, 120]


def test_no_limit_admits_at_once():
    assert admitted(Limits(), [5, 5]) == [0, 0]


@pytest.mark.parametrize("limits", [Limits(requests_per_minute=7), Limits(tokens_per_minute=90)])
def test_planned_admission_is_what_the_limiter_does(spark, limits):
    needs = [(k * 37) % 120 for k in range(40)]
    rows = spark.createDataFrame([("m", k, n) for k, n in enumerate(needs)] + [(None, 0, 5)], "model string, id int, tokens int")
    got = {(r["model"], r["id"]): r["admitted"] for r in admission(rows, limits, tokens=F.col("tokens"), chunk=8).collect()}
    # what the limiter waits at least is a hundredth of a second
    assert [got["m", k] for k in range(40)] == pytest.approx(admitted(limits, needs), abs=0.02 * 40)
    assert got[None, 0] == 0


def test_planned_admission_of_two_rates_or_none_is_refused(spark):
    rows = spark.createDataFrame([("m", 1)], "model string, id int")
    for limits in (Limits(), Limits(1, 1)):
        with pytest.raises(ValueError):
            admission(rows, limits)


def test_a_called_model_keeps_to_its_share(spark):
    calls = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "id int, prompt string")
    model = Model("m", call=lambda p: p.upper(), requests_per_minute=60_000, max_concurrent=2, tasks=2)
    got = model.respond(calls, "prompt", "r")
    assert got.rdd.getNumPartitions() == 2
    assert sorted(r["r"] for r in got.collect()) == sorted(f"P{k}" for k in range(12))


def test_posts_side_by_side_are_all_kept(spark):
    board = Board(spark, f"{shared_dir(spark)}/board-{uuid.uuid4().hex}")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: board.post("t", f"a{k}", {"k": k}), range(18)))
    assert board.posts("t").count() == 18


def test_a_store_that_is_not_there_or_holds_torn_lines(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_appended(spark, path, "a int", "json").count() == 0
    append(spark.range(3).select(F.col("id").cast("int").alias("a")), path, "json")
    (tmp_path / "store" / "torn.json").write_text('{"a": 7}\n{"a": 8, "b"')
    assert sorted(r[0] for r in read_appended(spark, path, "a int", "json").collect()) == [0, 1, 2, 7]


def test_profiles_add_up_and_other_versions_are_left_out(spark, tmp_path):
    path = str(tmp_path / "profile")
    one = spark.createDataFrame([("s", "b", 0, 3, 1, 4)], route.PROFILE)
    assert route.load_profile(spark, path).count() == 0
    for _ in range(2):
        route.save_profile(one, path)
    append(one.withColumn("version", F.lit(route.PROFILE_VERSION + 1)), path, "json")
    assert [tuple(r) for r in route.load_profile(spark, path).select("accepted", "rejected", "starts").collect()] == [(6, 2, 8)]


@pytest.mark.parametrize(
    "args, text",
    [({"q": "why", "n": "1"}, "why"), ({"text": "b", "query": "a"}, "a"), ({"query": " ", "text": "b"}, "b"), ({"only": "this"}, "this"), ({"x": "1", "y": "2"}, None), ({"query": " "}, None), ({}, None), (None, None)],
)
def test_a_tool_call_s_question(spark, args, text):
    d = spark.createDataFrame([(args,)], "args map<string,string>").select(findings.tool_question(F.col("args"), "t").alias("q"))
    row = d.first()["q"]
    assert (row and row["text"]) == text
