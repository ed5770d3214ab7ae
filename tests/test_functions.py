import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions import text as txt
from stratum.functions import values as val
from stratum.functions.conditions import Cond
from stratum.functions.templates import TemplateError, compile_template, fields, parse


@pytest.fixture(scope="module")
def record(spark):
    return spark.createDataFrame([("payments", 214, ["a"], [], " ", None)], "vertical string, count bigint, topics array<string>, empty array<string>, blank string, nothing string")


@pytest.mark.parametrize(
    ("field", "op", "value", "want"),
    [
        ("vertical", "is", "payments", True), ("vertical", "is-not", "payments", False), ("vertical", "contains", "pay", True), ("vertical", "contains", "PAY", False),
        ("vertical", "not-contains", "x", True), ("topics", "non-empty", "", True), ("empty", "non-empty", "", False),
        ("empty", "empty", "", True), ("blank", "empty", "", True), ("vertical", "exists", "", True), ("absent", "missing", "", True),
        ("count", "gt", "99", True), ("count", "gte", "214", True), ("count", "lt", "1000", True), ("absent", "lt", "5", True),
        ("absent", "is-not", "x", True), ("nothing", "is", "", True), ("vertical", "gt", "5", True), ("topics", "contains", "a", True), ("topics", "contains", "A", False), ("topics", "contains", "[a]", True), ("vertical", "gt", "1d", True), ("count", "lt", "1d", False), ("count", "lt", " 2.15e2 ", True),
    ],
)
def test_conditions(record, field, op, value, want):
    assert record.select(Cond(field, op, value).column(record.schema).alias("x")).first()["x"] is want


def test_unknown_condition(record):
    with pytest.raises(ValueError):
        Cond("vertical", "like", "x").column(record.schema)


@pytest.mark.parametrize(
    ("x", "want"),
    [(1234567.0, "1.234567e+06"), (123456.0, "123456"), (0.5, "0.5"), (2e7, "2e+07"), (0.00012, "0.00012"), (0.000012, "1.2e-05"), (-3.25, "-3.25"), (0.0, "0"), (1e100, "1e+100"), (1000000.0, "1e+06"), (999999.5, "999999.5")],
)
def test_render_double(spark, x, want):
    assert spark.range(1).select(val.render(F.lit(x), T.DoubleType()).alias("x")).first()["x"] == want


def test_coercions(spark):
    d = spark.createDataFrame([(" a, b ,,c", ["x ", "", "y"], 5)], "s string, l array<string>, n bigint")
    got = d.select(*[val.as_strings(F.col(c), d.schema[c].dataType).alias(c) for c in d.columns]).first()
    assert (got["s"], got["l"], got["n"]) == (["a", "b", "c"], ["x", "y"], ["5"])
    assert d.select(val.as_number(F.col("s")).alias("x")).first()["x"] is None


def test_event_times(spark):
    rows = [("2026-03-01T12:00:00Z",), ("2026-03-01 12:00:00",), ("2026-03-01T13:00:00.5+01:00",), ("soon",), (None,)]
    d = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in d.select(F.unix_millis(val.event_time(F.col("t"), T.StringType()))).collect()]
    assert got == [1772366400000, 1772366400000, 1772366400500, None, None]


TEMPLATE = 'Hi {{.name}}{{if .tags}} [{{range .tags}}<{{.}}>{{end}}]{{else}} none{{end}} {{join .tags}} {{clock .at}} {{broadcast "tone"}}{{broadcastJSON "map"}}'


def test_templates(spark):
    d = spark.createDataFrame([("Ann", ["x", " y"], "2026-03-01T12:34:56Z"), (None, [], "short")], "name string, tags array<string>, at string")
    t = compile_template(TEMPLATE, d.schema, broadcasts={"tone": "calm", "map": {"b": 1, "a": 2}})
    assert [r[0] for r in d.select(t).collect()] == ['Hi Ann [<x>< y>] x, y 12:34 calm{"a": 2, "b": 1}', 'Hi  none none short calm{"a": 2, "b": 1}']
    assert fields(TEMPLATE) == {"name", "tags", "at"}
    for bad in ("{{.gone}}", "{{if .name}}", "{{end}}", "{{else}}", "{{nope .name}}", "{{.}}", "{{range .name}}x{{end}}", '{{broadcast "x"}}'):
        with pytest.raises(TemplateError):
            compile_template(bad, d.schema)
    assert d.select(compile_template("a{{.gone}}b", d.schema, strict=False)).first()[0] == "ab"
    assert parse("plain") == ["plain"]


def test_text(spark):
    d = spark.createDataFrame([("Ann: hi\nBob: yo\nAnn: bye\nno speaker", "  Hello, World! ", "x" * 30)], "t string, s string, l string")
    got = txt.pseudonymize_speakers(d, "t").first()
    assert got["t"] == "S1: hi\nS2: yo\nS1: bye\nno speaker"
    assert got.__len__() == 3
    r = d.select(txt.slug(F.col("s")).alias("a"), txt.slug(F.lit("!!")).alias("b"), txt.truncate(F.col("l"), 5).alias("c"), txt.mask_private(F.lit("a@b.co +1 (234) 567-8901, 1234567 http://x.y/z")).alias("d")).first()
    assert (r["a"], r["b"], r["c"]) == ("hello-world", "step", "xxxxx …")
    assert r["d"] == "<email> <phone>, <number> <url>"
