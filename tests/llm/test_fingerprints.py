import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stratum.llm import fingerprints as fp
from stratum.llm import queries


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(5, "one two\nthree", 1), (None, None, 2), (2**40, "", 3), (-7, "x" * 5000 + "\n" + "é ü " * 900, 4), (5, "one two\nthree", 5), (6, None, 6), (5, "another", 7)],
        "doc_id bigint, text string, cell int",
    )


def test_next_text(spark, odd):
    got = [tuple(r) for r in fp.with_next(odd).collect()]
    assert sorted(r[2] for r in got if r[0] is None) == [""]
    assert {r[2] for r in got if r[0] == -7} <= {"one two\nthree", "another"} and {r[2] for r in got if r[0] == 6} == {""}
    assert {r[2] for r in got if r[0] == 2**40} == {"x" * 5000 + "\n" + "é ü " * 900}
    # of the rows of one id the last is followed by the next id, the others by each other
    five = [r for r in got if r[0] == 5]
    assert sorted(r[1] for r in five) == ["another", "one two\nthree", "one two\nthree"]
    assert sorted(r[2] for r in five)[0] == "" and set(r[2] for r in five) <= {"", "another", "one two\nthree"}


def test_next_over_many_cells(spark):
    ids = [k * k * 37 for k in range(400)] + [2**50 + k for k in range(5)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r[0]: r[2] for r in fp.with_next(df).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_digests(spark, odd):
    for r in fp.fingerprint_edits(odd).collect():
        assert len(r["fingerprint"]) == 64 and 0 <= r["near_edited"] <= 1
    one = fp.fingerprint_edits(spark.createDataFrame([(1, "abcdé f")], "doc_id bigint, text string")).first()
    assert one["n_chars"] == 7
    assert one["edited_sha256"] == hashlib.sha256("abcdabc".encode()).hexdigest()
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def tree(text):
    """A plain version: distinct leaves, section nodes, root."""
    sha = lambda level, t: hashlib.sha256((level + t).encode()).hexdigest()
    lines = [[sha("l", p) for p in re.findall(fp.PIECE, line)] for line in text.split("\n")]
    sections, own = [], []
    for h in [sha("p", "".join(x)) for x in lines]:
        own.append(h)
        if h[0] in "01":
            sections.append(sha("s", "".join(own)))
            own = []
    sections += [sha("s", "".join(own))] if own else []
    return {x for y in lines for x in y}, sections, sha("r", "".join(sections))


def test_trees_against_a_plain_version(spark, sf):
    texts = ["", "\n", "a", "a\n", "d", "x" * 3000 + "dy" * 40, "é ü  中文 day\tby\n\n\ny"] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in fp.trees(df, "t").collect():
        t = texts[r["k"]]
        leaves, nodes, root = tree(t)
        assert (set(r["leaves"]), r["nodes"], r["root"]) == (leaves, nodes, root)
        assert "".join(p for line in t.split("\n") for p in re.findall(fp.PIECE, line)) == t.replace("\n", "")  # the leaves hold every character


def test_equal_texts_equal_roots_and_edits_are_located(spark):
    a = "\n".join(f"line number {k} of a text" for k in range(60))
    b = a.replace("number 17 ", "number seventeen ").replace("line number 40 of a text\n", "")
    df = spark.createDataFrame([(a, b, 1), (a, a, 2), (None, "x", 3), (a, "first\n" + a, 4)], "a string, b string, node int")
    got = {r["node"]: (r["put_in"], r["taken_out"]) for r in fp.differing(df, "a", "b").collect()}
    assert got == {1: ([17], [17, 40]), 2: ([], []), 3: ([0], [0]), 4: ([0], [])}
    d = fp.trees(fp.trees(df.where("node = 1"), "a", "a_"), "b", "b_")
    r = d.select(fp.likeness(F.col("a_leaves"), F.col("b_leaves")).alias("l"), F.size(F.array_except("b_nodes", "a_nodes")).alias("n")).first()
    assert 0.9 < r["l"] < 1 and r["n"] <= 2


def test_a_word_put_in_moves_no_distant_leaf(spark):
    words = [f"w{k}" + "ady"[k % 3] for k in range(400)]
    df = spark.createDataFrame([(" ".join(words), " ".join(["new", *words]))], "a string, b string")
    d = fp.trees(fp.trees(df, "a", "a_"), "b", "b_")
    assert d.select(fp.likeness(F.col("a_leaves"), F.col("b_leaves"))).first()[0] > 0.98


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: tuple(r) for r in c.execute(fp.ORACLE).fetchall()}
    assert {r[0]: tuple(r) for r in queries.op1_fingerprints(spark, sf).collect()} == want
