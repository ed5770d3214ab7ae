import itertools

import pytest
from pyspark.sql import types as T

from stratum.llm import jaccard_join as jj


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    out, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] * bool(cur)


def brute(rows):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if u and 100 * i >= 75 * u:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.similarity_components(df).collect()}
    assert got == brute(rows)


def test_against_brute_force_on_data(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_groups_of_edited_copies(spark):
    import random

    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    common = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(4):
        origin = [r.choice(vocabulary) for _ in range(r.randrange(30, 200))] + common
        for _ in range(40):
            w = list(origin)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000, " ".join(w)))
    for k in range(30):
        rows.append((2000 + k, " ".join([r.choice(vocabulary) for _ in range(20)] + common)))
    rows += [(3000 + k, " ".join(["same", "few"][: k % 3])) for k in range(6)] + [(4000, None), (4001, "  \n")]
    check(spark, rows)


def test_prefilter_bound():
    for n in range(1, 600):
        least = n
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            least = min(least, -(-3 * (n + m) // 7) - max(2 * n // 3, 2 * m // 3))
        assert max(1, n // 12 - 2) <= max(1, least)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f"), (2, "a b c d e f")]])
def test_degenerate(spark, rows):
    out = jj.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_extra_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", 5, 9), (1, "a b c d e f g", 5, 9), (3, "A b c d e f g", 1, 2)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(c, t) for c, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("component", T.LongType()), ("n", T.LongType())]]))
    assert sorted(r["component_id"] for r in jj.similarity_components(df).collect()) == [1, 1, 1]
    assert [r["doc_id"] for r in jj.keep_one(df).collect()] == [1]
    assert jj.keep_one(df).columns == df.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in jj.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, 5), (2, b, 1), (2, a + " eight", 2), (3, b, 3), (3, b, 4), (3, b, 3), (4, None, 1), (4, "", 0), (None, a, 1), (None, a, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.similarity_components(df).collect() if r["doc_id"])
    assert got == [(1, 3, 1), (2, 2, 2), (2, 4, 1), (3, 2, 2), (3, 2, 2), (3, 2, 2), (4, 0, 4), (4, 0, 4)]
    kept = sorted(tuple(r) for r in jj.keep_one(df).collect() if r["doc_id"])
    assert kept == [(1, a, 5), (2, b, 1), (4, None, 1)]
    assert jj.keep_one(df).where("doc_id is null").count() == 2


@pytest.mark.parametrize("limits", [{"BROADCAST_IDS": 0}, {"BUCKET": 200, "PLAIN_BUCKETS": 5, "FLUSH": 300}, {"BUCKET": 3000}])
def test_limits_change_no_result(spark, sf, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jj, k, v)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in jj.keep_one(df).collect()} == {k for k, (_, c) in brute(rows).items() if c == k}


def test_buckets_grow_without_a_step():
    sizes = [jj._buckets(t * 10**6) for t in range(1, 5000)]
    assert all(0 <= b - a <= 1 for a, b in zip(sizes, sizes[1:], strict=False))


def test_long_words_of_repeated_structure_differ(spark):
    s = "0"
    while len(s) < 2048:
        s += s.translate(str.maketrans("01", "10"))
    a, b = s[:1024], s[1024:]
    check(spark, [(1, f"x {a} y z w v"), (2, f"x {b} y z w v"), (3, f"x {a} y z w v")])
