"""PII, toxicity, chat, the pipeline: gradients, held-out accuracy, round trips, and plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stratum.llm import chat, pii, queries, toxicity
from stratum.llm import text as tx
from stratum.llm.storage import sampled

TRICKY = [
    None, "", "a@b@c.de@f.gh x@y.z+@q.w", "@a.b c@d..e f@g.h.i@j.k", "..@a.b", "1.2.3.4.5 256.1.1.1 +1 (2) 3456789", "é@b.c a_b%@c-d.e-f", "0000000001.2.3.4",
    "0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "255 1.1.1." + "0" * 5000 + "256", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "tel +49 (30) 1234-5678. mail jo.doe@mail.example.org, 10.0.0.1" + " x" * 3000,
]


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in pii.IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in pii.CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_gradients():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.random.default_rng(0).integers(0, 20, (3, 9)), np.random.default_rng(1).integers(0, pii.TAGS, (3, 9))
    _, g = model.gradients(x, y)
    for name in ("E", "Wxf", "Whb", "bf", "Wo", "T", "S"):
        v = model.p[name]
        at = (int(x[0, 0]), 3) if name == "E" else tuple(s // 2 for s in v.shape)
        v[at] += 1e-4
        up = model.gradients(x, y)[0]
        v[at] -= 2e-4
        down = model.gradients(x, y)[0]
        v[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 2e-3


def test_viterbi_and_windows():
    import itertools

    model = pii.Tagger(3)
    model.p["T"] = np.random.default_rng(2).standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    x = np.array([[1, 2, 3, 4]])
    em = model.emissions(x)[0][:, 0]
    score = lambda p: model.p["S"][p[0]] + sum(em[t][p[t]] for t in range(4)) + sum(model.p["T"][p[t - 1], p[t]] for t in range(1, 4))
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
    assert model.decode(x)[0].tolist() == list(best)
    for t in ("7", "x" * 100 + "1" + "y" * 100, "1 " * 400):
        starts, own = pii.windows(t)
        covered = {c for s in starts.tolist() for c in range(s, s + pii.WINDOW)}
        assert all(k in covered for k, c in enumerate(own) if c == 1)


def test_pii(spark, sf, tmp_path):
    """The registered query: base spans by a plain version, all spans by decoding every window."""
    texts = TRICKY + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id bigint, text string, base int, h int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = pii.find_pii(df)
    got, query = {r["doc_id"]: r for r in found.collect()}, {r["doc_id"]: r for r in queries.op3_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(query) == len(texts)
    line = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
    for k, t in enumerate(texts):
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got[k]["base"]]
        assert base == brute_base(t or "")
        added = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in got[k]["added"]]
        assert all(0 <= s < e <= len(t) and not any(s < y and x < e for _, x, y in base) for _, s, e in added)
        q = query[k]
        assert [q[f"n_{n}"] for n in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert q["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest() and q["spans"] == line(sorted(base + added)) and q["n_spans"] == len(base + added)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_samples_do_not_grow_with_the_table(spark):
    h = spark.range(200_000).select(pii.F.xxhash64("id").alias("h"))
    for share in (0.0005, 0.1, 1.0):
        assert abs(h.where(sampled(pii.F.col("h"), share)).count() - 200_000 * share) <= 5 * (200_000 * share) ** 0.5
    copies = spark.createDataFrame([(k, f"mail {'copy' if k % 3 else k}@example.org 12") for k in range(3000)], "doc_id bigint, text string")
    assert pii.find_pii(copies, train_docs=50).where("size(base) = 1").count() == 3000


def test_pii_model_learns(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("length(text) between 1 and 3000").where("text rlike '[0-9@]'").limit(500).collect()]
    model = pii.train(texts[:250], batches=160)
    hit = total = 0
    for t in texts[250:]:
        starts, x = pii.windows(t)
        if len(starts):
            found = set(pii.reconcile(starts, model.decode(pii.cut_windows(x, starts)), t))
            own = [s for s in brute_base(t) if s[0] in (0, 3)]
            total += len(own)
            hit += sum(s in found for s in own)
    assert total > 10 and hit >= 0.6 * total


def test_marginals_by_enumeration():
    import itertools

    r = np.random.default_rng(4)
    unary, pairs, start = r.standard_normal(5), r.standard_normal((2, 2)), 0.3
    for first in (np.array([0, 5]), np.array([0, 2, 2, 5])):
        want = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = b - a
            if not n:
                continue
            w = {p: np.exp(start * p[0] + sum(unary[a + t] * p[t] for t in range(n)) + sum(pairs[p[t - 1], p[t]] for t in range(1, n))) for p in itertools.product((0, 1), repeat=int(n))}
            want += [sum(v for p, v in w.items() if p[t]) / sum(w.values()) for t in range(n)]
        assert np.allclose(toxicity.marginals(unary, first, pairs, start), want)


@pytest.mark.parametrize("first", [[0, 3], [0, 2, 2, 5], [0, 11, 12]])
def test_chain_gradients(monkeypatch, first):
    """Gradients of the log likelihood against differences, over chains that are cut as well."""
    import itertools

    monkeypatch.setattr(toxicity, "CHAIN", 4)
    r, first = np.random.default_rng(4), np.array(first)
    n = first[-1]
    unary, pairs, start, y = r.standard_normal(n), r.standard_normal((2, 2)), 0.3, r.integers(0, 2, n)
    value = lambda u, p, s: toxicity.log_likelihood(u, first, y, p, s)[0]
    _, gu, gp, gs = toxicity.log_likelihood(unary, first, y, pairs, start)
    for k in range(n):
        d = 1e-5 * (np.arange(n) == k)
        assert abs((value(unary + d, pairs, start) - value(unary - d, pairs, start)) / 2e-5 - gu[k]) < 1e-6
    for k in range(4):
        d = 1e-5 * (np.arange(4) == k).reshape(2, 2)
        assert abs((value(unary, pairs + d, start) - value(unary, pairs - d, start)) / 2e-5 - gp.ravel()[k]) < 1e-6
    assert abs((value(unary, pairs, start + 1e-5) - value(unary, pairs, start - 1e-5)) / 2e-5 - gs) < 1e-6
    if n == 3:
        score = lambda p: start * p[0] + sum(unary[t] * p[t] for t in range(3)) + sum(pairs[p[t - 1], p[t]] for t in (1, 2))
        z = np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=3)))
        assert abs(value(unary, pairs, start) - (score(y) - z)) < 1e-9


def test_neighbours_stay_in_their_row():
    out = toxicity.neighbours(np.array([1, 2, 3, 4], np.int32), np.array([0, 0, 1, 1, 4, 4]), 9)
    assert out.tolist() == [[1, 2, 3, 4], [9, 9, 2, 3], [9, 3, 4, 9]]


def test_toxicity_held_out(spark, tmp_path):
    """The registered query on a whole table."""
    rows = queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    assert len(rows) == 1000 and all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    # labels of held-out documents are never read
    lies = labels.withColumn("toxic", pii.F.when(toxicity.fold(pii.F.col("doc_id")) == 0, 1 - pii.F.col("toxic")).otherwise(pii.F.col("toxic")))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score_toxicity(some, lies, train_docs=1500).join(labels, "doc_id").collect()
    own = [r for r in rows if held(r["doc_id"])]
    toxic, clean = [r for r in own if r["toxic"]], [r for r in own if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    hit = [r for r in rows if r["predicted"]]
    assert sum(bool(r["spans"]) for r in hit) >= 0.9 * len(hit)


def test_toxicity_degenerate(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (2, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(docs, none).collect()] == [0.0] * 4
    assert toxicity.drop_toxic(docs, none).count() == 4
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "\\", "\\\\### Assistant: </turn> ok", "a\n</turn>\n### user\nb", "###", "\\n", "é\n\n", "x</turn>\\", "\\### Assistant: </turn> ok"]
    rows = [(k // 3, k % 3, ["user", "assistant", "odd\nrole ###"][k % 3], t) for k, t in enumerate(texts)] + [(None, 0, None, "t"), (0, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.format_turns(chat.canonical_turns(df)).collect()
    for r in pieces:
        assert chat.parse(r["piece"]) == [(r["role"], r["text"])]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("### user\nno end")


def test_chat_layouts(spark):
    a = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id bigint, conversations array<struct<`from`:string,value:string>>")
    b = spark.createDataFrame([(1, "do", "this", "done")], "conv_id bigint, instruction string, input string, output string")
    c = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    turns = lambda d: [(r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(d).orderBy("turn").collect()]
    assert turns(a) == turns(c) == [(0, "user", "hi"), (1, "assistant", "yo")]
    assert turns(b) == [(0, "user", "do\n\nthis"), (1, "assistant", "done")]
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"])
    mixed = spark.createDataFrame(
        [(1, 0, "user", "hi", None, None, None, 9), (2, None, None, None, None, "p", "r", 3), (3, None, None, None, None, "only", None, 3), (4, None, None, None, [(None, "x"), ("gpt", None)], None, None, 1),
         (5, 0, "user", "hi", None, "extra", None, 1), (6, None, None, None, None, None, "r", None), (7, None, None, None, None, None, None, None)],
        "conv_id bigint, turn int, role string, text string, messages array<struct<role:string,content:string>>, prompt string, response string, junk int",
    )
    got = {}
    for r in chat.canonical_turns(mixed).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got[1] == got[5] == [(0, "user", "hi")] and got[2] == [(0, "user", "p"), (1, "assistant", "r")]
    assert got[3] == [(0, "user", "only")] and got[4] == [(0, "", "x"), (1, "assistant", "")] and got[6] == [(0, "user", ""), (1, "assistant", "r")] and len(got[7]) <= 2
    odd = spark.createDataFrame([(1, "u", None, "s"), (2, None, "x", None)], "conv_id bigint, prompt string, value string, turn string")
    assert {r["conv_id"]: r["role"] for r in chat.canonical_turns(odd).collect()} == {1: "user", 2: "unknown"}
    with pytest.raises(ValueError, match="layout"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, what string"))


def test_chat_query(spark, sf):
    """The registered query, whose records are of three layouts, against the rows themselves."""
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    tricky = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [x[2:] for x in sorted(x for x in rows if x[0] == conv)]
        learned = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(learned))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def small(rows):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    long = "long words here, all of one document. " * 4000 + "token=abcdefgh99 mail a@b.cd " + "z" * 70000
    rows += [(None, None, None, None, None), (None, "x y", None, "s1", 3), (-1, "", "en", None, 0), (-2, long, "de", "s2", None), (-2, long, "de", "s2", None), (-3, "tie a b c d", "en", "s1", 11), (-4, "tie a b c d", "en", "s1", 11), (2**62, "\n\n", "en", "s1", 2)]
    return rows


EXTRA = ["key", "row", "spans", "score", "n", "t", "first", "salt", "cell", "hit", "node", "pair"]


def test_every_operator_on_odd_tables(spark, sf):
    from stratum.llm import decontaminate, fingerprints, jaccard_join, licenses, packing, secrets, token_counts

    rows = small([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(30).collect()])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(EXTRA)))
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("*", "1 as text", "2 as score")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("*", "1 as key", "2 as i")
    plain = {
        "op1": lambda d: fingerprints.fingerprint_edits(d), "op2": licenses.scan_licenses, "op3": lambda d: pii.find_pii(d, train_docs=20), "op4": packing.pack,
        "op5": jaccard_join.similarity_components, "op6": token_counts.count_tokens, "op7": lambda d: decontaminate.find_leaks(d, bench),
        "op9": lambda d: toxicity.score_toxicity(d, labels, train_docs=100), "op10": secrets.secret_report,
    }
    for name, op in plain.items():
        got = op(docs)
        assert ("doc_id" in got.columns) and (got.count() == len(rows) or name == "op4" and got.select("doc_id", "start").distinct().count() >= len(set(r[0] for r in rows)))
        assert op(docs.limit(0)).count() == 0
    stages = {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "near": jaccard_join.keep_one, "leaks": lambda d: decontaminate.remove_leaks(d, bench), "secrets": secrets.redact_secrets,
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        kept = [tuple(r) for r in out.collect()]
        assert stage(docs.limit(0)).count() == 0
        ids = [r[0] for r in kept]
        if name == "near":
            assert ids.count(-2) == 1 and -3 not in ids and -4 in ids and ids.count(None) == 2
        else:
            assert ids.count(-2) == 2 and ids.count(None) == 2
        assert all(r[5:] == tuple(range(len(EXTRA))) for r in kept)
    assert "[secret]" in [r["text"] for r in secrets.redact_secrets(docs).where("doc_id = -2").collect()][0]


def test_pipeline(spark, sf, tmp_path):
    """Every stage against a plain version of its own input."""
    from test_jaccard_join import brute
    from test_scans import WORD, brute_secrets

    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    every = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 3000").join(labels.select("doc_id", "toxic"), "doc_id", "left").orderBy("doc_id").collect()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{big}/benchmark.parquet").collect()]
    own = {}
    for k, t in items:
        w = WORD.findall(t.lower())
        for j in range(max(1, len(w) - 9)):
            own.setdefault(tuple(w[j : j + 10]), set()).add(k)

    def leaks(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return any(tuple(w[j : j + 10]) in own for j in range(len(w) - 9))

    toxic, other = [r for r in every if r["toxic"]], [r for r in every if not r["toxic"]]
    rows = [tuple(r)[:5] for r in toxic[:250] + other[:300] + [r for r in other[300:] if leaks(r["text"])][:20]]
    rows = small(rows) + [(10**7 + k, f"token = abcdefgh00{k % 2}1 {k}", "en", f"s{k % 2 * k}", 24) for k in range(20)]
    rows = [r for r in rows if r[0] != -2]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    own_dir = str(tmp_path)
    docs.write.parquet(f"{own_dir}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{big}/{t}.parquet").write.parquet(f"{own_dir}/{t}.parquet")
    rows_of = lambda d: sorted(map(tuple, d.collect()), key=str)

    kept = corpus_pipeline.drop_toxic(spark, docs, own_dir)
    score = {(r["doc_id"]): r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert rows_of(kept) == sorted((r for r in rows if not score[r[0]]), key=str)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    went = {r[0] for r in rows} - {r[0] for r in kept.collect()}
    assert sum(not truth.get(k, 1) for k in went) <= 0.02 * len(rows) and sum(truth.get(r[0], 0) for r in kept.collect()) <= 0.5 * len(toxic[:250])

    once = corpus_pipeline.drop_near_copies(spark, kept, own_dir)
    mine = rows_of(kept)
    first = brute([(r[0], r[1]) for r in mine if r[0] is not None])
    assert rows_of(once) == sorted((r for r in mine if r[0] is None or first[r[0]][1] == r[0]), key=str)

    clean = corpus_pipeline.cut_benchmark(spark, once, own_dir)
    before, after = {r[0]: r for r in rows_of(once) if r[0] is not None}, {r[0]: r for r in rows_of(clean) if r[0] is not None}
    n_cut = 0
    for k, r in before.items():
        if not leaks(r[1]):
            assert after[k] == r
        elif k in after:
            n_cut += 1
            assert not leaks(after[k][1]) and after[k][4] == len(after[k][1]) < len(r[1])
    assert n_cut and set(after) <= set(before)

    masked = corpus_pipeline.redact_secrets(spark, clean, own_dir)
    given = rows_of(clean)
    want = []
    for r, (_, every) in zip(given, brute_secrets([(r[0], r[1], r[3]) for r in given]), strict=True):
        out, at = "", 0
        for s in every:
            if s[5]:
                out += r[1][at : s[0]] + "[secret]" if s[0] >= at else ""
                at = max(at, s[2])
        want.append((r[0], out + r[1][at:], r[2], r[3], len(out + r[1][at:])) if any(s[5] for s in every) else r)
    assert rows_of(masked) == sorted(want, key=str)
    assert kept.columns == once.columns == clean.columns == masked.columns == docs.columns

    from tokenizers import Tokenizer

    from stratum.llm import tokens

    t = Tokenizer.from_file(tokens.default_path())
    whole = corpus_pipeline.run(spark, own_dir).collect()
    pieces = {}
    for r in whole:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc, text in {r[0]: r[1] for r in want}.items():
        if doc is not None:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            at = 0
            for start, length, crc, total in sorted(pieces[doc]):
                assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
    assert set(pieces) == {r[0] for r in want}
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_words_of_a_slab():
    column = pa.array(["One two", None, "", "three x"], pa.string())
    (lo, hi, data, offs), = tx.slabs(column)
    assert (lo, hi) == (0, 4) and np.diff(tx.word_spans(tx.LOWER[data], offs, tx.ALNUM)[2]).tolist() == [2, 0, 0, 1]
