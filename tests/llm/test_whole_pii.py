"""Personal data is looked for in whole texts, and every trained form can be returned."""

import random
import re

import duckdb
import numpy as np
import pytest

from stratum.llm import pii


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where length(text) between 1 and 3000 and regexp_matches(text, '[0-9@]') order by doc_id limit 2200").fetchall()
    return [r[0] for r in rows]


@pytest.fixture(scope="module")
def model(texts):
    return pii.train(texts[:-100])


def find(model, texts):
    raw = [t.encode() for t in texts]
    return pii.find_slab(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]), model)


@pytest.mark.parametrize("kind, form", pii.SYNTHETIC)
def test_every_trained_form_is_returned(model, texts, kind, form):
    r = random.Random(5)
    words = [w for t in texts[-100:] for w in t[:400].split() if w.isalpha()]
    lines = []
    for _ in range(40):
        own = re.sub(r"\{word\}", lambda _: r.choice(words).lower(), re.sub("#", lambda _: str(r.randrange(10)), form)).strip()
        head = " ".join(r.choice(words) for _ in range(r.randrange(1, 30))) + " "
        lines.append((head + own + " " + " ".join(r.choice(words) for _ in range(8)), len(head), len(head) + len(own)))
    hit = 0
    for (t, s, e), b, a in zip(lines, *find(model, [t for t, _, _ in lines]), strict=True):
        starts, x = pii.windows(t)
        read = (kind, s, e) in pii.reconcile(starts, model.decode(pii.cut_windows(x, starts)), t)
        # a base span that it touches stands in its place, as an IP does within ##.##.##.##.##
        hit += (kind, s, e) in a + b or read and any(p < e and s < q for _, p, q in b)
    assert hit >= len(lines) // 2


def test_an_address_without_digit_or_at_sign(model):
    base, added = find(model, ["write to jane (at) acme.com", "no address here"])
    assert base == [[], []] and added[0] and added[0][0][0] == 0 and not added[1]


def test_spans_are_those_of_decoding_every_window(model, texts):
    odd = ["a (at) " + "d" * 200, "jo" * 90 + " (AT) x.com", "1" * 150, "x" * 31 + "@" + "y" * 64, "中文 (at) é.com 7", "7"]
    for own in (texts[-100:], odd):
        for t, b, a in zip(own, *find(model, own), strict=True):
            starts, x = pii.windows(t)
            whole = pii.reconcile(starts, model.decode(pii.cut_windows(x, starts)), t)
            assert a == [s for s in whole if not any(s[1] < e and q < s[2] for _, q, e in b)]
