"""Personal data: patterns against plain regular expressions, the field's search against all segmentations, what training finds."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from logloom.llm import pii, queries

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            sums = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
            fine = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and sums % 10 == 0, 9 <= len(digits) <= 15][k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_ones():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@", ".", "_", "-", "+", "1", "25", "255", "256", "4", " ", "(", ")", "\n", "é", "😀", "4111 1111 1111 1111", "4532015112830366", "+1 (017) 555-7713", "x@y.z", "1.2.3.4", "００1", "٣"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)
    for _ in range(2000):
        text = "".join(rng.choices("a@.-1", k=rng.randint(0, 20)))
        assert pii.base_spans(text) == plain(text), repr(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "@" * 200_000, "+1 " * 60_000, "+1" + " " * 200_000, "1 " * 100_000, "a." * 100_000 + "@"])
def test_long_texts_take_linear_time(text):
    start = time.time()
    pii.base_spans(text)
    assert time.time() - start < 2


def all_segmentations(n, spans):
    """Every set of (start token, kind, end token) that do not overlap."""
    yield ()
    for i, (a, k, b) in enumerate(spans):
        for rest in all_segmentations(n, [x for x in spans[i + 1 :] if x[0] >= b]):
            yield ((a, k, b), *rest)


def test_search_finds_the_best_segmentation():
    rng = np.random.default_rng(2)
    for text in ["1 2a", "a@b.1", "+1 (2) 3", "7.8", "x1\n2", "12@3 4"]:
        for _ in range(6):
            field = pii.Field(rng.normal(0, 0.6, (pii.WIDTH, 4)), -0.7)
            t = pii.tokens(text)
            start, length, features = pii.candidates(t, 0, len(t))
            scores = field.scores(features)
            found = sorted(((int(s), k, int(s + l + 1)), float(scores[i, k])) for i, (s, l) in enumerate(zip(start, length, strict=True)) for k in range(4))
            best = max(sum(dict(found)[x] for x in chosen) - 0.7 * sum(a[2] == b[0] for a, b in zip(chosen, chosen[1:], strict=False)) for chosen in all_segmentations(len(t), [x for x, s in found if s > 0]))
            got = field.spans(t, margin=0.0)
            by_place = {(int(t.start[a]), k, int(t.end[b - 1])): (a, k, b) for a, k, b in dict(found)}
            own = [by_place[x] for x in got]
            assert abs(sum(dict(found)[x] for x in own) - 0.7 * sum(a[2] == b[0] for a, b in zip(own, own[1:], strict=False)) - best) < 1e-9


def test_fit_moves_along_the_likelihood():
    """The first step's direction is that of the exact gradient, summed over all segmentations."""
    text = "a 1 @"
    t = pii.tokens(text)
    start, length, features = pii.candidates(t, 0, len(t))
    spans = [(int(s), k, int(s + l + 1)) for s, l in zip(start, length, strict=True) for k in range(4)]
    of = {(int(s), int(s + l + 1)): features[i] for i, (s, l) in enumerate(zip(start, length, strict=True))}
    every = list(all_segmentations(len(t), sorted(spans)))
    behind = lambda c: sum(a[2] == b[0] for a, b in zip(c, c[1:], strict=False))
    mass = np.array([np.exp(-1.0 * behind(c)) for c in every])
    gradient = np.zeros((pii.WIDTH, 4))
    for p, c in zip(mass / mass.sum(), every, strict=True):
        for a, k, b in c:
            np.add.at(gradient[:, k], of[a, b], -p)
    np.add.at(gradient[:, 2], of[2, 3], 1)
    field = pii.fit([(text, [(2, 2, 3)])], rounds=1, rate=1.0)
    moved = np.abs(gradient) > 1e-6
    assert (np.sign(field.weights[moved]) == np.sign(gradient[moved])).all()
    assert np.allclose(field.weights[~moved], 0, atol=0.2)


SCHEMA = "doc_id long, text string, base string, found string"


def test_training_finds_other_spellings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train(docs)
    found = lambda x: [(pii.KINDS[k], x[s:e]) for s, k, e in pii.added_spans(field, x, pii.base_spans(x))]
    assert found("Call (017) 555-7713 today") == [("phone", "(017) 555-7713")]
    assert found("write to er.34[@]mail7.example.com now") == [("email", "er.34[@]mail7.example.com")]
    assert found("pay 4532.0151.1283.0366 by") == [("card", "4532.0151.1283.0366")]
    for clean in ["in 1987 and 2001 there", "pages 3-9 of 77", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f"', "pi is 3.14159", "", "no digits here", "4532.0151.1283.0367 fails"]:
        assert found(clean) == []
    rows = docs.select("doc_id", "text").collect()
    clean_rows = [r["text"] for r in rows if r["text"] and not pii.base_spans(r["text"])]
    assert sum(bool(found(x)) for x in clean_rows) <= len(clean_rows) * 0.005


def test_odd_rows(spark):
    texts = [None, "", " ", "x@y.zz", "1.2.3.4 " * 3000, "9" * 40_000, "é😀 a.b@c.de 😀", "a.b@c.de"]
    df = spark.createDataFrame([*[(i, x, "clash", "clash") for i, x in enumerate(texts)], (7, texts[7], "clash", "clash")], SCHEMA)
    out = pii.find(df)
    assert out.columns == ["doc_id", "text", "base", "found", "added"]
    for r in out.collect():
        own = plain(r["text"] or "") if len(r["text"] or "") < 30_000 else pii.base_spans(r["text"])
        assert [tuple(x) for x in r["base"]] == own
        assert all(e <= s["start"] or b >= s["end"] for s in r["added"] for b, _, e in own)
        assert r["found"] == "clash"
    assert pii.find(df.limit(0)).count() == 0
    plain_text = spark.createDataFrame([(1, "no digits", "", "")], SCHEMA)
    assert pii.find(plain_text).first()["added"] == []


def test_query_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in own) for i in range(4)]
        named = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(named) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
    assert {dict(queries.op12_pii(spark, sf).dtypes)[f"n_{k}"] for k in pii.KINDS} == {"bigint"}
