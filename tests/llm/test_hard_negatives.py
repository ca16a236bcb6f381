"""Hard negatives against brute force: ties, copies, odd rows, long numbers; the bounds keep most rows from being scored."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string"


def brute(rows, scale=256, low=80, full=100):
    fine = {(i, l, tuple(math.floor(scale * x) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, la, va in fine:
        if a % 100:
            continue
        met = sorted({(-sum(x * y for x, y in zip(va, v, strict=True)), i, lb == la) for i, lb, v in fine if i != a and len(v) == len(va)})
        for s, p, _ in [x for x in met if x[2]][:5]:
            window = [x for x in met if not x[2] and low * -s <= full * -x[0] <= full * -s][:5]
            out |= {(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "PASS_BYTES", 1000)  # several passes
    rng = random.Random(3)
    base = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(25)]
    rows = []
    for i in range(400):
        v = list(rng.choice(base)) if rng.random() < 0.6 else [rng.gauss(0, 0.2) for _ in range(6)]
        if rng.random() < 0.5:
            v[rng.randrange(6)] += rng.choice([0.001, 0.01, -0.02])
        rows.append((i * rng.choice([1, 1, 50]), v, rng.randrange(3)))
    rows += rows[:40]  # repeated rows
    rows += [(500_000 + i, base[0], i % 2) for i in range(300)]  # a large group of copies
    rows += [(200, [0.1, 0.2, 0.3], 1), (201, [0.2, 0.2, 0.1], 1), (202, [0.2, 0.2, 0.1], 2), (300, [], 1), (301, [], 1), (303, [], 0)]
    rows += [(None, base[1], 1), (400, None, 1), (401, base[1], None), (402, [*base[1][:5], None], 1), (403, [*base[1][:5], math.nan], 1), (404, [math.inf, *base[1][1:]], 1), (-100, base[2], 1), (-7, base[2], 0)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_numbers_beyond_doubles(spark):
    rows = [(i, [3e4 * (i + 1) + 0.7, 1e4 * i, -2.5e4], i % 2) for i in range(12)]
    rows = [(i, [x * 60 for x in v], label) for i, v, label in rows]  # products need more than 53 bits
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.1], 0)], [(100, [0.1], 0)], [(100, [0.1], 0), (101, [0.1], 0)], [(100, None, None)], [(100, [-0.5], 0), (1, [0.5], 0), (2, [0.6], 1)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows) == set()


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(0, 0.125, (4000, 64)))
    book = H.fit(v[:2000])
    codes, left = book.encode(v)
    table, spans = book.tables(v[:20])
    near = sum(table[m][:, codes[:, m]] for m in range(table.shape[0]))
    room, true = spans @ left.T, v[:20] @ v.T
    assert (np.abs(near - true) <= room + 1e-6).all()
    labels = np.arange(4000) % 10
    batch = pa.record_batch({"label": labels, "dim": pa.array([64] * 4000, pa.int32()), "v": pa.array(list(v)), "ids": pa.array([[i] for i in range(4000)], pa.list_(pa.int64())), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "left": pa.array(list(left))})
    anchors = {64: (list(range(20)), list(range(20)), labels[:20], v[:20], [[]] * 20)}
    seen = []
    found = next(iter(H.scan(iter([batch]), anchors, {64: book}, False, (80, 100), seen))).to_pylist()
    assert len(found) == 100
    for i in range(20):
        best = sorted((-int(true[i, j]), j) for j in range(4000) if labels[j] == labels[i] and j != i)[:5]
        assert [(-r["score"], r["id"]) for r in sorted((r for r in found if r["key"] == i), key=lambda r: (-r["score"], r["id"]))] == best
    met, scored = map(sum, zip(*seen, strict=True))
    assert scored < met / 2
