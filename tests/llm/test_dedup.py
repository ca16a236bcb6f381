"""SimHash, line and embedding dedup against brute force, with nulls, ties, repeats and clashing columns."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import common, embedding_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, n_lines string, fp string"


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def texts():
    random.seed(4)
    words = ["w%d" % i for i in range(40)]
    base = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(30)]
    rows = [*base, *base[:8], None, "", " \t\n", "One  Two\tthree", "one two three", "a", "É b c d", "x " * 20_000]
    for b in base[:12]:
        parts = b.split()
        parts[len(parts) // 2] = "changed"
        rows.append(" ".join(parts))
    return rows


@pytest.mark.parametrize("small", [32, 1])
def test_simhash(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_BUCKET", small)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, distance=2).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_links_at_any_distance(spark):
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:40]:
        prints.add(p ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 8))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 6)).collect()}
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 6)
    assert {p: roots.get(p, p) for p in signed} == want


def test_keep_one(spark):
    rows = [(3, "a b c", "x", "y"), (1, "a b c", "x", "y"), (1, "a b c", "x", "y"), (None, "a b c", "x", "y"), (7, "entirely other words here", "x", "y"), (8, None, "x", "y"), (9, "", "x", "y")]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 7, 8]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("small", [32, 1])
def test_pipeline_keeps_one_of_similar_texts(spark, monkeypatch, small):
    """Pairs about 0.8 alike, whose fingerprints mostly differ in more than 6 bits, and pairs below it."""
    import corpus_pipeline

    monkeypatch.setattr(common, "SMALL_BUCKET", small)
    random.seed(6)
    word = lambda: "w%d" % random.randrange(5000)
    texts = [None, "", "a b", "a b"]
    for i in range(90):
        words = [word() for _ in range(random.randint(40, 120))]
        texts.append(" ".join(words))
        for _ in range(i % 4):
            words[random.randrange(10, 30)] = word()
        texts.append(" ".join(words))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4))}
    sets = [cut(t) for t in texts]
    want = brute_components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = corpus_pipeline.keep_one(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert 100 < len(kept) < 180


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0}
    assert {got[i] for i in range(1000, 1100)} == {1000}


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    long, unicode = "This line is long enough to be looked at.", "Ünïcode line that is long enough, ÄÖ keep case"
    rows = [(i, f"{long}\nown {i}\n  {long.upper()} \n{unicode}\nshort", "x", "y") for i in range(6)]
    rows += [(10, None, "x", "y"), (11, "", "x", "y"), (12, "\n\n", "x", "y"), (13, long, "x", "y"), (13, long, "x", "y"), (None, f"{long}\nkept", "x", "y"), (14, "z " * 50_000 + "\n" + long, "x", "y")]
    done = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS))
    assert done.columns == ["doc_id", "text", "fp", "n_lines", "n_dropped"]
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in done.collect()], key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_without_broadcast_and_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(i, f"This line is long enough to be looked at, {i % 3}.\nown", "kept", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole_text string, salt int").withColumns({"lost": F.lit("l"), "own_id": F.lit("o"), "N_Dropped": F.lit("n")})
    done = line_dedup.drop_repeated_lines(df)
    assert done.columns == ["doc_id", "text", "whole_text", "salt", "lost", "own_id", "n_lines", "n_dropped"]
    got = done.collect()
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got], key=str) == brute_lines(rows)
    assert all((r["whole_text"], r["lost"], r["own_id"]) == ("kept", "l", "o") for r in got)


def test_line_dedup_is_linear_in_the_lines(spark):
    """A document of 200,000 lines that loses half of them; rebuilding line by line would take hours."""
    import time

    line = lambda i: f"a repeated line of forty characters, no. {i}"
    long = "\n".join(line(i % 100) if i % 2 else f"own {i}" for i in range(200_000))
    rows = [(0, long)] + [(i, "\n".join(map(line, range(100)))) for i in range(1, 6)]
    start = time.time()
    done = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert (done[0]["n_lines"], done[0]["n_dropped"]) == (200_000, 100_000)
    assert done[0]["text"] == "\n".join(f"own {i}" for i in range(0, 200_000, 2))


@pytest.mark.parametrize(("small", "chunk"), [(32, 4096), (3, 4)])
def test_embeddings(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(common, "SMALL_BUCKET", small)
    monkeypatch.setattr(common, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vectors = [(centres[i % 12] + rng.standard_normal(16) * 0.12).tolist() for i in range(90)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.1]]
    rows = list(enumerate(vectors + odd))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()}
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    linked = lambda a, b: bool(fine(rows[a][1]) and fine(rows[b][1]) and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.9)
    want = brute_components(range(len(rows)), linked)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_embedding_recall_at_the_threshold():
    for cosine in (0.5, 0.9, 0.99):
        p, most = math.acos(cosine) / math.pi, embedding_dedup.most_signs(cosine)
        assert sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(most + 1, 65)) <= 1e-9
    k, tables = embedding_dedup.plan(50_000, 0.9, 0.98)
    p = embedding_dedup.same_bucket(np.sqrt(0.2)) ** k
    assert 1 - (1 - p) ** tables >= 0.98


def test_embedding_recall_by_measurement(spark):
    """Production parameters, 1,000 pairs planted at cosines of 0.90 to 0.92 among unrelated vectors."""
    rng = np.random.default_rng(21)
    a = rng.standard_normal((1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.92, (1000, 1))
    b = cos * a + np.sqrt(1 - cos**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b, rng.standard_normal((500, 64))]))] + [(None, a[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "node": F.lit(1)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, None)
    found = sum(got[1000 + i]["component_id"] == i for i in range(1000))
    assert found >= 960
    assert sum(r["n_links"] for r in got.values()) == 2 * found
    assert all(got[i]["n_links"] == 0 for i in range(2000, 2500))


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d", "x", "y"), (None, "a b c d", "x", "y"), (4, "a b c d", "x", "y"), (4, "a b c d", "x", "y"), (None, "q r s t u", "x", "y")]
    got = sorted([(r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), distance=2).collect()], key=str)
    assert got == sorted([(0, 4), (0, 4), (4, 4), (4, 4), (0, None)], key=str)


def test_held_out(spark):
    import zlib

    ids = spark.range(50).select("id", common.is_held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in ids)
    assert spark.createDataFrame([(None,)], "id long").select(common.is_held_out("id").alias("h")).first()["h"]


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
