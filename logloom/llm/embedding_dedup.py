"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import common

#: Width of a quantisation step; unit vectors at cosine 0.9 are 0.447 apart, unrelated ones about 1.414.
WIDTH = 2.0
#: Chance that the check of sign bits passes over a pair at the threshold; what hashing misses is far more.
MISSED = 1e-9
_BLOCK = 512


def same_bucket(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection puts two vectors so far apart in one bucket."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """Projections a table (unrelated pairs meet about n times a table) and tables (recall at the threshold itself)."""
    k = max(6, math.ceil(math.log(max(n, 2)) / -math.log(same_bucket(math.sqrt(2), width))))
    p = same_bucket(math.sqrt(2 - 2 * cosine), width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def most_signs(cosine: float, missed: float = MISSED) -> int:
    """Of 64 random planes, so many lie between two vectors of that cosine but with a chance of `missed` at most."""
    p = math.acos(cosine) / math.pi
    above = 1.0
    for k in range(65):
        above -= math.comb(64, k) * p**k * (1 - p) ** (64 - k)
        if above <= missed:
            return k
    return 64


def _sketches(vectors: list, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    codes, signs = np.zeros((len(vectors), tables), np.int64), np.zeros(len(vectors), np.int64)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v), []).append(i)
    for size, own in by_size.items():
        rng = np.random.default_rng([seed, size])
        a, b = rng.standard_normal((size, k * tables)), rng.uniform(0, WIDTH, k * tables)
        mix, base = rng.integers(1, 2**62, k) * 2 + 1, rng.integers(0, 2**62)
        planes = rng.standard_normal((size, 64))
        for at in range(0, len(own), _BLOCK):
            part = own[at : at + _BLOCK]
            v = _unit(np.array([vectors[i] for i in part], float))
            q = np.floor((v @ a + b) / WIDTH).astype(np.int64).reshape(len(part), tables, k)
            codes[part] = (q * mix).sum(axis=2) + base
            signs[part] = np.packbits(v @ planes > 0, axis=1).view(">i8")[:, 0]
    return codes, signs


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.98, seed: int = 17) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: cosine >= `cosine` links, in double precision.

    Equal vectors, compared whole, form a class that is hashed once and counts with its rows. Buckets of up to
    common.SMALL_BUCKET classes pair by a join of class ids and sign bits (most_signs), and the few pairs left fetch their
    vectors; larger ones are compared in cells of two bounded chunks, which return link counts and a
    spanning forest, never all pairs. A pair that meets in large buckets counts in the first of its
    tables only, and then not among the small ones.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do
    rows with a null id (component_id and kept are then null); vectors of unequal lengths never link. Repeated rows give
    repeated rows, each a link of the other; an empty table gives none; other columns are not looked at.
    """
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    given = given.select("id", "v", F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull() & F.forall(F.coalesce("v", F.array()), lambda x: ~F.isnan(F.coalesce(x, F.lit(0.0)))))
    # two hashes deal out and order the vectors; the vector itself decides which are equal
    same = ["h1", "h2", "v"]
    given = given.toDF("id", "v", "fine").withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))
    classes = given.where("fine").groupBy(*same).agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = common.checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    k, tables = plan(classes.count(), cosine, recall)

    @F.arrow_udf("struct<codes: array<long>, signs: long>")
    def sketch(vs: pa.Array) -> pa.Array:
        codes, signs = _sketches(vs.to_pylist(), k, tables, seed)
        return pa.StructArray.from_arrays([pa.array(list(codes), pa.list_(pa.int64())), pa.array(signs)], ["codes", "signs"])

    sketched = common.checkpointed(classes.withColumn("sketch", sketch("v")).select("node", *same, "copies", "least", "sketch.codes", "sketch.signs"))
    members = sketched.select("node", "signs", F.posexplode("codes").alias("t", "code"))
    sizes = members.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1")
    large = members.join(sizes.where(F.col("n") > common.SMALL_BUCKET), ["t", "code"])
    in_large = large.groupBy("node").agg(F.collect_set("t").alias("big"))
    sketched = sketched.join(in_large, "node", "left").withColumn("big", F.coalesce("big", F.array().cast("array<int>")))

    small = members.join(sizes.where(F.col("n") <= common.SMALL_BUCKET), ["t", "code"])
    a = small.select("t", "code", F.col("node").alias("a"), F.col("signs").alias("sa"))
    b = small.select("t", "code", F.col("node").alias("b"), F.col("signs").alias("sb"))
    near = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= most_signs(cosine)
    pairs = a.join(b, ["t", "code"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    side = lambda s: sketched.select(*[F.col(c).alias(s + c) for c in ("node", "v", "codes", "big", "copies")])
    met = pairs.join(side("a_"), F.col("a") == F.col("a_node")).join(side("b_"), F.col("b") == F.col("b_node"))
    apart = ~F.exists("a_big", lambda t: F.get("a_codes", t) == F.get("b_codes", t))
    linked = met.where((F.size("a_v") == F.size("b_v")) & apart & (_cosine(F.col("a_v"), F.col("b_v")) >= cosine))
    both = F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b_copies").alias("links"), F.least("a", "b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a_copies").alias("links"), F.least("a", "b").alias("to"))))
    found = linked.select(both)

    cells = common.large_bucket_cells(members, sizes, ["t", "code"], "node").select("t", "code", "i", "j", "chunk", "node")
    dealt = cells.join(sketched.select("node", "v", "codes", "big", "copies"), "node")
    compared = common.per_group(dealt, ["t", "code", "i", "j"], lambda cell: _compare(cell, cosine), "node long, links long, to long")
    found = common.checkpointed(found.unionByName(compared))

    roots = common.components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = sketched.select("node", *same, "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select(*same, F.lit(True).alias("fine"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    out = given.join(named, [*same, "fine"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosines of vectors of equal lengths, a batch at once; -2 for others."""
    n, m = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b))
    out = np.full(len(n), -2.0)
    for size in np.unique(n[(n == m) & (n > 0)]):
        own = np.flatnonzero((n == size) & (m == size))
        x, y = (_unit(v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)) for v in (a, b))
        out[own] = np.einsum("ij,ij->i", x, y)
    return pa.array(out)


def _compare(cell: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one cell: chunk i against chunk j, or a chunk against itself. Memory is a block of rows times a chunk."""
    out, t = [], int(cell["t"].iloc[0])
    for _, same in cell.groupby(cell["v"].map(len)):
        low, high = same["chunk"].min(), same["chunk"].max()
        if low == high and cell["i"].iloc[0] != cell["j"].iloc[0]:
            continue  # only one of the cell's chunks has such vectors: that chunk's own cell compares them
        left, right = same[same["chunk"] == low], same[same["chunk"] == high]
        lv, rv = _unit(np.stack(left["v"].to_numpy())), _unit(np.stack(right["v"].to_numpy()))
        lc, rc = np.stack(left["codes"].to_numpy()), np.stack(right["codes"].to_numpy())
        ln, rn = left["node"].to_numpy(), right["node"].to_numpy()
        lk, rk = left["copies"].to_numpy(), right["copies"].to_numpy()
        bigs = [[x for x in big if x < t] for big in left["big"]]
        to_left, to_right = np.zeros(len(ln), np.int64), np.zeros(len(rn), np.int64)
        root_of = {}
        for i in range(len(ln)):
            close = lv[i] @ rv.T >= cosine
            if low == high:
                close[: i + 1] = False
            for x in bigs[i]:
                close &= rc[:, x] != lc[i, x]
            if not close.any():
                continue
            to_left[i] += rk[close].sum()
            to_right[close] += lk[i]
            _join(root_of, [int(ln[i]), *rn[close].tolist()])
        out.append(pd.DataFrame({"node": np.concatenate([ln, rn]), "links": np.concatenate([to_left, to_right])}))
    if not out:
        return pd.DataFrame({"node": [], "links": [], "to": []}, dtype=np.int64)
    sums = pd.concat(out).groupby("node", as_index=False)["links"].sum()
    sums = sums[sums["links"] > 0]
    return sums.assign(to=[_root(root_of, n) for n in sums["node"].tolist()]).astype(np.int64)


def _root(of: dict[int, int], x: int) -> int:
    while of.get(x, x) != x:
        of[x] = of.get(of[x], of[x])
        x = of[x]
    return x


def _join(of: dict[int, int], nodes: list[int]) -> None:
    least = min(roots := {_root(of, n) for n in nodes})
    of.update(dict.fromkeys([*roots, *nodes], least))
