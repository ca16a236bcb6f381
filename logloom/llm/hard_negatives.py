"""Hard negatives of anchors: product quantisation with residual norms bounds every score, exact scores decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

#: Components a sub-space holds, and centroids of each.
PART, CENTROIDS = 2, 256
#: Rows that the centroids of one vector length are fitted on at most: those of the smallest hash. The bounds are exact
#: whatever the centroids are, so the sample decides speed alone.
SAMPLE, ROUNDS = 8192, 6
#: Bytes of anchor vectors that one pass over the rows holds in every task.
PASS_BYTES = 16 << 20
#: Anchors and rows whose scores stand in memory at once.
ANCHORS, ROWS = 64, 8192
#: Ids of equal rows that can matter: five partners and the anchor itself.
FIVE = 5
#: Room for rounding of float sums, as a share of the product of the norms.
SLACK = 1e-9
#: Integers up to here are exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


@dataclass
class Codebook:
    """Centroids of whole numbers, one set a sub-space: (parts, CENTROIDS, width) with the last part padded by zeros."""

    dim: int
    centroids: np.ndarray

    def split(self, v: np.ndarray) -> np.ndarray:
        parts, _, width = self.centroids.shape
        out = np.zeros((len(v), parts * width))
        out[:, : self.dim] = v
        return out.reshape(len(v), parts, width)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and the norm of what each code leaves over."""
        own, n = self.split(v), len(v)
        codes, left = np.zeros((n, own.shape[1]), np.uint8), np.zeros((n, own.shape[1]))
        for m, c in enumerate(self.centroids):
            codes[:, m] = _nearest(own[:, m], c)
            left[:, m] = np.sqrt(((own[:, m] - c[codes[:, m]]) ** 2).sum(axis=1))
        return codes, left

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every centroid with the anchors (parts, anchors, CENTROIDS), and the norms of the anchors' parts."""
        own = self.split(anchors)
        return np.einsum("amw,mcw->mac", own, self.centroids), np.sqrt((own**2).sum(axis=2))


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.uint8)
    for at in range(0, len(v), 4096):
        x = v[at : at + 4096]
        out[at : at + 4096] = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
    return out


def fit(sample: np.ndarray, seed: int = 5) -> Codebook:
    """k-means in each sub-space, from spread-out rows of the sample; fewer distinct rows give fewer centroids."""
    n, dim = sample.shape
    book = Codebook(dim, np.zeros((max(1, -(-dim // PART)), CENTROIDS, PART)))
    rng = np.random.default_rng(seed)
    for m, own in enumerate(book.split(sample).transpose(1, 0, 2)):
        c = own[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)]
        for _ in range(ROUNDS):
            at = _nearest(own, c)
            size = np.bincount(at, minlength=CENTROIDS)
            sums = np.stack([np.bincount(at, own[:, j], CENTROIDS) for j in range(PART)], axis=1)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        book.centroids[m] = np.rint(c)
    return book


def exact_scores(a: np.ndarray, rows: np.ndarray) -> list[int] | np.ndarray:
    """Whole inner products of whole-numbered doubles; by Python's integers where doubles could round."""
    if len(rows) and np.abs(a).max(initial=0) * np.abs(rows).max(initial=0) * max(1, len(a)) < EXACT:
        return (rows @ a).astype(np.int64)
    whole = [int(x) for x in a]
    return [sum(x * int(y) for x, y in zip(whole, r, strict=True)) for r in rows]


class Best:
    """The first five (score, id) of each key, higher scores first, then smaller ids. Ids that come twice count once."""

    def __init__(self) -> None:
        self.of: dict[tuple, list[tuple[int, int]]] = {}

    def least(self, key: tuple) -> float:
        """A score below this cannot get in any more."""
        own = self.of.get(key)
        return -own[-1][0] if own is not None and len(own) == FIVE else -math.inf

    def add(self, key: tuple, found: list[tuple[int, int]]) -> None:
        self.of[key] = sorted({*self.of.get(key, ()), *((-s, i) for s, i in found)})[:FIVE]


def _floats(col: pa.ListArray, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def scan(batches: Iterator[pa.RecordBatch], anchors: dict[int, tuple], books: dict[int, Codebook], windows: bool, ratio: tuple[int, int], seen: list | None = None) -> Iterator[pa.RecordBatch]:
    """One pass of encoded rows against a bounded set of anchors; gives each anchor's (or window's) best rows here.

    anchors: by dimension (keys, ids, labels, vectors, positive scores of each). Without windows the best rows of the
    anchor's label are kept; with windows, for each positive score p those of other labels whose score s fulfils
    ratio[0] * p <= ratio[1] * s <= ratio[1] * p. A row is scored exactly only if the bounds leave it a chance; `seen` gets
    counts of rows met and scored.
    """
    best, low, full = Best(), *ratio
    for batch in batches:
        dims = batch["dim"].to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            if int(dim) not in anchors:
                continue
            own = batch.filter(pa.array(dims == dim))
            for at in range(0, own.num_rows, ROWS):
                _meet(own.slice(at, ROWS), int(dim), anchors[int(dim)], books[int(dim)], best, windows, low, full, seen)
    rows = [(*key, -s, i) for key, found in best.of.items() for s, i in found]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    clip = lambda xs: pa.array([max(-LONG, min(LONG, x)) for x in xs], pa.int64())
    yield pa.record_batch({"key": pa.array(cols[0], pa.int64()), "p": clip(cols[1]), "score": clip(cols[2]), "id": pa.array(cols[3], pa.int64())})


def _meet(rows: pa.RecordBatch, dim: int, anchors: tuple, book: Codebook, best: Best, windows: bool, low: int, full: int, seen: list | None) -> None:
    keys, ids, labels, vectors, positives = anchors
    n = rows.num_rows
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(n, -1)
    left, v = _floats(rows["left"], n), _floats(rows["v"], n) if dim else np.zeros((n, 0))
    own_labels, own_ids = rows["label"].to_numpy(zero_copy_only=False), rows["ids"]
    single = np.array([x[0] if len(x) == 1 else None for x in own_ids.to_pylist()])
    norms = np.sqrt((v**2).sum(axis=1))
    for at in range(0, len(keys), ANCHORS):
        part = slice(at, at + ANCHORS)
        table, spans = book.tables(vectors[part])
        near = np.zeros((len(spans), n))
        for m in range(table.shape[0]):
            near += np.take(table[m], codes[:, m], axis=1)
        room = spans @ left.T
        room += SLACK * np.sqrt((spans**2).sum(axis=1))[:, None] * (norms + left.sum(axis=1))[None, :] + 1e-3
        for j in range(len(spans)):
            i = at + j
            same, other = own_labels == labels[i], single != ids[i]
            upper, lower = near[j] + room[j], near[j] - room[j]
            if not windows:
                _exact(np.flatnonzero(same & other), upper, lower, [(keys[i], 0, None)], i, anchors, v, own_ids, best, low, full, seen)
            else:
                _exact(np.flatnonzero(~same & other), upper, lower, [(keys[i], p, p) for p in positives[i]], i, anchors, v, own_ids, best, low, full, seen)


def _exact(at: np.ndarray, upper: np.ndarray, lower: np.ndarray, asked: list[tuple], i: int, anchors: tuple, v: np.ndarray, own_ids: pa.ListArray, best: Best, low: int, full: int, seen: list | None) -> None:
    """Scores the rows `at` that bounds do not rule out for one anchor and adds them to each set that was asked for."""
    _, ids, _, vectors, _ = anchors
    upper, lower = upper[at], lower[at]
    scored: dict[int, int] = {}
    met = []
    for key, p, top in asked:
        chance, sure = np.ones(len(at), bool), np.ones(len(at), bool)
        if top is not None:
            least = -(-low * top // full)
            chance = (upper >= least) & (lower <= top)
            sure = (lower >= least) & (upper <= top)
        bar = best.least((key, p))
        if sure.sum() >= FIVE:
            bar = max(bar, np.partition(lower[sure], -FIVE)[-FIVE])
        met.append((key, p, top, at[chance & (upper >= bar)]))
    wanted = np.unique(np.concatenate([x[3] for x in met])) if met else []
    if len(wanted):
        scored = dict(zip(wanted.tolist(), map(int, exact_scores(vectors[i], v[wanted])), strict=True))
    if seen is not None:
        seen.append((len(at), len(wanted)))
    for key, p, top, candidates in met:
        found, bar = [], best.least((key, p))
        for r in candidates.tolist():
            s = scored[r]
            if s >= bar and (top is None or low * top <= full * s <= full * top):
                found.append((s, r))
        found.sort(key=lambda x: -x[0])
        if len(found) > FIVE:
            found = [x for x in found if x[0] >= found[FIVE - 1][0]]
        best.add((key, p), [(s, x) for s, r in found for x in own_ids[r].as_py() if x != ids[i]])


def _passes(anchors: DataFrame, count: int, dim_bytes: int) -> Iterator[dict[int, tuple]]:
    """The anchors, so many at a time that their vectors stay below PASS_BYTES; one part is on the driver at a time."""
    most = max(1, PASS_BYTES // max(1, dim_bytes))
    dealt = common.checkpointed(anchors.repartition(max(1, math.ceil(count / most))))
    held: list = []
    for r in dealt.toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield _by_dimension(held)
            held = []
    if held:
        yield _by_dimension(held)


def _by_dimension(held: list) -> dict[int, tuple]:
    out: dict[int, list] = {}
    for r in held:
        out.setdefault(r["dim"], []).append(r)
    return {
        dim: ([r["key"] for r in own], [r["anchor"] for r in own], np.array([r["label"] for r in own]), np.array([r["v"] for r in own], float).reshape(len(own), dim), [sorted(r["positives"]) for r in own])
        for dim, own in out.items()
    }


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's first five rows of its
    own label, the first five rows of other labels with ratio[0] * positive <= ratio[1] * score <= ratio[1] * positive.

    A score is the inner product of floor(scale * component); higher comes first, ties by the smaller id. Vectors are
    cut into sub-spaces, each row keeps the nearest centroid and the norm of the rest of every sub-space: a sum of table entries
    plus or minus the products of norms bounds each score (Cauchy-Schwarz), and only rows that the bounds leave a chance
    are scored exactly. Rows stay where they are: anchors visit them in passes of PASS_BYTES, every task keeps five rows
    an anchor (or window), and five are left of those. Equal rows are stored once with their six smallest ids, which is all
    that five partners can need.

    Rows with a null id, label or vector, or a null or non-finite component take no part; only vectors of
    equal length meet, empty ones score zero. A row that is repeated whole counts once; different rows of one id
    are rows of their own, but an anchor's id is neither its positive nor its negative. A score beyond the range of a long is
    taken as its end. An empty table, or one without anchors, gives no rows. Other columns are not looked at.
    """
    v = F.col(vector_col).cast("array<double>")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), is_anchor.alias("is_anchor"))
    whole = F.transform("v", lambda x: _floor(x * float(scale)))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf")))
    given = given.where(fine).select("id", "label", whole.alias("v"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))

    # equal rows meet by hash; a rank below seven drops what cannot matter before the shuffle
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")]
    hashed = given.select("id", "label", "v", *same)
    place = F.dense_rank().over(Window.partitionBy("label", "h1", "h2").orderBy("id"))
    few = hashed.withColumn("place", place).where(F.col("place") <= FIVE + 1)
    classes = few.groupBy("label", "h1", "h2", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("label", F.size("v").alias("dim"), "v", "ids")
    classes = common.checkpointed(classes)
    books = {r["dim"]: _book(classes.where(F.col("dim") == r["dim"])) for r in classes.select("dim").distinct().toLocalIterator()}
    anchors = common.checkpointed(given.where("is_anchor").select("id", "label", "v").distinct().select(F.monotonically_increasing_id().alias("key"), F.col("id").alias("anchor"), "label", F.size("v").alias("dim"), "v"))
    count, longest = anchors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not books or not count:
        return rows.sparkSession.createDataFrame([], schema)
    encoded = common.checkpointed(classes.mapInArrow(lambda batches: _encode(batches, books), "label long, dim int, v array<double>, ids array<long>, codes binary, left array<double>"))

    def met(asking: DataFrame, windows: bool) -> DataFrame:
        out = None
        for part in _passes(asking, count, 8 * longest + 200):
            shared = rows.sparkSession.sparkContext.broadcast((part, {d: books[d] for d in part if d in books}))
            own = encoded.mapInArrow(lambda batches, shared=shared: scan(batches, *shared.value, windows, ratio), "key long, p long, score long, id long")
            own = common.checkpointed(_first(own))
            out = own if out is None else out.unionByName(own)
            shared.unpersist()
        return out

    positives = met(anchors.withColumn("positives", F.array().cast("array<long>")), False).select("key", F.col("score").alias("p"), F.col("id").alias("positive"))
    asking = anchors.join(positives.groupBy("key").agg(F.collect_set("p").alias("positives")), "key")
    if not positives.take(1):
        return rows.sparkSession.createDataFrame([], schema)
    negatives = met(asking, True)
    found = positives.join(negatives, ["key", "p"]).join(anchors.select("key", "anchor"), "key")
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def _floor(x: Column) -> Column:
    """floor as a double: beyond 2^53 a double is whole, and does not fit the long that Spark's floor gives."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _first(found: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "p").orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= FIVE)


def _book(own: DataFrame) -> Codebook:
    chosen = own.select("v").orderBy(F.xxhash64(F.lit("sample"), "v")).limit(SAMPLE).toArrow()["v"].combine_chunks()
    return fit(_floats(chosen, len(chosen)))


def _encode(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch["dim"].to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            codes, left = books[int(dim)].encode(_floats(own["v"], own.num_rows))
            yield pa.record_batch({"label": own["label"], "dim": own["dim"], "v": own["v"], "ids": own["ids"], "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "left": pa.array(list(left), pa.list_(pa.float64()))})
