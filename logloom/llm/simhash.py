"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a check of the Hamming distance or of the shared shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

SEED = 42
_PART = 1 << 16  # shingles whose bits are unpacked at once


def _fingerprint(text: str | None, shingle: int) -> int:
    words = text.encode().lower().split() if text else []  # on bytes: A-Z, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingles(words, shingle):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _shingles(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles (big-endian), in bounded parts."""
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    of, n = xxhash.xxh64_intdigest, len(words) - size + 1
    for at in range(0, n, _PART):
        spans = zip(ends[at : min(at + _PART, n)], ends[at + size :], strict=False)
        yield np.array([of(joined[s : e - 1], SEED) for s, e in spans], ">u8")


def fingerprint(text: str | Column, shingle: int = 5) -> Column:
    """64-bit SimHash (as a signed long) of a text's lower-cased word shingles, repeats included.

    Words are runs without ASCII white space. A text of fewer words than a shingle is one shingle;
    a null, empty or blank text gives 0. Works through whole texts in bounded parts.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(x.as_py(), shingle) for x in texts], pa.int64())

    return of(text)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks: fingerprints that differ in `distance` bits
    or fewer leave so many blocks untouched, hence agree under one mask at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Fingerprints of one block bucket that chance alone is let to bring together, on average.
BY_CHANCE = 4


def plan_blocks(n: int, distance: int) -> int:
    """Blocks for n fingerprints: the fewest whose keys leave BY_CHANCE unrelated fingerprints a bucket.

    More blocks mean longer keys and more of them: 3 keys for 2 bits up to some millions of fingerprints,
    6 up to some billions. The links found are the same for any number of blocks.
    """
    return next(b for b in range(distance + 1, 65) if n / 2 ** (64 * (b - distance) / b) <= BY_CHANCE or b == 64)


def links(prints: DataFrame, distance: int = 2, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect what pairs within `distance` bits connect, over distinct longs `fp`.

    Buckets of up to SMALL_BUCKET fingerprints: every close pair. Larger ones are cut into cells
    (common.large_bucket_cells) in which all pairs are checked but only a spanning forest is
    returned, so the edges stay linear in the bucket. No pair is lost.
    """
    blocks = blocks or plan_blocks(prints.count(), distance)
    masks = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(distance, blocks))])
    members = prints.select("fp", F.inline(masks))
    sizes = members.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    small = members.join(sizes.where(F.col("n") <= common.SMALL_BUCKET).select("block", "key"), ["block", "key"])
    a, b = small.select("block", "key", F.col("fp").alias("a")), small.select("block", "key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, ["block", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    cells = common.large_bucket_cells(members, sizes, ["block", "key"], "fp")

    def forest(cell: pd.DataFrame) -> pd.DataFrame:
        return _forest(np.unique(cell["fp"].to_numpy(np.int64)), distance)

    return pairs.unionByName(common.per_group(cells.select("block", "key", "i", "j", "fp"), ["block", "key", "i", "j"], forest, "a long, b long"))


def _forest(prints: np.ndarray, distance: int) -> pd.DataFrame:
    """Breadth-first spanning forest of the close pairs; memory is linear in the fingerprints."""
    bits, left, edges = prints.view(np.uint64), np.arange(len(prints)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= distance
            edges += [(prints[at], prints[x]) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2, blocks: int | None = None) -> DataFrame:
    """(id_col, fp long, fingerprint hex, component_id) for every row of docs.

    Texts with one fingerprint form a class, which enters the block join once however many copies it
    has. component_id is the smallest id reachable over links of `distance` bits or fewer, the row's
    own included; null ids take part but are never that id (null if a component has no other).
    Repeated rows give repeated rows; an empty table gives none; other columns are not looked at.
    """
    rows = common.checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    classes = common.checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = common.components(links(classes.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands of smallest hashes and hashes a band: two texts that share 0.8 of their shingles share a band with
#: probability 1 - (1 - 0.8 ** 5) ** 16 = 0.998, whatever their fingerprints; more similar ones with a higher one.
BANDS, BAND = 16, 5
#: Shingles of one side of a cell, besides common.CHUNK rows.
CELL_SHINGLES = 1 << 19
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, (BANDS * BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (BANDS * BAND, 1), np.uint64)
_SKETCH = "struct<same: binary, fp: long, n: long, bands: array<long>>"


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate(list(_shingles(words, shingle))).astype(np.uint64))


def _bands(own: np.ndarray) -> list[int]:
    if not len(own):
        return []
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[at : at + 4096] * _TIMES + _PLUS).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in least.reshape(BANDS, BAND)]


def _sketch(text: Column, shingle: int) -> Column:
    """same: a 128-bit hash of the shingle set; its size, the fingerprint and the bands."""

    @F.arrow_udf(_SKETCH)
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            own = shingle_set(x.as_py(), shingle)
            rows.append((xxhash.xxh3_128_digest(own.tobytes()), _fingerprint(x.as_py(), shingle), len(own), _bands(own)))
        same, prints, sizes, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [pa.array(same, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["same", "fp", "n", "bands"])

    return of(text)


def _set(text: Column, shingle: int) -> Column:
    @F.arrow_udf("struct<same: binary, shingles: binary>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(x.as_py(), shingle).tobytes() for x in texts]
        return pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["same", "shingles"])

    return of(text)


def _shared(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _confirmed(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets x and y share `least`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes = lambda x: np.frombuffer(x.as_py(), np.uint64)
        for batch in batches:
            near = [_shared(of_bytes(x), of_bytes(y)) >= least for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def _similar_forest(cell: pd.DataFrame, distance: int, least: float) -> pd.DataFrame:
    """Breadth-first spanning forest of the pairs of a cell that share `least` of their shingles; in a cell of fingerprints, of those within `distance` bits."""
    cell = cell.drop_duplicates("c")
    sets = [np.frombuffer(x, np.uint64) for x in cell["shingles"]]
    sizes, bits, nodes = np.array([len(x) for x in sets]), cell["fp"].to_numpy(np.int64).view(np.uint64), cell["c"].to_numpy(np.int64)
    hashed, left, edges = cell["block"].iloc[0] >= 0, np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            may = np.minimum(sizes[left], sizes[at]) >= least * np.maximum(sizes[left], sizes[at])
            if hashed:
                may &= np.bitwise_count(bits[left] ^ bits[at]) <= distance
            near = np.zeros(len(left), bool)
            near[may] = [_shared(sets[x], sets[at]) >= least for x in left[may]]
            edges += [(nodes[at], nodes[x]) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 6, least: float = 0.8) -> DataFrame:
    """(id_col, component_id) of every row, over links of texts that share `least` of their distinct shingles (Jaccard).

    Candidates are the fingerprints within `distance` bits and the texts that share a band of smallest
    hashes, which finds those whose fingerprints lie further apart. Each is confirmed by the exact overlap
    before it links: no chance of a fingerprint drops a row. Texts with one set of shingles form a class;
    buckets of more than SMALL_BUCKET classes go through cells, bounded in rows and shingles, that return
    a spanning forest of confirmed pairs. Nulls, repeats and empty tables as in near_duplicates.
    """
    rows = common.checkpointed(docs.select(F.col(id_col).alias("id"), _sketch(F.col(text_col), shingle).alias("s")).select("id", "s.*"))
    classes = rows.groupBy("same").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    classes = common.checkpointed(classes.withColumn("c", F.monotonically_increasing_id()))
    masks = block_masks(distance, plan_blocks(classes.count(), distance))
    keys = [F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    keys += [F.struct(F.lit(-1 - i).alias("block"), F.get("bands", F.lit(i)).alias("key")) for i in range(BANDS)]
    members = classes.where("n > 0").select("c", "fp", "n", F.inline(F.array(*keys)))
    sizes = members.groupBy("block", "key").agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).where("n > 1")
    sizes = common.checkpointed(sizes)
    small = members.join(sizes.where(F.col("n") <= common.SMALL_BUCKET).select("block", "key"), ["block", "key"])
    a, b = (small.select("block", "key", F.col("c").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    close = (F.col("block") < 0) | (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance)
    sized = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    pairs = common.checkpointed(a.join(b, ["block", "key"]).where((F.col("a") < F.col("b")) & close & sized).select("a", "b").distinct())
    large = sizes.where(F.col("n") > common.SMALL_BUCKET).withColumn("s", F.ceil(F.greatest(F.col("n") / common.CHUNK, F.col("shingles") / CELL_SHINGLES)).cast("int"))
    crowded = common.checkpointed(members.select("block", "key", "c", "fp").join(common.small(large.select("block", "key", "s")), ["block", "key"]))
    needed = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(crowded.select("c")).distinct()
    needed = common.checkpointed(classes.select("c", "same", "least").join(needed, "c"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = common.small(needed.select(F.col("least").alias("id")).where("id is not null").distinct())
    of_ids = texts.join(ids, "id", "left_semi").unionByName(texts.where("id is null"))
    sets = of_ids.select(_set(F.col("text"), shingle).alias("s")).select("s.*").dropDuplicates(["same"])
    sets = common.checkpointed(sets.join(needed.select("c", "same"), "same").select("c", "shingles"))
    met = pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    links = _confirmed(met, least)
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "c"), F.col("s")).cast("int")
    dealt = crowded.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("block", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "c", "fp").join(sets, "c")
    forest = lambda cell: _similar_forest(cell, distance, least)
    links = links.unionByName(common.per_group(dealt, ["block", "key", "i", "j"], forest, "a long, b long"))
    roots = common.components(links).withColumnRenamed("node", "c")
    rooted = classes.select("c", "same", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("same", "component_id")
    return rows.select("id", "same").join(named, "same").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, **how) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the row of the smallest id stays.

    Groups are those of similar() if `least` is given, else of near_duplicates(). Rows with a null id stay. Of rows that repeat that id, one stays (smallest by hash of the whole row).
    """
    groups = near_duplicates(docs, id_col, text_col, **how) if least is None else similar(docs, id_col, text_col, least=least, **how)
    own, row, n = common.free(docs, "own_id", "row_hash", "row_n")
    found = common.checkpointed(groups.select(F.col(id_col).alias(own), "component_id"))
    gone = common.small(found.where(F.col(own) != F.col("component_id")).select(own).distinct())
    kept = docs.join(gone, docs[id_col] == gone[own], "left_anti")
    again = common.small(found.where(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own))
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[id_col] == again[own], "left_anti")
    repeated = kept.join(again, kept[id_col] == again[own], "left_semi").withColumn(row, F.xxhash64(*kept.columns))
    first = Window.partitionBy(id_col).orderBy(row)
    return once.unionByName(repeated.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(row, n))
