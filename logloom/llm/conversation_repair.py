"""Conversation structure repair: the cheapest edits that give a turn order, by a rank-compressed dynamic program.

A conversation is a string of rows that may be kept, given a new role or deleted, with empty rows put in anywhere. One *macro
edit* a row, the insert run before it and then its own edit, is written I...IX with X one of D, K, R: no such code begins
another, so two edit strings over the same rows differ first at one code, and codes compare as strings do. A layer of
the program therefore needs no strings: each state holds its cost, the rank of its best string among the layer's, and a
parent pointer. Rows are cut into pieces; a piece is solved for every pair of states, and its sixteen strings get ranks in turn,
so a conversation of any length is a program over its pieces, and no task holds a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

WHITE = " \t\n\x0b\x0c\r"
#: Rows of a piece.
PIECE = 64
#: States: nothing yet, after a system row, after a user row, after an assistant row; the first and the last may end.
STATES = "ESUA"
AFTER_INSERT = (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
ROLE = {2: "user", 3: "assistant"}
#: Roles that must follow for a conversation in a state to end.
ENDING = {0: (), 1: ("user", "assistant"), 2: ("assistant",), 3: ()}
#: Inserts in a row that can be of use: more come back to a state that was there before.
RUN = 3
CODES = sorted("I" * n + x for n in range(RUN + 1) for x in "DKR")
INITIALS = ("s", "u", "a")
NEVER = 1 << 40
#: A key holds cost, rank and code: ranks are below 16, codes and ranks of pieces below WIDE.
WIDE = 64


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _inserts(state: int, n: int) -> tuple[int, tuple[str, ...]]:
    roles = []
    for _ in range(n):
        state = AFTER_INSERT[state]
        roles.append(ROLE[state])
    return state, tuple(roles)


def _edges() -> list[tuple[int, int, str, int]]:
    out = []
    for p in range(4):
        for n in range(RUN + 1):
            mid, _ = _inserts(p, n)
            out += [(p, n, "D", mid), (p, n, "R", AFTER_INSERT[mid]), *[(p, n, "K", q) for q in sorted({q for (_, m), q in KEPT.items() if m == mid})]]
    return out


#: Every macro edit: (state before, inserts, own edit, state after). Its place here, as a letter from FIRST on, is its name.
EDGES, FIRST = _edges(), 0x30


def tables(costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, code and edge of the best macro edit between two states, by symbol: 2 * initial + truncated, or 8 for rows
    that must go."""
    cost, code, edge = np.full((9, 4, 4), NEVER, np.int64), np.zeros((9, 4, 4), np.int64), np.zeros((9, 4, 4), np.int64)
    for symbol in range(9):
        initial, late = (INITIALS + ("",))[symbol // 2 % 4], costs.truncated * (symbol % 2)
        for p in range(4):
            for n in range(RUN + 1):
                mid, _ = _inserts(p, n)
                own = [("D", mid, costs.delete)]
                if symbol < 8:
                    own.append(("R", AFTER_INSERT[mid], costs.rerole + late))
                    if (initial, mid) in KEPT:
                        own.append(("K", KEPT[initial, mid], late))
                for x, q, paid in own:
                    this = (n * costs.insert + paid, CODES.index("I" * n + x))
                    if this < (cost[symbol, p, q], code[symbol, p, q]):
                        cost[symbol, p, q], code[symbol, p, q] = this
                        edge[symbol, p, q] = EDGES.index((p, n, x, q))
    return cost, code, edge


def walk(starts: int, lengths: np.ndarray, layer: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Costs and ranks (rows, starts, states) after the last layer, and the parents by layer, of rows that are sorted by
    falling length. layer(t, n) gives costs and codes (n, before, after) of layer t for the n rows that have one."""
    rows = len(lengths)
    cost, rank = np.full((rows, starts, 4), NEVER, np.int64), np.zeros((rows, starts, 4), np.int64)
    cost[:, np.arange(starts), np.arange(starts)] = 0
    parents = []
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        paid, code = layer(t, n)
        total = np.minimum(cost[:n, :, :, None] + paid[:, None], NEVER)
        key = (total * 16 + rank[:n, :, :, None]) * WIDE + code[:, None]
        parents.append(key.argmin(axis=2).astype(np.int8))
        best = key.min(axis=2)
        cost[:n] = best // (16 * WIDE)
        text = np.where(cost[:n] < NEVER, best % (16 * WIDE), 16 * WIDE).reshape(n, -1)
        order = text.argsort(axis=1, kind="stable")
        sorted_ = np.take_along_axis(text, order, axis=1)
        dense = np.concatenate([np.zeros((n, 1), np.int64), (np.diff(sorted_, axis=1) > 0).cumsum(axis=1)], axis=1)
        ranked = np.empty_like(dense)
        np.put_along_axis(ranked, order, dense, axis=1)
        rank[:n] = ranked.reshape(n, starts, 4)
    return cost, rank, parents


def _same(col: pa.Array) -> np.ndarray:
    """True where a value equals the one before; nulls are equal."""
    codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[False], codes[1:] == codes[:-1]]) if len(codes) else np.zeros(0, bool)


def _strings(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    offsets = (np.arange(n + 1, dtype=np.int32) * width).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(codes, np.uint8).tobytes()))


def _solve(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with its place, its piece and its edit for every pair of states; the last row of a piece has its
    matrix: costs, ranks, first and last initial and the illegal pairs inside."""
    paid, code, edge = tables(costs)
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    place = TaskContext.get().partitionId() << 33
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        start = ~_same(batch["conv"])
        run = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
        first = np.flatnonzero(run % PIECE == 0)
        size = np.diff([*first, n])
        initial = pc.fill_null(pc.index_in(batch["initial"], value_set=pa.array(INITIALS)), 3).to_numpy(zero_copy_only=False)
        symbol = np.where(batch["dead"].to_numpy(zero_copy_only=False), 8, initial * 2 + batch["truncated"].to_numpy(zero_copy_only=False))
        by_size = np.argsort(-size, kind="stable")
        at, lengths = first[by_size], size[by_size]
        cost, rank, parents = walk(4, lengths, lambda t, m, at=at, symbol=symbol: (paid[symbol[at[:m] + t]], code[symbol[at[:m] + t]]))
        letters = np.zeros((n, 16), np.uint8)
        now = np.broadcast_to(np.arange(4), (len(at), 4, 4)).copy()
        for t in reversed(range(len(parents))):
            m = len(parents[t])
            before = np.take_along_axis(parents[t].astype(np.int64), now[:m], axis=2)
            letters[at[:m] + t] = FIRST + edge[symbol[at[:m] + t][:, None, None], before, now[:m]].reshape(m, 16)
            now[:m] = before
        last = first + size - 1
        ok = np.zeros(n, np.int64)
        ok[1:] = ~legal[initial[:-1], initial[1:]]
        ok[first] = 0
        bad = np.add.reduceat(ok, first)
        matrix: list = [None] * n
        order = np.argsort(by_size)
        for i, (end, c, r) in enumerate(zip(last.tolist(), cost[order], rank[order], strict=True)):
            matrix[end] = c.tobytes() + r.tobytes() + np.array([initial[first[i]], initial[end], bad[i]], np.int64).tobytes()
        yield pa.record_batch(
            {
                **{k: batch[k] for k in ("conv", "turn", "role", "h")},
                "place": pa.array(place + np.arange(n)),
                "piece": pa.array(np.repeat(place + first, size)),
                "letters": _strings(letters),
                "matrix": pa.array(matrix, pa.binary()),
            }
        )
        place += n


def _choose(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Pieces by conversation and place: the pair of states that each is entered and left in; a conversation's last piece has
    its cost, its illegal pairs and the state it ends in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1]["conv"][-1].as_py() != batch["conv"][0].as_py():
            yield _chosen(held, costs)
            held = []
        starts = np.flatnonzero(~_same(batch["conv"]))
        cut = int(starts[-1])
        if cut:
            yield _chosen([*held, batch.slice(0, cut)], costs)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _chosen(held, costs)


def _chosen(held: list[pa.RecordBatch], costs: Costs) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    conv, n = whole["conv"].combine_chunks(), whole.num_rows
    first = np.flatnonzero(~_same(conv))
    size = np.diff([*first, n])
    matrix = np.frombuffer(b"".join(whole["matrix"].to_pylist()), np.int64).reshape(n, 35)
    paid, code = matrix[:, :16].reshape(n, 4, 4), matrix[:, 16:32].reshape(n, 4, 4)
    by_size = np.argsort(-size, kind="stable")
    at, lengths = first[by_size], size[by_size]
    cost, rank, parents = walk(1, lengths, lambda t, m: (paid[at[:m] + t], code[at[:m] + t]))
    ends = np.array([len(ENDING[q]) for q in range(4)])
    total = np.minimum(cost[:, 0] + ends * costs.insert, NEVER)
    state = ((total * 16 + rank[:, 0]) * WIDE + ends).argmin(axis=1)
    pair, now = np.zeros(n, np.int32), state.copy()
    for t in reversed(range(len(parents))):
        m = len(parents[t])
        before = parents[t][np.arange(m), 0, now[:m]].astype(np.int64)
        pair[at[:m] + t] = before * 4 + now[:m]
        now[:m] = before
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    bad = matrix[:, 34].copy()
    between = ~legal[matrix[:-1, 33], matrix[1:, 32]]
    inner = np.ones(n, bool)
    inner[first] = False
    bad[1:] += between & inner[1:]
    illegal = np.add.reduceat(bad, first)
    last, order = first + size - 1, np.argsort(by_size)
    is_last = np.zeros(n, bool)
    is_last[last] = True
    spread = lambda values: pa.array(np.where(is_last, np.repeat(values, size), 0), mask=~is_last)
    return pa.record_batch({"conv": conv, "piece": whole["piece"].combine_chunks(), "pair": pa.array(pair), "cost": spread(total[np.arange(len(at)), state][order]), "illegal": spread(illegal), "state": spread(state[order])})


def _edge_columns(letter: Column) -> Column:
    """struct<inserts: array of roles, edit, role> of a letter; role is null where the row keeps its own."""
    found = []
    for p, n, x, q in EDGES:
        _, roles = _inserts(p, n)
        role = F.lit(ROLE[q]) if x == "R" and q in ROLE else F.lit(None).cast("string")
        found.append(F.struct(F.array(*[F.lit(r) for r in roles]).cast("array<string>").alias("inserts"), F.lit(x).alias("edit"), role.alias("role")))
    return F.get(F.array(*found), F.ascii(letter) - FIRST)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of a clean table with the faults that repair() is for, by a hash of conversation and turn: of twenty rows one
    each is dropped, emptied, stripped of its sentence ends, repeated, or given to the user. Nulls count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(conv), F.col(turn), part(role).alias(role), part(text).alias(text), (F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20).alias("fault"))
    hurt = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    out = given.where("fault <> 0").select(conv, turn, F.when(F.col("fault") == 4, "user").otherwise(F.col(role)).alias(role), hurt.alias(text), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs | None = None) -> tuple[DataFrame, DataFrame]:
    """(edits, summary) that make each conversation's roles read: nothing, or at most one system row first, then user and
    assistant in turn, an assistant last.

    edits (conv, place, step, turn, edit, role, text): every edit in order of place and step; D rows have no text, the others are the repaired
    conversation. summary (conv, gaps, blank, duplicate, truncated, illegal, cost): faults of the rows as given and the cost.

    Rows are taken by turn (nulls first); rows of one turn by role, then by a hash of the text. A row is blank if it has but
    white space, else duplicate if role and text came before in the conversation, else truncated if its last letter is no
    `.!?`. Keeping costs nothing, a new role `rerole`, deleting `delete` (blank and duplicate rows must go), an empty
    row put in `insert`; a truncated row that stays costs `truncated` more. Among the cheapest edits those whose initials
    (D, I, K, R in order) are the least text are taken.

    Null texts and roles count as one space, null conversations as one conversation. A role of another first letter than s, u, a,
    or an empty one, cannot be kept. Texts travel in two shuffles only, one by their key and one of the caller's choice: the program
    sees hashes (md5) and flags. An empty table gives empty ones; other columns are not looked at.
    """
    costs = costs or Costs()
    bare = F.btrim("text", F.lit(WHITE))
    given = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    given = given.withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    flags = given.select("conv", "turn", "role", "h", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    key = ["conv", "turn", "role", "h"]
    distinct = common.checkpointed(flags.groupBy(*key).agg(F.count("*").alias("n"), F.any_value("blank").alias("blank"), F.any_value("truncated").alias("truncated")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = distinct.groupBy("conv", "role", "h").agg(F.min(when).alias("earliest"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("h").alias("h_"), "earliest")
    marked = distinct.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("h") == F.col("h_")), "left")
    marked = marked.withColumn("first", F.coalesce(F.col("earliest") == when, F.lit(True))).drop("conv_", "role_", "h_", "earliest")

    fresh = F.col("first") & ~F.col("blank")
    count = lambda c: F.sum(c).alias
    turns = marked.groupBy("conv", "turn").agg(
        count(F.when(F.col("blank"), F.col("n")).otherwise(0))("blank"), count(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("long")))("duplicate"), count((fresh & F.col("truncated")).cast("long"))("truncated")
    )
    gaps = F.coalesce(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("turn")), F.lit(0)).alias("gaps")
    faults = turns.groupBy("conv").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    copies = marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    symbols = copies.select(*key, "copy", F.substring("role", 1, 1).alias("initial"), (~(fresh & (F.col("copy") == 1))).alias("dead"), "truncated")
    kinds = dict(symbols.dtypes)
    solved = symbols.orderBy(*key, "copy").mapInArrow(lambda b: _solve(b, costs), f"conv {kinds['conv']}, turn long, role string, h binary, place long, piece long, letters string, matrix binary")
    solved = common.checkpointed(solved)
    pieces = solved.where("matrix is not null").select("conv", "piece", "matrix")
    chosen = pieces.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(lambda b: _choose(b, costs), f"conv {kinds['conv']}, piece long, pair int, cost long, illegal long, state long")
    chosen = common.checkpointed(chosen)

    edge = _edge_columns(F.substring("letters", F.col("pair") + 1, F.lit(1)))
    edited = solved.drop("matrix").join(chosen.select("piece", "pair"), "piece").select("conv", "turn", "role", "h", "place", edge.alias("e"))
    none = F.lit(None).cast("string")
    put_in = lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("kept"))
    own = F.struct(F.col("e.edit").alias("edit"), F.coalesce("e.role", "role").alias("role"), none.alias("text"), F.when(F.col("e.edit") != "D", F.col("h")).alias("kept"))
    steps = edited.select("conv", "turn", F.col("role").alias("was"), "place", F.posexplode(F.concat(F.transform("e.inserts", put_in), F.array(own))).alias("step", "s")).select("conv", "turn", "was", "place", "step", "s.*")
    texts = given.groupBy(*key).agg(F.any_value("text").alias("own_text")).toDF("conv_", "turn_", "role_", "h_", "own_text")
    met = steps.join(texts, (F.col("kept") == F.col("h_")) & F.col("conv").eqNullSafe(F.col("conv_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("was") == F.col("role_")), "left")
    edits = met.select("conv", "place", "step", "turn", "edit", "role", F.coalesce("text", "own_text").alias("text"))
    at_end = F.get(F.array(*[F.array(*[F.lit(r) for r in ENDING[q]]).cast("array<string>") for q in range(4)]), F.col("state").cast("int"))
    ending = chosen.where("state is not null").select("conv", (F.col("piece") + PIECE).alias("place"), F.posexplode(at_end).alias("step", "role"))
    edits = edits.unionByName(ending.select("conv", "place", "step", F.lit(None).cast("long").alias("turn"), F.lit("I").alias("edit"), "role", F.lit("").alias("text")))
    paid = chosen.where("state is not null").select("conv", "illegal", "cost")
    return edits, together(faults, paid)


def together(*parts: DataFrame) -> DataFrame:
    """One row a conversation with the columns of all parts, each of which has it once at most; a conversation may be null."""
    columns = [c for p in parts for c in p.columns if c != "conv"]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy("conv").agg(*[F.max(c).alias(c) for c in columns]) if columns else whole.distinct()


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits' initials, and the hash of the repaired `role:text` lines.

    A hash is taken in order, so one task reads a conversation, row by row: it holds a hash and the initials, no texts.
    """
    kind = dict(edits.dtypes)["conv"]
    slim = edits.select("conv", "place", "step", "edit", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line"))
    return slim.repartition("conv").sortWithinPartitions("conv", "place", "step").mapInArrow(_hash, f"conv {kind}, audit string, repaired_sha256 string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, state, empty = None, [], None, True
    for batch in batches:
        found: list[tuple] = []
        new = ~_same(batch["conv"])
        for i, (c, edit, line) in enumerate(zip(batch["conv"].to_pylist(), batch["edit"].to_pylist(), batch["line"].to_pylist(), strict=True)):
            if state is None or (new[i] and c != conv):
                if state is not None:
                    found.append((conv, "".join(audit), state.hexdigest()))
                conv, audit, state, empty = c, [], hashlib.sha256(), True
            audit.append(edit)
            if line is not None:
                state.update((line if empty else "\n" + line).encode("utf-8", "surrogatepass"))
                empty = False
        yield _rows(found, batch.schema.field("conv").type)
        kind = batch.schema.field("conv").type
    if state is not None:
        yield _rows([(conv, "".join(audit), state.hexdigest())], kind)


def _rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, audit, sha = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch({"conv": pa.array(conv, kind), "audit": pa.array(audit, pa.string()), "repaired_sha256": pa.array(sha, pa.string())})
