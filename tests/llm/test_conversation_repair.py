"""Conversation repair against every edit sequence of short conversations, and against a program over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import conversation_repair as R
from logloom.llm import queries

WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(role, fault, c):
    own = [("D", "", c.delete, None)]
    if fault not in ("blank", "duplicate"):
        late = c.truncated if fault else 0
        own += [("K", role[:1] or "-", late, role), ("R", "u", c.rerole + late, "user"), ("R", "a", c.rerole + late, "assistant")]
    return own


def every_sequence(rows, c, most=2):
    """All edits with up to `most` inserts in a row: (cost, audit, lines), the least of those that fit."""
    runs = [x for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    name, best = {"u": "user", "a": "assistant"}, None
    per_row = [[(run, o, text) for run in runs for o in options(role, fault, c)] for (role, text), fault in zip(rows, faults(rows), strict=True)]
    for chosen in itertools.product(*per_row, [(run, None, None) for run in runs]):
        roles, audit, cost, lines = "", "", 0, []
        for run, o, text in chosen:
            roles += "".join(run)
            audit += "I" * len(run)
            cost += c.insert * len(run)
            lines += [f"{name[r]}:" for r in run]
            if o:
                roles += o[1]
                audit += o[0]
                cost += o[2]
                lines += [f"{o[3]}:{text}"] if o[3] is not None else []
        if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
    return best


def by_strings(rows, c):
    """The same by states that hold whole strings."""
    name = {"u": "user", "a": "assistant"}
    now = {"": (0, "", [])}

    def with_runs(states):
        out = [(s, v) for s, v in states.items()]
        last = out
        for _ in range(3):
            last = [(NEXT[s][r], (v[0] + c.insert, v[1] + "I", [*v[2], f"{name[r]}:"])) for s, v in last for r in "ua" if r in NEXT[s]]
            out += last
        return out

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit, lines) in with_runs(now):
            for x, initial, paid, new in options(role, fault, c):
                if x != "D" and initial not in NEXT[state]:
                    continue
                to = state if x == "D" else NEXT[state][initial]
                v = (cost + paid, audit + x, lines if new is None else [*lines, f"{new}:{text}"])
                if to not in after or v[:2] < after[to][:2]:
                    after[to] = v
        now = after
    return min((v for s, v in with_runs(now) if s in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    kinds = faults(rows)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return [kinds.count(k) for k in ("blank", "duplicate", "truncated")] + [illegal]


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest())


def repaired(spark, rows, costs=None):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)
    edits, summary = R.repair(df, costs=costs)
    return {r["conv"]: r for r in R.together(summary, R.digests(edits)).collect()}


def check(spark, rows, costs=None, brute=by_strings):
    c = costs or R.Costs()
    got = repaired(spark, rows, costs)
    clean = [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows]
    assert set(got) == {r[0] for r in clean}
    for conv in got:
        own = [(r, x) for _, _, r, x in sorted((r for r in clean if r[0] == conv), key=order)]
        cost, audit, lines = brute(own, c)
        g = got[conv]
        assert (g["cost"], g["audit"]) == (cost, audit), own
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [g["blank"], g["duplicate"], g["truncated"], g["illegal"]] == expected(own)
        turns = {t for i, t, _, _ in rows if i == conv and t is not None}
        assert g["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def some_rows(rng, conv, n, words=("a.", "b!", "c", "", " \t", "long text?", "d")):
    return [(conv, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursula"]), rng.choice([*words, f"own {t}.", f"own {t}.", None])) for t in range(n)]


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(1, 9, 1, 0), R.Costs(3, 2, 1, 1), R.Costs(9, 9, 1, 4)])
def test_equals_every_sequence(spark, costs):
    rng = random.Random(1)
    rows = [r for conv in range(40) for r in some_rows(rng, conv, 3 if conv < 3 else rng.choice([1, 2, 2]))]
    check(spark, rows, costs, every_sequence)
    check(spark, rows, costs)


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(1, 9, 1, 0), R.Costs(3, 2, 1, 1)])
def test_long_and_odd_conversations(spark, monkeypatch, costs):
    rng = random.Random(2)
    rows = [r for conv in range(40) for r in some_rows(rng, conv, rng.choice([1, 5, 20, 70]))]
    rows += some_rows(rng, None, 30) + some_rows(rng, 1000, 900)
    rows += [(1001, 5, "user", "same.")] * 300 + [(1002, None, "assistant", "x" * 100_000)] + [(1003, t, "user", None) for t in (None, None, 3)]
    check(spark, rows, costs)


def test_pieces_of_other_sizes_agree(spark, monkeypatch):
    rng = random.Random(3)
    rows = some_rows(rng, 1, 150) + some_rows(rng, 2, 10)
    whole = {k: tuple(v) for k, v in repaired(spark, rows).items()}
    for size in (1, 7):
        monkeypatch.setattr(R, "PIECE", size)
        assert {k: tuple(v) for k, v in repaired(spark, rows).items()} == whole


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edits, summary = R.repair(R.damaged(df))
    assert (edits.count(), summary.count(), R.digests(edits).count()) == (0, 0, 0)


def test_codes_are_ordered_and_prefix_free():
    assert R.CODES == sorted(R.CODES)
    assert not any(a != b and b.startswith(a) for a in R.CODES for b in R.CODES)
    assert R.FIRST + len(R.EDGES) < 127


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in queries.op13_conversation_repair(spark, sf).collect()}
    given = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert set(got) == {r["conv_id"] for r in given}
    hurt = {}
    for r in given:
        role, text = r["role"] or " ", r["text"] if r["text"] is not None else " "
        k = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        hurt.setdefault(r["conv_id"], []).extend([(r["conv_id"], r["turn"], "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    for conv, g in got.items():
        own = [(r, x) for _, _, r, x in sorted(hurt[conv], key=order)]
        cost, audit, lines = by_strings(own, R.Costs())
        turns = {r[1] for r in hurt[conv]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert [g[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] == [gaps, *expected(own), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def test_edits_carry_the_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "tool", "x")], "conv_id long, turn long, role string, text string")
    edits, _ = R.repair(df)
    assert [(r["edit"], r["role"], r["text"]) for r in edits.orderBy("place", "step").collect()] == [("K", "user", "Hi."), ("R", "assistant", "Hello."), ("D", "tool", None)]
    assert edits.where(F.col("edit") == "I").count() == 0
