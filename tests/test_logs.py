"""Parsers, normalizers, canonical records, multiline, learner, sinks and streams on small tables."""

import ipaddress
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.functions.text import each_stripped, mapped, pairs, strip
from logloom.operators import analytics as A
from logloom.operators import canonical as C
from logloom.operators import learn as L
from logloom.operators import multiline as M
from logloom.operators import parsers as P
from logloom.operators import review as R
from logloom.operators import search as S
from logloom.operators import splitters as X
from logloom.plans import batch, queries
from logloom.sources import sinks, tables
from logloom.streaming import streams

FLAT_JSON = '{"timestamp":"2026-09-16T10:00:00Z","src_ip":"192.168.1.10","dst_ip":"8.8.8.8","dst_port":53,"action":"allow"}'
CISCO = "%ASA-4-106023: Deny tcp src outside:198.51.100.4/44321 dst inside:10.1.1.50/80 by access-group 'DMZ_IN'"
#: (line, format, field to check, its value)
LINES = [
    ('{"timestamp":"2026-09-16T10:00:00Z","actor":{"user":"admin"},"network":{"src_ip":"10.0.0.1"}}', "JSON", "network.src_ip", "10.0.0.1"),
    ('{"a":{"b":{"c":{"d":1}}},"e":{},"f":[1,2]}', "JSON", "a.b.c.d", "1"),
    ("CEF:0|Check Point|VPN-1|Check Point|drop|Drop|4|src=192.168.1.50 dst=10.0.0.1 dpt=443 act=drop", "CEF", "dpt", "443"),
    ("CEF:0|V|P|1|s|n|5|cs1=Value\\=With cs2=Pipe\\|Cut src=172.16.0.4 src=172.16.0.5", "CEF", "src", "172.16.0.5"),
    ("LEEF:2.0|M|E|4.0|15345|\tdevTime=2026-09-16T10:00:00Z\tsrc=10.10.1.25\taccount=jdoe", "LEEF", "account", "jdoe"),
    ("LEEF:2.0|M|E|4.0|15345|^|src=10.10.1.25^account=j=doe", "LEEF", "account", "j=doe"),
    ("<165>1 2026-09-16T17:15:00.003Z border-gw firewall 4124 ID47 [x] User login", "SYSLOG_RFC5424", "procid", "4124"),
    ("<34>Sep 16 17:15:00 host sshd[12]: Failed", "SYSLOG_RFC3164", "pid", "12"),
    (CISCO, "SYSLOG_CISCO", "mnemonic", "106023"),
    ('type=SYSCALL msg=audit(1726485002.124:942): success=yes pid=4124 comm="nc"', "AUDITD", "status", "success"),
    ('user="analyst1" src_ip=192.168.1.99 action=\'permit\' proto="tcp"', "KEY_VALUE", "action", "permit"),
    ("drop from 203.0.113.19 port 5353 to 198.51.100.25 code 0x8FA4", "GENERIC_FALLBACK", "dst_port", "5353"),
    ('{"a":1} {"b":2}', "GENERIC_FALLBACK", "action", None),
    ("{broken", "GENERIC_FALLBACK", "action", None),
]


def test_formats(spark):
    df = spark.createDataFrame(list(enumerate(x[0] for x in LINES)), "i int, raw string")
    found = df.select("i", P.Registry().dispatch(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["format"], r["p"]["fields"].get(x[2])) for r, x in zip(found, LINES, strict=True)] == [(x[1], x[3]) for x in LINES]


#: (line, fields, kinds); None: no JSON.
HARD_JSON = [
    ('{"msg":"${a} {b}","src_ip":"10.0.0.1"}', {"msg": "${a} {b}", "src_ip": "10.0.0.1"}, {}),
    ('{"a":1},{"b":2}', None, None),
    ('{"a":1}] , [{"b":2}', None, None),
    ("{'a':1}", None, None),
    ('{"a":01}', None, None),
    ('{"a":1,}', None, None),
    ("{}", {}, {}),
    ('{"a":"it\'s","b":{}}', {"a": "it's"}, {}),
    ('{"k":' * 50 + "1" + "}" * 50, {".".join("k" * 50): "1"}, {".".join("k" * 50): "int"}),
    ('{"a":NaN,"b":"NaN","c":[-Infinity,1],"e":"x\\"NaN"}', {"a": "NaN", "b": "NaN", "c": "[-Infinity,1]", "e": 'x"NaN'}, {"a": "float", "c": "list"}),
    ('{"a":1,"a":2,"b":{"c":1,"c":"x"}}', {"a": "2", "b.c": "x"}, {"a": "int"}),
    ('{"a.b":1,"a":{"b":null}}', {"a.b": None}, {"a.b": "null"}),
    ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":[1,{"h":2}],"i":"\\u00e9","j":{}}}}}}}}', {"a.b.c.d.e.f.g": '[1,{"h":2}]', "a.b.c.d.e.f.i": "é"}, {"a.b.c.d.e.f.g": "list"}),
    ('{"x":"' + '{}\\"' * 20_000 + '"}', {"x": '{}"' * 20_000}, {}),
]


def test_hard_json(spark):
    df = spark.createDataFrame(list(enumerate(x[0] for x in HARD_JSON)), "i int, raw string")
    found = df.select("i", P.json_lines(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [(r["p"] and r["p"]["fields"], r["p"] and r["p"]["types"]) for r in found] == [x[1:] for x in HARD_JSON]


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(1)
    texts = ["::", ":::", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8", "12345::", "fe80::1%", "fe80::1%a%b", "0:0:1:0:0:1:1:1", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "2001:1::1", "2001:20::1", "::ffff:192.0.0.9", "::.1.2.3", "1.2.3.4::"]
    for _ in range(1500):
        x = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 112 | 0xFFFF, 0xFFFF0000FFFF00000000FFFF0000FFFF, (1 << 48) - 1]))
        text = rng.choice([str(x), x.exploded, str(x).upper()])
        at = rng.randrange(len(text))
        texts += [text, text[:at] + rng.choice(":0f.:g") + text[at + 1 :]]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.classify_ip(F.col("t")).alias("c")).collect():
        try:
            text = r["t"].split(":")[0] if "." in r["t"] and r["t"].count(":") == 1 else r["t"]
            want = (str(ipaddress.ip_address(text)), ipaddress.ip_address(text).is_private)
        except ValueError:
            want = (None, None)
        assert (r["c"]["ip"], r["c"]["is_private"]) == want, r["t"]


def test_registry_order():
    r = P.Registry()
    r.register(P.Parser("first", 95, P.kv_lines))
    r.register(P.Parser("cef_parser", 10, P.cef_lines))
    assert r.names() == ["first", "json_fast_parser", "leef_parser", "syslog_parser", "auditd_parser", "keyvalue_parser", "cef_parser"]
    assert r.get("none") is None


def test_plugins_from_a_folder(spark, tmp_path):
    (tmp_path / "good.py").write_text("from logloom.operators.parsers import Parser, kv_lines\nP = Parser('mine', 99, kv_lines)\n")
    (tmp_path / "bad.py").write_text("raise ValueError\n")
    r = P.Registry()
    assert r.load(str(tmp_path)) == ["bad.py"]
    assert r.names()[0] == "mine"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "epoch_us", "zone"),
    [
        ("1726485002", 1726485002000000, "UTC"),
        ("1726485002.124", 1726485002124000, "UTC"),
        ("1726485002123", 1726485002123000, "UTC"),
        ("10/Oct/2026:13:55:36 +0530", 1791620736000000, "UTC+05:30"),
        ("2026-09-16T17:15:00.123456Z", 1789578900123456, "UTC"),
        ("[2026-09-16 17:15:00]", 1789578900000000, "UTC"),
        ("Sep  6 17:15:00", 1788714900000000, "UTC"),
    ],
)
def test_timestamps(spark, text, epoch_us, zone):
    t = one(spark, text, lambda c: N.timestamp(c, "2026-01-01"))
    assert (t["epoch_us"], t["timezone"], t["ok"]) == (epoch_us, zone, True)


@pytest.mark.parametrize("text", [None, "", "None", "unknown"])
def test_no_timestamp(spark, text):
    assert not one(spark, text, lambda c: N.timestamp(c, "2026-01-01"))["ok"]


def test_free_form_dates(spark):
    t = one(spark, "Sep 16 2026", lambda c: N.timestamp(c, "2026-01-01", free_form=True))
    assert (t["iso"], t["ok"]) == ("2026-09-16T00:00:00+00:00", True)


@pytest.mark.parametrize(
    ("text", "ip", "private"),
    [
        ("192.168.1.1", "192.168.1.1", True), ("8.8.8.8", "8.8.8.8", False), ("10.0.0.1:8080", "10.0.0.1", True), ("999.123.456.789", None, None), ("198.51.100.4", "198.51.100.4", True),
        ("100.64.0.1", "100.64.0.1", False), ("010.0.0.1", None, None), ("10.0.0.0/24", None, None), ("192.0.0.9", "192.0.0.9", False), ("::1", "::1", True), ("2606:4700::1", "2606:4700::1", False),
    ],
)
def test_addresses(spark, text, ip, private):
    c = one(spark, text, lambda c: N.classify_ip(c, ipv6=True))
    assert (c["ip"], c["is_private"]) == (ip, private)


def test_words(spark):
    assert [one(spark, t, N.action) for t in ("DROP", "Permit", "BLOCKED", "some", "disallow", "login", "Built", None)] == ["drop", "allow", "deny", "unknown", "allow", "log", "unknown", "unknown"]
    assert [one(spark, t, N.severity) for t in ("0", "Crit", "x", None)] == ["emergency", "critical", "info", "info"]
    assert [one(spark, t, N.port) for t in ("80 ", "0", "65536", "http")] == [80, None, None, None]


SCORED = [
    (FLAT_JSON, 0.94, "allow"),
    (CISCO, 0.819, "deny"),
    ("CEF:0|V|P|1|s|n|5|src=999.999.999.999 dst=10.0.0.1 act=block", 0.697, "deny"),
    ("CEF:0|V|P|1|s|n|5|cs1=a src=172.16.0.4", 0.713, "unknown"),
    ("[RADAR-V4] x | NODE=N1 | LAT=32.1 | STATUS=LOCKED | LINK=10.0.0.1->11.2.3.4:8080", 0.358, "unknown"),
    ("plain words about node 5", 0.163, "unknown"),
]


def test_confidence(spark):
    df = spark.createDataFrame(list(enumerate(x[0] for x in SCORED)), "i int, raw string")
    for r, (_, overall, action) in zip(C.normalize(df).orderBy("i").collect(), SCORED, strict=True):
        assert abs(r["event"]["processing_metadata"]["confidence"]["overall_confidence"] - overall) < 0.0011
        assert r["event"]["event"]["action"] == action


def test_records_keep_rows_and_columns(spark):
    rows = [(1, FLAT_JSON, "kept"), (2, "  ", "kept"), (3, None, None), (4, "x" * 100_000, "kept"), (1, FLAT_JSON, "kept")]
    df = spark.createDataFrame(rows, "i int, raw string, extra string")
    out = C.normalize(df).orderBy("i").collect()
    assert [r["i"] for r in out] == [1, 1, 2, 3, 4]
    blank = out[2]["event"]
    assert (blank["processing_metadata"]["error_codes"], blank["threat_intel"]["risk_score"]) == (["ERR_EMPTY_LOG"], 0)
    assert all(0 <= r["event"]["processing_metadata"]["confidence"]["overall_confidence"] <= 1 for r in out)
    assert len(C.flat(C.normalize(df)).columns) == 36
    assert C.normalize(df.limit(0)).count() == 0


def test_falsy_aliases_are_consumed(spark):
    line = '{"src_endpoint.ip":"","src_ip":"10.0.0.1","src":"10.0.0.2","severity":0,"message":"m"}'
    e = C.normalize(spark.createDataFrame([(line,)], "raw string")).first()["event"]
    assert e["src_endpoint"]["ip"] == "10.0.0.1"
    assert set(e["unmapped"]) == {"src", "message"}
    assert e["event"]["severity"] == "info"


def test_multiline(spark):
    text = ["2026-09-16T10:00:00 a", "    at x.Y(z)", "    Caused by: e", "   ", "2026-09-16T10:00:01 b", "Caused by: c", "Traceback (most recent call last):", '  File "x", line 3', "ValueError: v"]
    got = [r["raw"].split("\n") for r in M.assemble(tables.from_list(spark, text)).orderBy("line_no").collect()]
    assert got == [text[:4], text[4:5], text[5:8], text[8:]]


def test_multiline_cap_lets_shorter_lines_fit(spark):
    text = ["head", "  " + "x" * 20, "  y"]
    assert M.assemble(tables.from_list(spark, text), cap=12).first()["raw"] == "head\n  y"


def test_learner(spark):
    raw = [(f"link from 10.0.0.{i} port {i + 1000} state {'up' if i % 2 else 'down'}",) for i in range(20)]
    df = spark.createDataFrame(raw, "raw string")
    table = L.learn(df)
    rules = table.collect()
    assert [r.template for r in rules] == ["link from <IP> port <NUM> state <*>"]
    e = C.normalize(df, rules=table).first()["event"]
    assert (e["processing_metadata"]["format_detected"], e["src_endpoint"]["ip"][:7], e["dst_endpoint"]["port"] >= 1000) == ("JIT_INFERRED", "10.0.0.", True)
    box = L.sandbox(df, rules[0].pattern, len(rules[0].fields)).first()
    assert (box["matched"], box["valid"], box["score"]) == (20, True, 0.84)


def test_large_leaves_do_not_depend_on_shares(spark, monkeypatch):
    kinds = [("open", "read", "file"), ("open", "sent", "mail"), ("shut", "kept", "door")]
    raw = [f"job run {a} {b} {c} by user{i} on host{i % 7}x after {i} for {'w' * (i % 9 + 1)}" for i in range(400) for a, b, c in kinds]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    whole = sorted(tuple(r) for r in L.mine(df).collect())
    assert sum(r[2] for r in whole) == len(raw)
    monkeypatch.setattr(L, "SEEDS", 20)
    found = []
    for share in (50, 300, 100_000):
        monkeypatch.setattr(L, "SHARE", share)
        found.append(sorted(tuple(r) for r in L.mine(df.repartition(5)).collect()))
    assert found[0] == found[1] == found[2]
    assert sum(r[2] for r in found[0]) == len(raw)
    assert {r[0] for r in found[0]} == {r[0] for r in whole}
    assert L.mine(df.limit(0)).count() == 0


def test_many_rules_are_a_join(spark):
    lines = spark.range(3000).selectExpr("concat('unit', lpad(id, 4, 'x'), ' w', hex(id * 7919 % 100003), ' reports from 10.0.0.', id % 250, ' port ', id + 1, ' ok') as raw")
    made = spark.range(10_000).selectExpr("concat('sig_', id) as signature", "concat('t', id, ' reports <*>') as template", "concat('^t', id, ' reports (\\\\S+)$') as pattern", "array('event.action') as fields", "0.9D as score", "false as verified", "0L as created")
    rules = made.unionByName(L.learn(lines.limit(50)))
    start = time.time()
    plan = C.normalize(lines.unionByName(spark.sql("select 't77 reports stop' as raw")), rules=rules)
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) > 0
    assert time.time() - start < 60
    found = plan.groupBy("event.processing_metadata.format_detected").count().collect()
    assert dict(map(tuple, found)).get("JIT_INFERRED", 0) >= 51


def test_rules_by_priority_and_age(spark):
    rule = lambda name, pattern, fields, verified, created: R.Rule(name, "go to <*>", pattern, fields, 1.0, verified, created)
    table = R.rule_log(spark, [rule("old", r"^go to (\S+)$", ("event.action",), False, 1), rule("new", r"^go (to) \S+$", ("actor.user_name",), False, 2), rule("hand", r"k=(\S+) b=\S+ c", ("actor.user_name",), True, 1), rule("none", r"^never", (), True, 9)])
    lines = spark.createDataFrame([("go to x",), ("a=1 k=me b=2 c=3",), ("CEF:0|a|b|c|d|k=me b=2 c|5|",), ("nothing",), ("",), (None,)], "raw string")
    got = [(r["event"]["processing_metadata"]["format_detected"], r["event"]["actor"] and r["event"]["actor"]["user_name"]) for r in C.normalize(lines, rules=table).collect()]
    assert sorted(got, key=str) == sorted([("JIT_INFERRED", "to"), ("JIT_INFERRED", "me"), ("CEF", None), ("GENERIC_FALLBACK", None), ("UNKNOWN", None), ("UNKNOWN", None)], key=str)
    used = {r["signature"]: r["n"] for r in R.times_used(lines, table).collect()}
    assert used == {"old": 1, "new": 1, "hand": 2}
    assert [r["signature"] for r in R.listed(table).collect()] == ["none", "new", "hand", "old"]


def test_rules_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"link from 10.0.0.{i} port {i + 1000} state up",) for i in range(20)] + [(FLAT_JSON,)], "raw string")
    want = sorted(map(str, C.normalize(df, rules=L.learn(df)).collect()))
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    assert sorted(map(str, C.normalize(df, rules=L.learn(df)).collect())) == want


def test_learning_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        path = tmp_path / "in" / f"{k}.txt"
        path.write_text("".join(f"{'link' if k < 2 else 'beam'} from 10.0.{k}.{i} port {i + 1000} ok\n" for i in range(6)) + FLAT_JSON + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    read = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    at = lambda name: str(tmp_path / name)
    streams.ingest_learning(read, at("table"), at("rules"), at("used"), at("c")).awaitTermination()
    table = lambda: sorted((r["batch"], r["format_detected"], r["raw_log"]) for r in spark.read.parquet(at("table")).collect())
    first, rules = table(), sorted((r["template"], r["created"]) for r in R.read_rules(spark, at("rules")).collect())
    assert len(first) == 21
    assert sum(f == "JIT_INFERRED" for _, f, _ in first) == 18
    assert rules == [("beam from <IP> port <NUM> ok", 2), ("link from <IP> port <NUM> ok", 0)]
    assert sorted(r["n"] for r in R.uses(spark, at("used")).collect()) == [6, 12]
    # the last batch is run again: its commit is taken away, as after a failure
    os.remove(tmp_path / "c" / "commits" / "2")
    crc = tmp_path / "c" / "commits" / ".2.crc"
    if crc.exists():
        os.remove(crc)
    streams.ingest_learning(read, at("table"), at("rules"), at("used"), at("c")).awaitTermination()
    assert table() == first
    assert sorted((r["template"], r["created"]) for r in R.read_rules(spark, at("rules")).collect()) == rules
    assert sorted(r["n"] for r in R.uses(spark, at("used")).collect()) == [6, 12]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("plain words",), (FLAT_JSON,)], "raw string")
    events = C.normalize(df)
    letters = sinks.dead_letters(events)
    sinks.append_dead_letters(letters, str(tmp_path / "dead"))
    assert [r["raw_log"] for r in sinks.read_dead_letters(spark, str(tmp_path / "dead")).collect()] == ["plain words"]
    sinks.append_table(C.flat(events), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    queue = sinks.enqueue(spark.createDataFrame([("a",)], "event_id string"), spark.createDataFrame([("a",), ("b",), ("b",)], "event_id string"))
    assert [tuple(r) for r in queue.collect()] == [("b", "PENDING")]
    sinks.export(C.flat(events), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_observed_write(spark, tmp_path):
    df = spark.createDataFrame([("plain words",), (FLAT_JSON,), (" ",)], "raw string")
    got = sinks.write_observed(C.normalize(df), str(tmp_path / "t"), str(tmp_path / "d"))
    assert (got["total_logs"], got["needs_review"], got["n_blank"], got["auto_accepted"]) == (3, 2, 1, 1)
    want = A.metrics(C.flat(C.normalize(df))).first().asDict()
    assert {k: got[k] for k in want} == want
    assert sinks.read_dead_letters(spark, str(tmp_path / "d")).count() == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sinks.write_observed(C.normalize(df.limit(0)), str(tmp_path / "t2"), str(tmp_path / "d2"))["auto_accepted"] is None


def test_synthetic_corpus(spark):
    first, again = (sorted(map(tuple, tables.synthetic(spark.range(200), seed=3).collect())) for _ in range(2))
    assert first == again
    found = C.normalize(tables.synthetic(spark.range(200))).select("event.processing_metadata.format_detected").distinct().count()
    assert found >= 6


def test_text_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-09-16T10:00:00 a\n    at x.Y(z)\n2026-09-16T10:00:01 b\n")
    lines = tables.read_lines(spark, str(tmp_path / "in"))
    assert sorted(r["raw"] for r in M.assemble(lines).collect()) == ["2026-09-16T10:00:00 a\n    at x.Y(z)", "2026-09-16T10:00:01 b"]
    raw = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    run = streams.ingest(raw, str(tmp_path / "t"), str(tmp_path / "d"), str(tmp_path / "c"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


STACK = ["2026-09-16T10:00:00 a", "    at x.Y(z)", "2026-09-16T10:00:01 b"]


def _lines_folder(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    path = tmp_path / "in" / name
    path.write_text("".join(f"{s},{n},{x}\n" for s, n, x in rows))
    os.utime(path, (1_700_000_000 + ord(name[0]), 1_700_000_000 + ord(name[0])))  # files are read in the order of their times


def test_stream_multiline(spark, tmp_path):
    _lines_folder(tmp_path, "a.csv", [("s", i + 1, x) for i, x in enumerate(STACK)])
    read = spark.readStream.schema("source string, line_no long, line string").csv(str(tmp_path / "in"))
    run = lambda: sorted(tuple(r) for r in streams.assemble_all(read, str(tmp_path / "out"), str(tmp_path / "c")).collect())
    first = ("s", 1, 2, "2026-09-16T10:00:00 a\n    at x.Y(z)")
    assert run() == [first, ("s", 3, 1, "2026-09-16T10:00:01 b")]
    _lines_folder(tmp_path, "b.csv", [("s", 4, "    at z"), ("t", 1, "    lost"), ("t", 2, "  more")])
    assert run() == [first, ("s", 3, 2, "2026-09-16T10:00:01 b\n    at z"), ("t", 1, 2, "    lost\n  more")]
    assert run() == run()


def test_stream_multiline_equals_batch(spark, tmp_path):
    text = ["lost", *["2026-09-16T10:00:00 " + "h" * (i % 5) if i % 7 == 0 else "    at x.Y" + "z" * (i % 11) for i in range(90)]]
    rows = [(s, i, x) for s in ("a", "b", "c") for i, x in enumerate(text)]
    for k in range(3):
        _lines_folder(tmp_path, f"{k}.csv", [r for r in rows if r[1] // 31 == k])
    read = spark.readStream.schema("source string, line_no long, line string").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    got = streams.assemble_all(read, str(tmp_path / "out"), str(tmp_path / "c"), cap=60)
    want = M.assemble(spark.createDataFrame(rows, "source string, line_no long, line string"), cap=60)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select("source", "line_no", "n_lines", "raw").collect())


def test_stream_timers_give_out_idle_records(spark, tmp_path):
    _lines_folder(tmp_path, "a.csv", [("s", 1, STACK[0]), ("s", 2, STACK[1])])
    _lines_folder(tmp_path, "b.csv", [("t", 1, "2026-09-16T12:00:00 late")])
    read = spark.readStream.schema("source string, line_no long, line string").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    timed = read.withColumn("at", F.regexp_extract("line", r"^(\S+)", 1).try_cast("timestamp")).withColumn("at", F.coalesce("at", F.lit("2026-09-16 10:00:00").cast("timestamp"))).withWatermark("at", "1 minute")
    run = streams.assemble(timed, idle_ms=60_000, time_col="at").writeStream.format("memory").queryName("by_event_time").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [r["raw"] for r in spark.table("by_event_time").collect()] == ["\n".join(STACK[:2])]
    run = streams.assemble(read, idle_ms=1000).writeStream.format("memory").queryName("by_clock").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        for _ in range(60):
            if spark.table("by_clock").count() == 2:
                break
            time.sleep(1)
    finally:
        run.stop()
    assert sorted(r["raw"] for r in spark.table("by_clock").collect()) == ["\n".join(STACK[:2]), "2026-09-16T12:00:00 late"]


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_percentiles_sort_no_whole_table(spark, kind, monkeypatch):
    monkeypatch.setattr(A, "SORTED", 10)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).cast(kind).alias("v"))
    values = sorted(r["v"] for r in df.collect())
    got = A.latency_percentiles(df.unionByName(spark.sql(f"select cast(null as {kind}) as v")), "v").first()
    assert [got[k] for k in ("min", "p50", "p90", "p99", "max")] == [values[0], *(values[int(len(values) * p)] for p in (0.5, 0.9, 0.99)), values[-1]]
    assert A.latency_percentiles(df.limit(0), "v").first()["p50"] is None


def test_multiline_carries_records_over_blocks(spark, monkeypatch):
    text = ["lost", *[f"2026-09-16T10:00:{i:02d} a" if i % 7 == 0 else f"    at x.Y({i})" for i in range(60)]]
    rows = [(s, i * 3, x) for s in ("a", "b", None) for i, x in enumerate(text)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
    whole = sorted(map(str, M.assemble(df).collect()))
    monkeypatch.setattr(M, "BLOCK", 10)
    assert sorted(map(str, M.assemble(df).collect())) == whole
    assert len(whole) == 3 * 10


@pytest.mark.parametrize(("block", "cap"), [(7, 60), (50, 400), (1 << 16, 60)])
def test_lines_beyond_the_cap_stay_behind(spark, monkeypatch, block, cap):
    """Against a fold in order over records of hundreds of lines, empty, long and equally long ones among them."""
    draw = random.Random(5)
    wanted, rows = [], []
    for source in ("a", None):
        kept, size, first, count = [], 0, None, 0
        for no in range(700):
            line = "head " + "h" * draw.choice((1, 9, 80)) if draw.random() < 0.01 else draw.choice(("\r\n", "  " + "x" * draw.choice((3, 3, 3, 20, 21, 90, 500))))
            rows.append((source, no, line))
            line = line.rstrip("\r\n")
            if line.startswith("head") or not no:
                wanted += [(source, first, count, "\n".join(kept))] if no else []
                kept, size, first, count = [line], len(line), no, 1
            else:
                count += 1
                if size + len(line) < cap:
                    kept, size = [*kept, line], size + len(line) + 1
        wanted.append((source, first, count, "\n".join(kept)))
    monkeypatch.setattr(M, "BLOCK", block)
    got = M.assemble(spark.createDataFrame(rows, "source string, line_no bigint, line string").repartition(5), cap=cap).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_normalize_keeps_columns_of_any_name(spark):
    names = ["raw", "category", "direction", "g", "p", "x", "n", "c", "kind", "tag", "warnings", "errors", "scores", "raw_log", "a.b"]
    df = spark.createDataFrame([(FLAT_JSON, *names[1:])], ", ".join(f"`{k}` string" for k in names))
    out = C.normalize(df)
    assert out.columns == [*names, "event"]
    assert list(out.first())[1:-1] == names[1:]


def test_batch_entries(spark):
    text = ["2026-09-16T10:00:00 a", "    at x.Y(z)", FLAT_JSON, " "]
    assert batch.ingest(spark, text, multiline=True).count() == 2
    assert tuple(batch.summary(batch.ingest(spark, text)).first()) == (4, 2, 1)
    lines = spark.createDataFrame([(f"beam from 10.0.0.{i} port {i + 1000}",) for i in range(5)] + [(FLAT_JSON,)], "raw string")
    events, rules = batch.learn_and_parse(lines)
    assert rules.count() == 1
    assert sorted(r["f"] for r in events.select(F.col("event.processing_metadata.format_detected").alias("f")).collect()) == ["JIT_INFERRED"] * 5 + ["JSON"]
    assert batch.learn_and_parse(lines.limit(0))[1].collect() == []


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_latest_table(spark, tmp_path):
    from logloom.sources.store import LatestTable

    t = LatestTable(str(tmp_path / "t"), by=("day",), buckets=16)
    row = lambda i, seq, word: (i, seq, None if i is None else i % 3, word)
    make = lambda rows: spark.createDataFrame(rows, "id long, seq long, day int, word string")
    got = lambda df: sorted(map(tuple, df.select("id", "seq", "day", "word").collect()), key=str)
    want = {}

    def put(version, rows):
        t.upsert(make(rows), version)
        want.update({r[0]: r for r in sorted(rows, key=lambda r: r[1])})

    put(0, [row(i, s, f"a{s}") for i in [*range(300), None] for s in (1, 2)])
    assert got(t.read(spark)) == sorted(want.values(), key=str)
    before = _files(tmp_path / "t")
    for v in (1, 2, 3):
        put(v, [row(i, -v, f"b{v}") for i in (5, 6, 7)])  # a later version wins, whatever its order
    put(3, [row(5, 0, "c")])  # written again: only this row is left of version 3
    want.update({i: row(i, -2, "b2") for i in (6, 7)})
    assert got(t.read(spark)) == sorted(want.values(), key=str)
    after = _files(tmp_path / "t")
    assert before.items() <= after.items()
    keys = make([row(6, 0, ""), row(None, 0, ""), row(999, 0, "")])
    assert got(t.lookup(keys)) == sorted([want[6], want[None]], key=str)
    plan = t.lookup(keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket#" in plan and "IN (" in plan.upper()
    place = lambda f: f.rsplit("/", 1)[0].split("/", 2)[2]  # noqa: E731  day and bucket of a file
    folders = {}
    for f in after:
        folders.setdefault(place(f), set()).add(f.split("/")[0])
    full = {p for p, versions in folders.items() if len(versions) > 2}
    removed = t.compact(spark, most=2)
    assert got(t.read(spark)) == sorted(want.values(), key=str)
    merged = _files(tmp_path / "t")
    gone = {f for f in after if f not in merged}
    assert full and removed == len(gone) and {place(f) for f in gone} == full == {place(f) for f in merged if f not in after}
    assert {f: m for f, m in merged.items() if f in after} == {f: m for f, m in after.items() if f not in gone}
    put(4, [row(6, 9, "d")])
    assert got(t.read(spark)) == sorted(want.values(), key=str)
    assert t.compact(spark, most=50) == 0


def test_review_queue_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: streams.enqueue(spark.readStream.schema("event_id long").json(str(tmp_path / "in")), str(tmp_path / "q"), str(tmp_path / "c")).awaitTermination()
    queue = lambda: sorted(tuple(r) for r in sinks.read_queue(spark, str(tmp_path / "q"), spark.createDataFrame([], "event_id long").schema).collect())
    (tmp_path / "in" / "a.json").write_text('{"event_id":1}\n{"event_id":2}\n{"event_id":2}\n')
    run()
    (tmp_path / "in" / "b.json").write_text('{"event_id":2}\n{"event_id":3}\n')
    run()
    assert queue() == [(1, "PENDING"), (2, "PENDING"), (3, "PENDING")]
    (tmp_path / "c" / "commits" / "1").unlink()  # as if the run had died before it noted the second batch
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert queue() == [(1, "PENDING"), (2, "PENDING"), (3, "PENDING")]


def test_search_by_index_equals_the_whole_scan(spark, tmp_path):
    path, index = str(tmp_path / "a table"), str(tmp_path / "index")
    make = lambda words: spark.createDataFrame([(w, "CEF", None) for w in words], "raw_log string, format_detected string, src_ip string").coalesce(1)
    for words in (["Denied 10.0.0.1", "x" * 50_000 + "needle"], ["accepted Ünï 👍🏽 ok", None], ["", "50% _off_"]):
        make(words).write.mode("append").parquet(path)
    assert S.index_table(spark, path, index) == 3
    assert S.index_table(spark, path, index) == 0
    make(["late NEEDLE"]).write.mode("append").parquet(path)  # not in the index yet
    whole = spark.read.parquet(path)
    got = lambda df: sorted(str(r["raw_log"]) for r in df.collect())
    for text in ("needle", "ÜNÏ 👍🏽", "ef", "cef", "50%", "_o", "%", "none of it", "denied 10", "d 1"):
        found = S.candidates(spark, path, index, text)
        assert got(A.holding(found, text)) == got(A.holding(whole, text)), text
    assert len(S.candidates(spark, path, index, "denied 10").inputFiles()) == 2
    assert S.index_table(spark, path, index) == 1
    assert len(S.candidates(spark, path, index, "denied 10").inputFiles()) == 1
    assert S.candidates(spark, path, index, "none of it").count() == 0


def test_table_functions_give_several_records(spark):
    class Pieces:
        def eval(self, raw):
            for i, x in enumerate((raw or "").split(";;")):
                if x:
                    yield i, x

    lines = spark.createDataFrame([(1, "a;;b", 7), (2, "", 8), (3, None, 9), (4, "c", 9)], "id int, raw string, part int")
    X.register(spark, "pieces", Pieces)
    X.register(spark, "pieces_sql", "filter(split(raw, ';;'), x -> x <> '')")
    want = [(1, 0, "a"), (1, 1, "b"), (2, 0, ""), (3, 0, None), (4, 0, "c")]
    for name in ("pieces", "pieces_sql"):
        assert sorted(tuple(r) for r in X.records(lines, name).select("id", "part", "raw").collect()) == want
        found = A.query(spark, lines.withColumnRenamed("raw", "raw_log"), f"select count(*) as n from normalized_logs t, lateral {name}(t.raw_log) r where r.part = :p", {"p": 1})
        assert found.first()["n"] == 1
    assert X.records(lines.select("raw"), "pieces").columns == ["part", "raw"]
    assert X.records(lines.limit(0), "pieces").count() == 0
    with pytest.raises(ValueError):
        X.register(spark, "no name", "split(raw, ' ')")


def test_spread_deals_out_one_row_group(spark, tmp_path):
    """A file that is cut into many scan tasks by its bytes, but holds all rows in one row group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 4 * tables.DEALT + 1
    pq.write_table(pa.table({"event_id": pa.array(range(n))}), tmp_path / "one.parquet", row_group_size=n, compression="none", use_dictionary=False)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "100000")
    try:
        read = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert read.rdd.getNumPartitions() > 8
        dealt = [r["n"] for r in tables.spread(read, "event_id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(dealt) == 5 and sum(dealt) == n and max(dealt) < 1.5 * tables.DEALT
    finally:
        spark.conf.set(name, before)


def test_values_are_compiled(spark):
    """What is bound once is a projection's column (those are compiled) and not a generator's argument, and is not repeated in
    a filter that Spark pushes down."""
    lines = spark.createDataFrame([(1, "CEF:0|A|B|1|2|n|3|src=1.1.1.1 act=Deny")], "id long, raw string")
    events = C.normalize(lines).where("event.event.action = 'deny'")
    plan = events._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generators = [x for x in plan if x.strip(" :+-").startswith("Generate ")]
    assert generators and not [x for x in generators if "lambda" in x]
    assert [x for x in plan if x.strip(" :+-").startswith("Filter ")] == [x for x in plan[: plan.index(generators[-1])] if x.strip(" :+-").startswith("Filter ")]
    assert events.count() == 1


def test_plain_fields_leave_the_rest_out(spark):
    """Two fields of the flat table take neither the whole event nor the stages that they do not need."""
    lines = spark.createDataFrame([(1, "CEF:0|A|B|1|2|n|3|src=1.1.1.1 act=Deny"), (2, "from 1.2.3.4"), (3, "")], "id long, raw string")
    flat = C.flat(C.normalize(lines), ("id",))
    plan = A.badges(flat)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(event" not in plan and " AS c_src#" not in plan and " AS g#" not in plan
    plan = A.metrics(flat)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(event" not in plan and " AS m_time#" not in plan
    assert {tuple(r) for r in A.badges(flat).collect()} == {("hot", 2), ("degraded", 1)}


def test_pairs_match_once(spark):
    """A line's pairs are not matched anew one by one, nor a detected address read as often as it is referred to."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([("a=1 b=\"x y\" c='q' d=\"\" e=\"un",), ("no pairs",), (None,)], "raw string")
    got = df.select(pairs(F.col("raw"), P.KV_PAIR, (2, 3, 4)).alias("p"))
    assert "regexp_replace" not in plan(got)
    assert [r["p"] and [tuple(e) for e in r["p"]] for r in got.collect()] == [[("a", "1"), ("b", "x y"), ("c", "q"), ("d", ""), ("e", '"un')], [], None]
    assert plan(C.normalize(df).select("event.src_endpoint.ip")).count("from_json(") == 1


def test_strip_of_any_blank(spark):
    texts = ["", " ", "a", " a b ", "　é\x85", "é", "~a\x1f", "\tx", "x\n", "!", "\x7f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i")
    got = df.select(strip(F.col("s")).alias("t"))
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()  # most texts are not looked through
    assert [r["t"] for r in got.collect()] == [t.strip() for t in texts]


@pytest.mark.parametrize("name", ["accuracy_mixed", "metrics_summary", "route_review", "recent_events", "dead_letter"])
def test_compiled_methods(spark, name):
    """The JVM never compiles a method of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        debug = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.debug.package$").getField("MODULE$").get(None)
        parts = debug.codegenStringSeq(plan)
        assert parts.length() and all(parts.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(parts.length()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_whole_arrays(spark):
    """Arrays of keys and values that are taken as they are give what was made of them one by one."""
    df = spark.createDataFrame([(["a", "b"], ["1", "2"]), (["a", "b", "a"], ["1", " 2\t", "3 "]), (["a", "b"], ["x\r", "y\ny"]), ([], []), (None, None)], "k array<string>, v array<string>")
    got = [r.m for r in df.select(mapped(F.col("k"), each_stripped(F.col("v"))).alias("m")).collect()]
    assert got == [{"a": "1", "b": "2"}, {"b": "2", "a": "3"}, {"a": "x", "b": "y\ny"}, {}, None]
    texts = ["0", "-0.0", ".0", "0E+3", "1e-400", "00", "5", "-7", "10.0.0.1", "x"]
    kinds = spark.createDataFrame([({"n": t, "s": "0", "e": "7"}, {"n": "float"}) for t in texts] + [({"n": "false"}, {"n": "bool"}), ({"n": "[]"}, {"n": "list"}), ({"n": "[0]"}, {"n": "list"})], "f map<string,string>, k map<string,string>")
    held = [("n" in r.g) for r in kinds.select(C.given(F.col("f"), F.col("k")).alias("g")).collect()]
    assert held == [False] * 6 + [True] * 4 + [False, False, True]


def test_cisco_flow_and_backslashes(spark):
    df = spark.createDataFrame([("%ASA-4-106023: xx permit TCP src a:1.2.3.4 dst b:2.3.4.5 deny udp src 9.9.9.9/1 dst d:8.8.8.8/2",), ("%ASA-0-1: no flow",)], "raw string")
    first, second = [r.p.fields for r in df.select(P.syslog_lines(F.col("raw")).alias("p")).collect()]
    assert {k: first[k] for k in ("action", "proto", "src_if", "src", "dst_if", "dst")} == {"action": "permit", "proto": "TCP", "src_if": "a", "src": "1.2.3.4", "dst_if": "b", "dst": "2.3.4.5"}
    assert "spt" not in first and "action" not in second and second["message"] == "no flow"
    cef = spark.createDataFrame([(r"CEF:0|A|B|1|2|n|5|msg=a\=b k=x k=\\y",)], "raw string").select(P.cef_lines(F.col("raw")).alias("p")).first().p.fields
    assert (cef["msg"], cef["k"]) == ("a=b", "\\y")
