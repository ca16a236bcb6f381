"""Format parsers as column expressions, and the dispatcher that tries them in order of priority.

A parser is an object with name, priority, minimum confidence test and expression: `parse(raw)` gives
a struct PARSED, or null if the line is not in its format. Values are texts; `types` names the kind of
those that were no text in the source ('int', 'float', 'bool', 'null', 'list'), because empty and zero
values of those count as missing further on.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import contains_any, each_stripped, fields_of, group, last_of_each, last_wins, let, mapped, matches, strip

PARSED = "struct<format: string, parser: string, fields: map<string,string>, types: map<string,string>, ts_raw: string, exact: boolean, warnings: array<string>, errors: array<string>>"
#: Nested objects are flattened by variants to this depth; lines that go deeper, or name a key twice, are read token by token.
JSON_DEPTH = 6
#: Tokens of a JSON text: strings, marks, and words between them. Numbers that JSON lacks, outside of strings.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
JSON_TOKEN = JSON_STRING + r'|[{}\[\],:]|[^\s{}\[\],:"]++'
JSON_ODD = rf'\G((?:{JSON_STRING}|[^"NI\-]++|(?!NaN|-?Infinity)[^"])*+)(NaN|-?Infinity)'
#: Stands before such a number where it is held as a text.
ODD = "\x01"

#: Patterns of the formats.
# A key starts where no key character stands before and is never given back, so a long run of them is read once.
KEY = r"(?<![a-zA-Z0-9_\-\.])([a-zA-Z0-9_\-\.]++)"
CEF_PAIR = KEY + r'=(?:"((?:[^"\\]++|\\.)*+)"|(\S+))'
AUDIT_HEAD = r"^type=([A-Z0-9_]+)\s+msg=audit\((\d+\.\d+):(\d+)\):\s*(.*)$"
AUDIT_PAIR = KEY + r'=(?:"([^"]*)"|(\S+))'
KV_PAIR = KEY + r"""(?:=|\s*+:\s*+)(?:"([^"]*)"|'([^']*)'|(\S+))"""
RFC5424 = r"(?d)^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$"
RFC3164 = r"(?d)^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([a-zA-Z0-9_\-\./]+)(?:\[(\d+)\])?:\s*(.*)$"
CISCO = r"(?d)^(?:<(\d{1,3})>)?%([A-Z0-9_]+)-(\d)-([A-Z0-9_]+):\s*(.*)$"
CISCO_FLOW = r"(?i)(Deny|Built|Teardown|Permit|Allow|Drop)\s+(\w+)\s+src\s+(?:(\w+):)?([^/:\s]+)(?:/(\d+))?\s+dst\s+(?:(\w+):)?([^/:\s]+)(?:/(\d+))?"
CISCO_NAMES = ("action", "proto", "src_if", "src", "spt", "dst_if", "dst", "dpt")
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"
PORT = r"(?i)\b(?:port|sport|dport|spt|dpt|pt)[\s:=]+(\d{1,5})\b"
STAMP = r"\b(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?|\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}|[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\b"
HEX = r"\b0x[0-9a-fA-F]+\b"
USER = r"""(?i)\b(?:user|username|usr|account|for)\s*[=:]\s*['"]?([a-zA-Z0-9_\-\.\@]+)['"]?"""
DENY_WORDS = ("deny", "blocked", "drop", "reject", "failed")
ALLOW_WORDS = ("allow", "accept", "permit", "success")
JSON_TIME_KEYS = ("@timestamp", "timestamp", "time", "event_time", "datetime", "date", "created_at")
#: One of them ends each of JSON_TIME_KEYS.
JSON_TIME_ENDS = ("time", "date", "stamp", "created_at")
KV_TIME_KEYS = ("timestamp", "time", "datetime", "date", "ts", "@timestamp")


def parsed(fmt: str | Column, parser: str, fields: Column, types: Column | None = None, ts_raw: Column | None = None, exact: bool = True, warnings: Column | None = None, errors: Column | None = None) -> Column:
    no_text = F.array().cast("array<string>")
    return F.struct(
        (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("format"), F.lit(parser).alias("parser"), fields.cast("map<string,string>").alias("fields"),
        (F.create_map().cast("map<string,string>") if types is None else types).alias("types"), (F.lit(None).cast("string") if ts_raw is None else ts_raw).alias("ts_raw"),
        F.lit(exact).alias("exact"), (no_text if warnings is None else warnings).alias("warnings"), (no_text if errors is None else errors).alias("errors"),
    )


def entries(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])


def names(keys: Iterable[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys])


def texts(values: Iterable[Column]) -> Column:
    return F.array(*[v.cast("string") for v in values])


def map_of(**values: Column) -> Column:
    """Map of texts, as map_from_entries(entries()) makes it."""
    return F.map_from_arrays(names(values), texts(values.values()))


def types_of(**kinds: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])


def truthy_first(fields: Column, *keys: str) -> Column:
    """The first of the keys' values that isn't null or empty."""
    return F.coalesce(*[F.when(fields[k] != "", fields[k]) for k in keys])


def _ends_with(key: Column, e: Column) -> Column:
    return F.lower(e["key"]).endswith(key)


Entry = "array<struct<key: string, value: string, kind: string>>"


def _json_value(v: Column) -> Column:
    """struct<value, kind> of a variant; kind is object where one is left."""

    def of(text: Column) -> Column:
        kind = F.schema_of_variant(v)
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        short = F.when(kind == "STRING", F.when(text.startswith(ODD), "float").otherwise("str")).when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").when(kind.startswith("OBJECT"), "object").when(nested, "list").otherwise("float")
        return F.struct(F.when(nested, _plain(F.to_json(v))).when(text.startswith(ODD), F.substring(text, 2, 9)).otherwise(text).alias("value"), short.alias("kind"))

    return let(F.try_variant_get(v, "$", "string"), of)


def _plain(nested: Column) -> Column:
    """JSON text whose odd numbers are words again."""
    return F.regexp_replace(nested, r'"\\u0001(NaN|-?Infinity)"', "$1")


def _json_fold(s: Column) -> Column:
    """Entries of a valid object of any depth, in the order of the text: one pass over its tokens with the path as a stack."""
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("lists"), F.lit("").alias("text"), F.array().cast(Entry).alias("out"))

    def step(state: Column, t: Column) -> Column:
        path, key, lists = state["path"], state["key"], state["lists"]
        none = F.lit(None).cast("string")
        name = F.array_join(F.concat(path, F.array(key)), ".")
        inside = lists > 0
        text = F.concat(state["text"], t)
        closes = inside & (t == "]") & (lists == 1)
        mark = t.isin("{", "}", "[", "]", ",", ":")
        is_key = ~inside & ~mark & key.isNull()
        is_value = ~inside & ~mark & key.isNotNull()
        own = F.when(closes, F.array(F.struct(name.alias("key"), _plain(text).alias("value"), F.lit("list").alias("kind")))).when(
            is_value, F.array(let(_json_value(F.try_parse_json(t)), lambda v: F.struct(name.alias("key"), v["value"].alias("value"), v["kind"].alias("kind"))))
        )
        return F.struct(
            F.when(~inside & (t == "{") & key.isNotNull(), F.concat(path, F.array(key))).when(~inside & (t == "}"), F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path).alias("path"),
            F.when(is_key, F.try_variant_get(F.try_parse_json(t), "$", "string")).when(closes | is_value | (~inside & t.isin("{", "}")), none).otherwise(key).alias("key"),
            (lists + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)).alias("lists"),
            F.when(inside & ~closes, text).when(~inside & (t == "["), t).otherwise("").alias("text"),
            F.when(own.isNotNull(), F.concat(state["out"], own)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(F.regexp_extract_all(s, F.lit(JSON_TOKEN), F.lit(0)), start, step, lambda state: state["out"])


def json_lines(raw: Column) -> Column:
    """Root objects, flattened with dots whatever their depth; empty nested objects vanish, lists stay as JSON text, of equal
    keys the last stays. The line must be one object and nothing else; NaN and Infinity count as numbers."""
    return read_json(strip(raw))


def read_json(stripped: Column) -> Column:
    """json_lines() of a stripped line, as the other read_ functions are of theirs."""
    fixed = F.when(stripped.contains("NaN") | stripped.contains("Infinity"), F.regexp_replace(stripped, JSON_ODD, f'$1"\\\\u0001$2"')).otherwise(stripped)
    return F.when(stripped.startswith("{") & stripped.endswith("}"), let(fixed, _json))


def _json(s: Column) -> Column:
    # one root: beside a second element the line is one element of a list. Spark's list functions allow single quotes
    return let(F.regexp_replace(s, JSON_STRING, ""), lambda bare: _one_json(s, bare))


def _one_json(s: Column, bare: Column) -> Column:
    """_json() of a line, and the line without its strings."""
    alone = (F.json_array_length(F.concat(F.lit("["), s, F.lit(",0]"))) == 2) & ~bare.contains("'")
    objects = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))  # no more levels than that

    def deeper(e: Column) -> Column:
        inner = F.transform(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")), lambda c: F.struct(F.concat(e["key"], F.lit("."), c["key"]).alias("key"), c["value"].alias("value")))
        return F.coalesce(inner, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    def flatten(whole: Column) -> Column:
        top = F.transform(F.json_object_keys(s), lambda k: F.struct(k.alias("key"), F.try_element_at(whole, k).alias("value")))
        nested = top
        for level in range(1, JSON_DEPTH):
            nested = let(nested, lambda es, level=level: F.when(objects > level, F.flatten(F.transform(es, deeper))).otherwise(es))
        valued = lambda es: F.transform(es, lambda e: let(_json_value(e["value"]), lambda v: F.struct(e["key"].alias("key"), v["value"].alias("value"), v["kind"].alias("kind"))))
        return valued(nested)

    def build(flat: Column) -> Column:
        def first_time(timed: Column) -> Column:
            hits = []
            for key in map(F.lit, JSON_TIME_KEYS):
                hit = F.try_element_at(F.filter(timed, partial(_ends_with, key)), F.lit(1))
                hits.append(F.when(hit.isNotNull(), F.when(hit["kind"] == "null", "None").otherwise(F.when(hit["value"] != "", hit["value"]))))
            return F.when(F.size(timed) > 0, F.coalesce(*hits))

        timed = F.filter(flat, lambda e: let(F.lower(e["key"]), lambda k: reduce(or_, [k.endswith(end) for end in JSON_TIME_ENDS])))
        kinds = lambda once: let(F.filter(once, lambda e: e["kind"] != "str"), lambda odd: F.map_from_arrays(odd["key"], odd["kind"]))
        return let(last_of_each(flat), lambda once: parsed("JSON", "json_fast_parser", F.map_from_arrays(once["key"], once["value"]), kinds(once), let(timed, first_time)))

    def read(whole: Column) -> Column:
        deep = lambda flat: F.exists(flat, lambda e: e["kind"] == "object")
        flat = let(F.when(whole.isNotNull(), flatten(whole)), lambda flat: F.when(flat.isNull() | deep(flat), _json_fold(s)).otherwise(flat))
        return let(flat, build)

    return F.when(alone, let(F.try_variant_get(F.try_parse_json(s), "$", "map<string,variant>"), read))


def _cut(s: Column, mark: str) -> Column:
    at = F.instr(s, mark)
    return F.when(at > 1, F.substring(s, at, F.length(s))).otherwise(s)


def cef_lines(raw: Column) -> Column:
    return read_cef(strip(raw))


def read_cef(s: Column) -> Column:
    looks = s.startswith("CEF:") | s.contains(" CEF:")
    return F.when(looks, let(F.split(_cut(s, "CEF:"), r"(?<!\\)\|"), _cef))


def _cef(parts: Column) -> Column:
    head = lambda i: F.replace(F.get(parts, F.lit(i)), F.lit("\\|"), F.lit("|"))
    clean = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\="), F.lit("=")), F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\")), F.lit("\\n"), F.lit("\n"))
    extension = F.array_join(F.slice(parts, 8, F.greatest(F.size(parts), F.lit(8))), "|")
    header = dict(cef_version=F.replace(F.get(parts, F.lit(0)), F.lit("CEF:"), F.lit("")), device_vendor=head(1), device_product=head(2), device_version=head(3), signature_id=head(4), event_name=head(5), severity=head(6))
    cleaned = lambda values: F.when(F.array_join(values, "").contains("\\"), F.transform(values, clean)).otherwise(values)
    fields = let(matches(extension, CEF_PAIR), lambda m: mapped(F.concat(names(header), m["keys"]), F.concat(texts(header.values()), cleaned(m["values"]))))
    return F.when(F.size(parts) >= 8, let(fields, lambda f: parsed("CEF", "cef_parser", f, ts_raw=truthy_first(f, "rt", "end", "start"))))


def leef_lines(raw: Column) -> Column:
    return read_leef(strip(raw))


def read_leef(s: Column) -> Column:
    looks = s.startswith("LEEF:") | s.contains(" LEEF:")
    return F.when(looks, let(F.split(_cut(s, "LEEF:"), r"(?<!\\)\|"), _leef))


def _leef(parts: Column) -> Column:
    part = lambda i: F.get(parts, F.lit(i))
    version = F.replace(part(0), F.lit("LEEF:"), F.lit(""))
    own_mark = version.startswith("2.") & (F.size(parts) >= 7)
    mark = F.when(own_mark & (part(5) != ""), part(5)).otherwise("\t")
    extension = F.array_join(F.slice(parts, F.when(own_mark, 7).otherwise(6), F.size(parts)), "|")
    tokens = F.filter(each_stripped(F.split(extension, F.concat(F.lit("\\Q"), mark, F.lit("\\E")))), lambda t: t.contains("="))
    keys = lambda ts: each_stripped(F.transform(ts, lambda t: F.substring_index(t, "=", 1)))
    values = lambda ts: each_stripped(F.transform(ts, lambda t: F.substring(t, F.instr(t, "=") + 1, F.length(t))))
    header = dict(leef_version=version, device_vendor=part(1), device_product=part(2), device_version=part(3), event_id=part(4))
    fields = let(tokens, lambda ts: mapped(F.concat(names(header), keys(ts)), F.concat(texts(header.values()), values(ts))))
    return F.when(F.size(parts) >= 6, let(fields, lambda f: parsed("LEEF", "leef_parser", f, ts_raw=truthy_first(f, "devTime", "calmTime"))))


def syslog_lines(raw: Column) -> Column:
    """RFC 5424, RFC 3164 with a priority, and Cisco lines, tried in that order; bodies of several lines fit none."""
    return read_syslog(strip(raw))


def read_syslog(s: Column) -> Column:
    looks = (s.startswith("<") & F.substring(s, 1, 5).contains(">")) | (s.startswith("%") & s.contains(":")) | s.rlike(r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+.*:")
    ints = types_of(syslog_pri="int", syslog_facility="int", syslog_severity="int")

    def ranks(pri: Column) -> dict[str, Column]:
        n = pri.try_cast("int")
        return {"syslog_pri": n, "syslog_facility": F.floor(n / 8), "syslog_severity": n % 8}

    def new(g: Callable[[int], Column]) -> Column:
        fields = map_of(**ranks(g(1)), syslog_version=g(2), hostname=g(4), app_name=g(5), procid=g(6), msgid=g(7), message=g(8))
        return parsed("SYSLOG_RFC5424", "syslog_parser", fields, ints, g(3))

    def old(g: Callable[[int], Column]) -> Column:
        fields = map_of(**ranks(g(1)), hostname=g(3), app_name=g(4), pid=F.when(g(5) != "", g(5)), message=g(6))
        return parsed("SYSLOG_RFC3164", "syslog_parser", fields, ints, g(2))

    def cisco(g: Callable[[int], Column]) -> Column:
        flow = F.map_filter(F.map_from_arrays(names(CISCO_NAMES), fields_of(g(5), rf"(?s)^.*?{CISCO_FLOW}.*$", len(CISCO_NAMES))), lambda _, v: v != "")
        head = F.map_concat(F.when(g(1) != "", map_of(**ranks(g(1)))).otherwise(map_of(syslog_severity=g(3))), map_of(facility=g(2), mnemonic=g(4), message=g(5)))
        return parsed("SYSLOG_CISCO", "syslog_parser", F.map_concat(head, F.coalesce(flow, F.create_map().cast("map<string,string>"))), ints)

    def of(pattern: str, n: int, build: Callable[[Callable[[int], Column]], Column]) -> Column:
        return let(fields_of(s, pattern, n), lambda a: F.when(a.isNotNull(), build(lambda i: F.get(a, F.lit(i - 1)))))

    return F.when(looks, F.coalesce(of(RFC5424, 8, new), of(RFC3164, 6, old), of(CISCO, 5, cisco)))


def audit_lines(raw: Column) -> Column:
    return read_audit(strip(raw))


def read_audit(s: Column) -> Column:
    looks = s.startswith("type=") & s.contains("msg=audit(")

    def build(base: Column) -> Column:
        status = F.when(base["success"].isNotNull(), F.when(F.lower(base["success"]).isin("yes", "1"), "success").otherwise("failure"))
        extra = dict(process_name=base["comm"], executable_path=base["exe"], status=status)
        more = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in extra.items()]))
        fields = mapped(F.concat(F.map_keys(base), more), F.concat(F.map_values(base), F.array_compact(F.array(*extra.values()))))
        kinds = F.when(base["pid"].rlike(r"^\d+$"), types_of(pid="int")).otherwise(F.create_map().cast("map<string,string>"))
        return parsed("AUDITD", "auditd_parser", fields, kinds, base["event_time_epoch"])

    def of(a: Column) -> Column:
        g = lambda i: F.get(a, F.lit(i - 1))
        base = let(matches(g(4), AUDIT_PAIR), lambda m: mapped(F.concat(names(("audit_type", "audit_id", "event_time_epoch")), m["keys"]), F.concat(F.array(g(1), g(3), g(2)), m["values"])))
        return F.when(a.isNotNull(), let(base, build))

    return F.when(looks, let(fields_of(s, AUDIT_HEAD, 4), of))


def kv_lines(raw: Column) -> Column:
    """Three pairs or more."""
    return read_kv(strip(raw))


def read_kv(s: Column) -> Column:
    def build(m: Column) -> Column:
        fields = mapped(m["keys"], each_stripped(m["values"]))
        return F.when(F.size(m["keys"]) >= 3, let(fields, lambda f: parsed("KEY_VALUE", "keyvalue_parser", f, ts_raw=F.coalesce(*[f[k] for k in KV_TIME_KEYS]))))

    return F.when(s.contains("=") | s.contains(":"), let(matches(s, KV_PAIR, (2, 3, 4)), build))


def fallback_lines(raw: Column) -> Column:
    """Tokens of any text: addresses, ports, MACs, hex codes, a user and an action word."""
    return let(strip(raw), read_text)


def read_text(s: Column) -> Column:
    all_of = lambda p, g=0: F.regexp_extract_all(s, F.lit(p), F.lit(g))
    user = F.regexp_extract_all(s, F.lit(USER), F.lit(1))
    tokens = F.struct(F.lower(s).alias("low"), all_of(IPV4).alias("ips"), all_of(MAC).alias("macs"), all_of(HEX).alias("codes"), all_of(PORT, 1).alias("digits"), F.get(user, F.lit(0)).alias("user"))
    return let(tokens, lambda t: _tokens(s, t, F.filter(F.transform(t["digits"], lambda p: p.cast("int")), lambda p: p.between(1, 65535))))


def _tokens(s: Column, t: Column, ports: Column) -> Column:
    """parsed() of what was found in a line, so that it is looked for once."""
    low, ips = t["low"], t["ips"]
    one, two = F.size(ips) == 1, F.size(ips) >= 2
    named = contains_any(low, ("from", "src", "client", "host"))
    listed = lambda a: F.when(F.size(a) > 0, F.to_json(a))
    act = F.when(contains_any(low, DENY_WORDS), "deny").when(contains_any(low, ALLOW_WORDS), "allow")
    found = map_of(
        detected_ips=listed(ips), src_ip=F.when(two | (one & named), F.get(ips, F.lit(0))), ip=F.when(one & ~named, F.get(ips, F.lit(0))), dst_ip=F.when(two, F.get(ips, F.lit(1))),
        detected_ports=F.when(F.size(t["digits"]) > 0, F.to_json(ports)), dst_port=F.get(ports, F.lit(0)), detected_macs=listed(t["macs"]), hex_codes=listed(t["codes"]),
        user_name=t["user"], action=act,
    )
    fields = F.map_filter(found, lambda _, v: v.isNotNull())
    notes = F.concat(F.array(F.lit("Parsed using generic fallback token extraction")), F.when(two, F.array(F.lit("Inferred source and destination IPs positionally from unstructured text"))).otherwise(F.array().cast("array<string>")))
    kinds = types_of(detected_ips="list", detected_ports="list", detected_macs="list", hex_codes="list", dst_port="int")
    return parsed("GENERIC_FALLBACK", "generic_fallback", fields, kinds, group(s, STAMP, 0), False, notes, F.array(F.lit("WARN_GENERIC_FALLBACK_APPLIED")))


@dataclass(frozen=True)
class Parser:
    """A format: its name, its priority (higher first) and its expression, null for other lines; read is the same for lines
    that are stripped already, if there is a shorter one."""

    name: str
    priority: int
    parse: Callable[[Column], Column]
    read: Callable[[Column], Column] | None = None


BUILT_IN = (
    Parser("json_fast_parser", 90, json_lines, read_json),
    Parser("cef_parser", 85, cef_lines, read_cef),
    Parser("leef_parser", 84, leef_lines, read_leef),
    Parser("syslog_parser", 80, syslog_lines, read_syslog),
    Parser("auditd_parser", 75, audit_lines, read_audit),
    Parser("keyvalue_parser", 70, kv_lines, read_kv),
)


class Registry:
    """Parsers by priority; equal priorities keep the order of registration, an equal name replaces."""

    def __init__(self, parsers: tuple[Parser, ...] = BUILT_IN) -> None:
        self._parsers: list[Parser] = []
        for p in parsers:
            self.register(p)

    def register(self, parser: Parser) -> None:
        kept = [p for p in self._parsers if p.name != parser.name]
        self._parsers = sorted([*kept, parser], key=lambda p: -p.priority)

    def get(self, name: str) -> Parser | None:
        return next((p for p in self._parsers if p.name == name), None)

    def names(self) -> list[str]:
        return [p.name for p in self._parsers]

    def parsers(self) -> tuple[Parser, ...]:
        return tuple(self._parsers)

    def priorities(self) -> dict[str, int]:
        return {p.name: p.priority for p in self._parsers}

    def load(self, folder: str) -> list[str]:
        """Registers every Parser that a module of the folder defines (files with a leading __ left out); gives the
        names of files that could not be imported."""
        failed = []
        for path in sorted(Path(folder).glob("[!_]*.py")):
            spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
            except Exception:  # a broken plug-in must not keep the others out
                failed.append(path.name)
                continue
            for value in vars(module).values():
                if isinstance(value, Parser):
                    self.register(value)
        return failed

    def detect(self, raw: Column, stripped: bool = False) -> Column:
        """The first parser that takes the line; null if none does."""
        return F.coalesce(*[((stripped and p.read) or p.parse)(raw) for p in self._parsers])

    def dispatch(self, raw: Column, stripped: bool = False) -> Column:
        """As detect(), the fallback taking what is left."""
        return F.coalesce(self.detect(raw, stripped), (read_text if stripped else fallback_lines)(raw))
