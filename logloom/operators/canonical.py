"""From parsed lines to canonical security events: alias mapping, threat tags, confidence, routing, flat table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.functions.text import contains_any, let, strip
from logloom.operators.learn import apply_rules
from logloom.operators.parsers import Parser, Registry

#: Aliases of each canonical field; the first value that isn't empty wins.
ALIASES = {
    "src_ip": ("src_endpoint.ip", "src_ip", "src", "c_ip", "client_ip", "s_ip"),
    "dst_ip": ("dst_endpoint.ip", "dst_ip", "dst", "server_ip", "d_ip"),
    "src_port": ("src_endpoint.port", "src_port", "spt", "sport"),
    "dst_port": ("dst_endpoint.port", "dst_port", "dpt", "dport", "port"),
    "protocol": ("network_transport", "proto", "protocol"),
    "action": ("event.action", "action", "act"),
    "severity": ("severity", "syslog_severity"),
    "status": ("status", "result"),
    "user": ("actor.user_name", "user_name", "user", "usr", "duser", "suser"),
    "process": ("process.name", "process_name", "app_name", "comm"),
    "pid": ("pid", "procid"),
    "hostname": ("hostname", "device_host"),
    "vendor": ("device_vendor", "vendor"),
    "product": ("device_product", "product"),
}
#: Fields that are taken before the category is inferred from what is left.
EARLY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "severity", "status")
AUTH_WORDS = ("login", "auth", "passwd", "password", "session")
SHELL_WORDS = ("ncat", "nc -e", "/bin/sh", "cmd.exe", "/bin/bash")
SECRET_WORDS = ("secretretrieved", "vault", "password", "shadow")
#: Keys whose texts count as addresses, ports and times in the field score.
SCORED_IPS = ("src_ip", "dst_ip", "src", "dst", "client_ip", "server_ip", "ip", "src_endpoint_ip", "dst_endpoint_ip", "c_ip", "s_ip", "d_ip")
SCORED_PORTS = ("src_port", "dst_port", "spt", "dpt", "port", "dstPort", "srcPort", "src_endpoint_port", "dst_endpoint_port")
SCORED_TIMES = ("timestamp", "time", "date", "@timestamp", "event_time", "rt", "devTime", "calmTime", "start", "end", "datetime")
#: Id, name, tactic and risk of the tags.
TAGS = {
    "shell": ("T1059.004", "Unix Shell / Command Execution", "Execution", 90),
    "probe": ("T1110", "Brute Force / Lateral Probe", "Credential Access", 75),
    "secrets": ("T1555", "Credentials from Password Stores", "Credential Access", 80),
    "channel": ("T1071.001", "Web Protocols / C2 Channel", "Command and Control", 70),
    "shares": ("T1021.002", "SMB / Windows Admin Shares", "Lateral Movement", 65),
}


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and the reference date, which stands in for the clock so that runs repeat."""

    auto_accept: float = 0.85
    review_below: float = 0.60
    today: str = "2026-01-01"
    ipv6: bool = True
    free_form_dates: bool = False


#: A line that may be a number that is zero, false, or an empty list. A number that is zero has a 0 first, or behind
#: a sign or dot, or is too small to tell.
NOTHING = r"(?dm)^[^!-~]*[+-]?\.?0|[eE]-|^false$|^\[\]$"


def given(fields: Column, kinds: Column) -> Column:
    """The fields that count as given: no null, no empty text, no false, no zero that was a number, no empty list."""

    def counts(k: Column, v: Column) -> Column:
        zero = kinds[k].isin("int", "float") & (F.coalesce(v.try_cast("double"), F.lit(1.0)) == 0)
        empty = zero | ((kinds[k] == "bool") & (v == "false")) | ((kinds[k] == "list") & (v == "[]"))
        return v.isNotNull() & (v != "") & (kinds[k].isNull() | ~empty)

    # none of them empty or null, and texts alone or nothing that may be spelt zero, false or []: nothing to look at one by one
    bare = (F.size(kinds) == 0) | ~F.array_join(F.map_values(fields), "\n").rlike(NOTHING)
    full = F.coalesce(~F.array_contains(F.map_values(fields), ""), F.lit(False)) & bare
    return F.when(full, fields).otherwise(F.map_filter(fields, counts))


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each of which may use those before it."""
    for name, value in columns.items():
        df = df.select("*", value.alias(name))
    return df


def beside(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, all of them from its own. Spark keeps a projection apart where columns are used more than once;
    apart() above keeps filters off."""
    return df.select("*", *[v.alias(k) for k, v in columns.items()])


def small(value: Column) -> Column:
    """value, beside a lambda that does nothing: Spark compiles an operator without one as a single method, which the JVM walks
    through byte by byte if it is longer than 8,000 bytes; an operator with one becomes many small methods. What value uses more
    than once must be a column, as no common parts are found inside."""
    return F.when(F.exists(F.array(F.lit(True)), lambda x: x), value)


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """As beside(), for columns that no filter is pushed below, because they ask for the partition. Those that nobody needs
    are left out, which they would not be if they went through bind()."""
    return beside(df, **{k: F.when(F.spark_partition_id() >= 0, small(v)) for k, v in columns.items()})


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: they go through the one row of a generator, which Spark neither merges with
    what stands above nor repeats in a pushed-down filter, as it would for a projection. The value itself is a projection's
    column, because Spark compiles those, while a generator's argument is walked through node by node."""
    for name, value in columns.items():
        held = f"__{name}"
        df = df.select("*", value.alias(held)).select("*", F.explode_outer(F.array(held)).alias(name)).drop(held)
    return df


def _taken(name: str, g: Column) -> Column:
    """The aliases consumed up to the first that is given (all, if none is)."""
    keys = ALIASES[name]
    upto = lambda i: F.array(*[F.lit(k) for k in keys[: i + 1]])
    return F.coalesce(*[F.when(g[k].isNotNull(), upto(i)) for i, k in enumerate(keys[:-1])], upto(len(keys)))


def _note(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def normalize(lines: DataFrame, registry: Registry | None = None, config: EngineConfig | None = None, raw_col: str = "raw", rules: DataFrame | None = None) -> DataFrame:
    """lines with `event`, the canonical record, added; blank lines give a record with ERR_EMPTY_LOG alone.

    rules, a rule table (learn.RULES), reads lines that no parser takes, and verified ones key-value lines too.

    One narrow stage without a shuffle: parse, pick aliases, normalise, tag, score. What is parsed, picked and normalised
    is computed once a row (bind); what comes after are plain columns, which Spark leaves out where nothing asks for
    them. All columns of lines are kept, whatever their
    names (they are called otherwise on the way); only one called `event` is replaced.
    """
    registry, config = registry or Registry(), config or EngineConfig()
    df, kept = given_lines(lines, raw_col)
    if rules is None:
        return canonical(parsed_lines(df, registry, whole=True), kept, config)
    return canonical(apply_rules(parsed_lines(df, registry), rules, registry.priorities()), kept, config)


def given_lines(lines: DataFrame, raw_col: str) -> tuple[DataFrame, dict[str, str]]:
    """(lines with raw_log, the stripped line, and all their columns under other names, what those are called at last)."""
    kept = {f"__kept_{i}": c for i, c in enumerate(lines.columns) if c.lower() != "event"}
    return lines.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], strip(F.col(raw_col)).alias("raw_log")), kept


def canonical(df: DataFrame, kept: dict[str, str], config: EngineConfig) -> DataFrame:
    """As normalize(), for rows with raw_log and a parsed struct p; kept: columns that stay, and what they are called at last."""
    stages, event = _stages(df.sparkSession.sparkContext.applicationId, config)
    for add, columns in stages:
        df = add(df, **columns)
    return df.select(*kept, event.alias("event")).select(*[F.col(k).alias(c) for k, c in kept.items()], "event")


@lru_cache(maxsize=32)
def _parsed(application: str, parsers: tuple[Parser, ...], whole: bool) -> Column:
    """The column of a registry's parsers over raw_log, with the fallback if whole; built once an application."""
    registry = Registry(parsers)
    return (registry.dispatch if whole else registry.detect)(F.col("raw_log"), stripped=True)


def parsed_lines(df: DataFrame, registry: Registry, whole: bool = False) -> DataFrame:
    """Rows with raw_log, and p, what the registry makes of it."""
    return bind(df, p=_parsed(df.sparkSession.sparkContext.applicationId, registry.parsers(), whole))


@lru_cache(maxsize=32)
def _stages(application: str, config: EngineConfig) -> tuple[list[tuple[Callable[..., DataFrame], dict[str, Column]]], Column]:
    """The columns between p and the event, in order, and the event. They are the same for every table, and to build them takes
    thousands of calls into the JVM, so it is done once an application and configuration."""
    stages: list = []
    put = lambda add, **columns: stages.append((add, columns))
    fields, kinds = F.col("p.fields"), F.col("p.types")
    # Operators that hold a lambda are compiled as many small methods, others as one, which the JVM does not compile beyond
    # 8,000 bytes. So what is large stands beside a lambda, and what can be compiled does not stand inside of one.
    put(beside, g=given(fields, kinds), ips=_texts(SCORED_IPS, fields, kinds), ports=_texts(SCORED_PORTS, fields, kinds, no_texts=True))
    g = F.col("g")
    put(beside, **{f"x_{name}": F.coalesce(*[g[k] for k in keys]) for name, keys in ALIASES.items()}, x_ips=F.array_compact("ips"), x_ports=F.array_compact("ports"))
    x = lambda k: F.col(f"x_{k}")

    # columns of their own: an address is referred to a dozen times further on, and the list would be read as often
    put(beside, detected=F.when(x("src_ip").isNull() & x("dst_ip").isNull() & fields["detected_ips"].isNotNull(), F.from_json(fields["detected_ips"], "array<string>")))
    detected = F.col("detected")
    rescued = detected.isNotNull()
    time_text = F.coalesce(F.when(F.col("p.ts_raw") != "", F.col("p.ts_raw")), *[g[k] for k in ("timestamp", "time", "date")])
    put(beside, time_text=time_text, src_raw=F.when(rescued, F.get(detected, F.lit(0))).otherwise(x("src_ip")), dst_raw=F.when(rescued & (F.size(detected) >= 2), F.get(detected, F.lit(1))).otherwise(x("dst_ip")))
    put(beside, src_bare=strip(F.col("src_raw")), dst_bare=strip(F.col("dst_raw")), words=F.lower(F.concat_ws(" ", F.map_keys(fields), F.map_values(fields))))
    untaken = lambda names: F.array_except(F.map_keys(fields), F.flatten(F.array(*[_taken(n, g) for n in names])))
    # a word that no key or value holds need not be looked for one by one
    held = contains_any(F.col("words"), AUTH_WORDS)
    said = lambda keys: F.exists(keys, lambda k: contains_any(F.lower(F.concat_ws(" ", k, fields[k])), AUTH_WORDS))
    put(
        beside, time=small(N.time_text(F.col("time_text"))), src_text=small(N.without_port(F.col("src_bare"))), dst_text=small(N.without_port(F.col("dst_bare"))),
        ambiguous=F.coalesce(rescued & (F.size(detected) >= 2), F.lit(False)), left_early=small(F.when(held, untaken(EARLY))), low=F.lower(F.col("raw_log")),
    )
    put(
        beside, m_time=N.time_found(F.col("time"), config.today, config.free_form_dates), m_said=F.when(F.size("left_early") > 0, said(F.col("left_early"))),
        **{f"m_{side}_{v}": f(F.col(f"{side}_text")) for side in ("src", "dst") for f, v in ((N.v4_number, "v4"), *(((N.v6_found, "v6"),) if config.ipv6 else ()))},
        m_src_port=N.port(x("src_port")), m_dst_port=N.port(x("dst_port")), m_protocol=F.lower(x("protocol")), m_action=N.action(x("action")), m_severity=N.severity(x("severity")), m_status=N.status(x("status")),
    )
    m = lambda k: F.col(f"m_{k}")
    put(
        apart, c_ts=N.stamped(F.col("time"), m("time"), config.today),
        **{f"c_{side}": N.classified(F.col(f"{side}_text"), m(f"{side}_v4"), m(f"{side}_v6") if config.ipv6 else None) for side in ("src", "dst")},
        **{f"c_{k}": m(k) for k in ("src_port", "dst_port", "protocol", "action", "severity", "status")},
    )
    c = lambda k: F.col(f"c_{k}")
    put(step, direction=N.direction(c("src.is_private"), c("dst.is_private")))

    said = m("said")
    run = F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(k) for k in ("comm", "pid", "exe", "process")]))
    met = c("src.ip").isNotNull() | c("dst.ip").isNotNull() | c("protocol").isNotNull()
    secure = F.col("p.format").isin("AUDITD", "CEF", "LEEF")
    category = F.when(secure, "security").when(run, "system").when(said, "authentication").when(met, "network").otherwise("unknown")
    kind = F.when(run, "process_activity").when(said, "login").when(met, "connection").otherwise("generic")
    put(step, category=category, kind=kind, tag=threat(F.col("low"), c("action"), F.col("direction"), c("dst_port")))

    whole = lambda name, value: x(name).isNotNull() & value.isNull() & x(name).try_cast("bigint").isNull()
    warnings = F.concat(
        F.col("p.warnings"),
        _note(~c("ts.ok") & F.col("time_text").isNotNull(), F.concat(F.lit("Unparseable timestamp: "), F.col("time_text"))),
        _note(F.col("src_raw").isNotNull() & c("src.ip").isNull(), F.concat(F.lit("Malformed source IP: "), F.col("src_raw"))),
        _note(F.col("dst_raw").isNotNull() & c("dst.ip").isNull(), F.concat(F.lit("Malformed destination IP: "), F.col("dst_raw"))),
        _note(whole("src_port", c("src_port")), F.concat(F.lit("Invalid src_port: "), x("src_port"))),
        _note(whole("dst_port", c("dst_port")), F.concat(F.lit("Invalid dst_port: "), x("dst_port"))),
    )
    errors = F.concat(
        F.col("p.errors"),
        _note(~c("ts.ok") & F.col("time_text").isNotNull(), F.lit("ERR_UNPARSEABLE_TIMESTAMP")),
        _note(F.col("src_raw").isNotNull() & c("src.ip").isNull(), F.lit("ERR_INVALID_SRC_IP")),
        _note(F.col("dst_raw").isNotNull() & c("dst.ip").isNull(), F.lit("ERR_INVALID_DST_IP")),
    )
    put(step, warnings=warnings, errors=errors)
    put(step, scores=F.struct(
        format_score(F.col("p.format"), F.col("p.exact")).alias("format_confidence"),
        field_score(fields, x("ips"), x("ports"), g).alias("field_extraction_confidence"),
        schema_score(F.col("time_text"), F.col("category"), c("action"), c("src.ip"), c("dst.ip"), F.coalesce(x("hostname"), x("vendor"), x("process"), x("user")), F.col("ambiguous")).alias("schema_mapping_confidence"),
    ))
    overall = 0.25 * F.col("scores.format_confidence") + 0.35 * F.col("scores.field_extraction_confidence") + 0.40 * F.col("scores.schema_mapping_confidence")
    score_notes = F.concat(
        _field_notes(fields, x("ips"), x("ports"), g),
        _note(F.col("ambiguous"), F.lit("Ambiguous network direction: source and destination inferred by heuristic")),
    )
    none = lambda kind="string": F.lit(None).cast(kind)
    endpoint = lambda side: F.struct(c(f"{side}.ip").alias("ip"), c(f"{side}_port").alias("port"), none().alias("mac"), none().alias("domain"), c(f"{side}.is_private").alias("is_private"), none("struct<country:string,city:string,lat:double,lon:double>").alias("geo"))
    # a struct of columns and constants alone, so that whoever needs a few of its fields computes those alone: Spark would
    # build the whole of it for two fields that are more than that
    leaves: dict[str, Column] = {}

    def leaf(value: Column) -> Column:
        leaves[f"e_{len(leaves)}"] = value
        return F.col(f"e_{len(leaves) - 1}")

    blank = F.coalesce(F.col("raw_log"), F.lit("")) == ""
    unless = lambda value, other=None: leaf(F.when(~blank, value) if other is None else F.when(blank, other).otherwise(value))
    event = F.struct(
        F.struct(F.col("category"), F.col("kind").alias("type"), c("action").alias("action"), c("severity").alias("severity"), c("status").alias("status")).alias("event"),
        F.struct(F.col("time_text").alias("raw"), unless(c("ts.iso")).alias("normalized"), unless(c("ts.epoch_us")).alias("epoch_us"), c("ts.timezone").alias("timezone"), unless(F.timestamp_micros(c("ts.epoch_us"))).alias("ts"), unless(c("ts.ok"), F.lit(False)).alias("ok")).alias("timestamp"),
        F.struct(x("hostname").alias("hostname"), x("vendor").alias("vendor"), x("product").alias("product"), none().alias("version"), none().alias("ip")).alias("device"),
        endpoint("src").alias("src_endpoint"), endpoint("dst").alias("dst_endpoint"),
        F.struct(c("protocol").alias("protocol"), none("bigint").alias("bytes_in"), none("bigint").alias("bytes_out"), F.col("direction").alias("direction")).alias("network"),
        F.struct(x("user").alias("user_name"), none().alias("user_domain"), none().alias("user_id")).alias("actor"),
        F.struct(leaf(x("pid").try_cast("int")).alias("pid"), x("process").alias("name"), none().alias("executable_path"), none().alias("command_line"), none("int").alias("parent_pid")).alias("process"),
        F.struct(F.col("tag.id").alias("mitre_technique_id"), F.col("tag.name").alias("mitre_technique_name"), F.col("tag.tactic").alias("tactic"), unless(F.coalesce(F.col("tag.risk"), F.lit(15)), F.lit(0)).alias("risk_score")).alias("threat_intel"),
        leaf(F.coalesce("raw_log", F.lit(""))).alias("raw_log"),
        leaf(F.map_from_entries(F.transform(untaken(ALIASES), lambda k: F.struct(k.alias("key"), fields[k].alias("value"))))).alias("unmapped"),
        F.struct(
            unless(F.col("p.format"), F.lit("UNKNOWN")).alias("format_detected"), unless(F.col("p.parser"), F.lit("NONE")).alias("parser_used"), leaf(~blank & (F.col("p.parser") == "jit_inferred")).alias("inference_used"),
            F.struct(unless(overall, F.lit(0.0)).alias("overall_exact"), unless(F.round(overall, 3), F.lit(0.0)).alias("overall_confidence"), *[unless(F.round(f"scores.{k}", 3), F.lit(0.0)).alias(k) for k in ("format_confidence", "field_extraction_confidence", "schema_mapping_confidence")]).alias("confidence"),
            unless(F.concat("warnings", score_notes), F.array().cast("array<string>")).alias("warnings"), unless(F.col("errors"), F.array(F.lit("ERR_EMPTY_LOG"))).alias("error_codes"), fields.alias("extracted"),
        ).alias("processing_metadata"),
    )
    put(beside, **leaves)
    put(bind, above=F.lit(True))  # Spark would merge the leaves into the event
    return stages, event


def threat(low: Column, action: Column, direction: Column, dst_port: Column) -> Column:
    """struct<id, name, tactic, risk> of the first tag that fits, else null; low is the lower-cased line."""
    tag = lambda k: F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "name", "tactic", "risk"), TAGS[k], strict=True)])
    return (
        F.when(contains_any(low, SHELL_WORDS), tag("shell"))
        .when((action == "deny") & dst_port.isin(22, 3389, 445), tag("probe"))
        .when(contains_any(low, SECRET_WORDS), tag("secrets"))
        .when((direction == "outbound") & dst_port.isin(4444, 1337, 8080, 9092), tag("channel"))
        .when((direction == "internal") & dst_port.isin(445, 139), tag("shares"))
    )


def format_score(fmt: Column, exact: Column) -> Column:
    return (
        F.when(fmt == "JSON", F.when(exact, 1.0).otherwise(0.8))
        .when(fmt.isin("CEF", "LEEF"), F.when(exact, 0.98).otherwise(0.75))
        .when(fmt.contains("SYSLOG"), F.when(exact, 0.95).otherwise(0.70))
        .when(fmt == "AUDITD", F.when(exact, 0.92).otherwise(0.70))
        .when(fmt == "KEY_VALUE", 0.85).when(fmt == "JIT_INFERRED", 0.80).when(fmt == "GENERIC_FALLBACK", 0.35).otherwise(0.20)
    )


def _ip_text(v: Column) -> Column:
    s = F.regexp_replace(strip(v), r"^[\[\]\"']+|[\[\]\"']+$", "")
    s = F.when(s.contains(":") & s.contains("."), F.split_part(s, F.lit(":"), F.lit(1))).otherwise(s)
    return F.split_part(s, F.lit("/"), F.lit(1))


def _texts(keys: tuple[str, ...], fields: Column, kinds: Column, no_texts: bool = False) -> Column:
    """Values of the keys, null but for given texts, or with no_texts for anything but null."""
    fits = (lambda k: F.coalesce(kinds[k], F.lit("")) != "null") if no_texts else (lambda k: kinds[k].isNull() & (fields[k] != ""))
    return F.array(*[F.when(fits(k), fields[k]) for k in keys])


def _fine_ip(v: Column) -> Column:
    return v.rlike(N.V4) | N.v4_number(_ip_text(v)).isNotNull() | _ip_text(v).rlike(r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$")


def _port_number(v: Column) -> Column:
    return F.split_part(v, F.lit("/"), F.lit(1)).try_cast("bigint")


def _timed(g: Column) -> Column:
    return F.arrays_overlap(F.map_keys(g), F.array(*[F.lit(k) for k in SCORED_TIMES]))


def field_score(fields: Column, ips: Column, ports: Column, g: Column) -> Column:
    """Mean over the addresses, ports and one time check of the extracted fields; no fields at all: 0.1.

    ips, ports: texts of the scored keys; g: the fields that are given. IPv6 texts are judged by their form here.
    """
    grade = lambda v: F.when(_port_number(v).between(1, 65535), 1.0).when(_port_number(v).isNotNull(), 0.2).otherwise(0.0)
    total = F.size(F.filter(ips, _fine_ip)) + F.aggregate(ports, F.lit(0.0), lambda a, v: a + grade(v)) + F.when(_timed(g), 1.0).otherwise(0.3)
    return F.when(F.size(fields) == 0, 0.1).otherwise(F.least(F.lit(1.0), total / (F.size(ips) + F.size(ports) + 1)))


def _field_notes(fields: Column, ips: Column, ports: Column, g: Column) -> Column:
    bad_ips = F.transform(F.filter(ips, lambda v: ~_fine_ip(v)), lambda v: F.concat(F.lit("Invalid IP address format: "), v))
    bad_ports = F.transform(
        F.filter(ports, lambda v: ~F.coalesce(_port_number(v).between(1, 65535), F.lit(False))),
        lambda v: F.when(_port_number(v).isNull(), F.concat(F.lit("Non-integer port value: "), v)).otherwise(F.concat(F.lit("Port number out of valid range (1-65535): "), _port_number(v).cast("string"))),
    )
    none = F.array().cast("array<string>")
    return F.when(F.size(fields) == 0, none).otherwise(F.concat(bad_ips, bad_ports, _note(~_timed(g), F.lit("No explicit timestamp token found in raw payload"))))


def schema_score(time_text: Column, category: Column, action: Column, src: Column, dst: Column, who: Column, ambiguous: Column) -> Column:
    score = F.when(time_text.isNotNull(), 0.25).otherwise(0.10)
    score = score + F.when(category != "unknown", 0.20).otherwise(0.0) + F.when(action != "unknown", 0.15).otherwise(0.0)
    score = score + F.when(src.isNotNull() & dst.isNotNull(), 0.25).when(src.isNotNull() | dst.isNotNull(), 0.15).otherwise(0.0)
    score = score + F.when(who.isNotNull(), 0.15).otherwise(0.0)
    score = F.when(ambiguous, F.greatest(F.lit(0.2), score - 0.20)).otherwise(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


#: Columns of the flat analytics table, in order, with their place in the record.
FLAT = {
    "id": None, "created_time": None, "category": "event.category", "event_type": "event.type", "action": "event.action", "severity": "event.severity", "status": "event.status",
    "timestamp_raw": "timestamp.raw", "timestamp_normalized": "timestamp.normalized", "timestamp_epoch_us": "timestamp.epoch_us",
    "src_ip": "src_endpoint.ip", "src_port": "src_endpoint.port", "src_is_private": "src_endpoint.is_private", "dst_ip": "dst_endpoint.ip", "dst_port": "dst_endpoint.port", "dst_is_private": "dst_endpoint.is_private",
    "network_protocol": "network.protocol", "network_direction": "network.direction", "device_hostname": "device.hostname", "device_vendor": "device.vendor", "actor_user_name": "actor.user_name",
    "process_name": "process.name", "process_pid": "process.pid", "format_detected": "processing_metadata.format_detected", "parser_used": "processing_metadata.parser_used", "inference_used": "processing_metadata.inference_used",
    "latency_us": None, "confidence_overall": "processing_metadata.confidence.overall_confidence", "confidence_format": "processing_metadata.confidence.format_confidence",
    "confidence_field": "processing_metadata.confidence.field_extraction_confidence", "confidence_schema": "processing_metadata.confidence.schema_mapping_confidence",
    "raw_log": "raw_log", "unmapped_json": None, "error_codes_json": None, "mitre_id": "threat_intel.mitre_technique_id", "risk_score": "threat_intel.risk_score",
}


def flat(events: DataFrame, id_cols: tuple[str, ...] = (), created: str | None = None) -> DataFrame:
    """The 36 columns of the analytics table; ids are md5 of id_cols and the line, so a rerun gives the same ids."""
    own = {
        "id": F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in id_cols], "event.raw_log").cast("binary")),
        "created_time": F.lit(created).cast("string"),
        "latency_us": F.lit(None).cast("int"),
        "unmapped_json": F.to_json("event.unmapped"),
        "error_codes_json": F.to_json("event.processing_metadata.error_codes"),
    }
    return events.select(*[own[k].alias(k) if v is None else F.col(f"event.{v}").alias(k) for k, v in FLAT.items()])


def needs_review(events: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Events that go to review and dead letter besides the table: rounded confidence strictly below the threshold. Blank lines go nowhere."""
    score = F.col("event.processing_metadata.confidence.overall_confidence")
    return events.where((score < (config or EngineConfig()).review_below) & (F.col("event.raw_log") != ""))


def route_badge(parser: Column, inferred: Column) -> Column:
    return F.when(inferred, "cold").when(parser == "generic_fallback", "degraded").otherwise("hot")


__all__ = ["ALIASES", "EngineConfig", "FLAT", "canonical", "flat", "needs_review", "normalize", "route_badge"]
