"""Driver queries of the log engine, over lines that are derived from the events table, each with its SQL.

The SQL never parses lines: it derives what must come out from the columns that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import normalize as N
from logloom.operators import analytics as A
from logloom.operators import canonical as C
from logloom.operators import learn as L
from logloom.operators import multiline as M
from logloom.operators import parsers as P
from logloom.operators import review as R
from logloom.operators import search, splitters
from logloom.plans import batch
from logloom.sources import sinks
from logloom.sources.store import LatestTable
from logloom.sources.tables import read_lines, scratch, spread, synthetic, table, table_stream
from logloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Facts of an event's lines, in SQL that Spark and DuckDB share.
FACTS = {
    "src": "'10.' || cast(user_id % 50 as string) || '.' || cast(event_id % 250 as string) || '.' || cast(user_id % 200 + 1 as string)",
    "dst": "case when event_id % 3 = 0 then '8.8.' else '192.168.' end || cast(event_id % 250 as string) || '.' || cast(user_id % 200 + 1 as string)",
    "spt": "1024 + event_id % 60000",
    "dpt": "case event_id % 8 when 0 then 22 when 1 then 53 when 2 then 80 when 3 then 443 when 4 then 8080 when 5 then 3389 when 6 then 445 else 9092 end",
    "act": "case event_id % 4 when 0 then 'block' when 1 then 'drop' when 2 then 'permit' else 'teardown' end",
    "usr": "'u' || cast(user_id as string)",
    "sev": "event_id % 8",
}
#: What the facts come to in canonical form.
EXPECTED = {
    "action": "case event_id % 4 when 0 then 'deny' when 1 then 'drop' when 2 then 'allow' else 'unknown' end",
    "direction": "case when event_id % 3 = 0 then 'outbound' else 'internal' end",
    "severity": "case event_id % 8 when 0 then 'emergency' when 1 then 'alert' when 2 then 'critical' when 3 then 'error' when 4 then 'warning' when 5 then 'notice' when 6 then 'info' else 'debug' end",
}
_FACTS_SQL = ", ".join(f"{v} as {k}" for k, v in FACTS.items())
_EXPECTED_SQL = ", ".join(f"{v} as x_{k}" for k, v in EXPECTED.items())
E = f"with e as (select *, {_FACTS_SQL}, {_EXPECTED_SQL} from events)"

_MS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
#: Lines by format, in Spark SQL over the facts.
LINES = {
    "cef": f"concat('CEF:0|Acme|Wall|1.0|', event_id, '|', event_type, '|', sev, '|src=', src, ' dst=', dst, ' spt=', spt, ' dpt=', dpt, ' act=', act, ' rt=', {_MS}, ' suser=', usr)",
    "leef": f"concat('LEEF:2.0|Acme|Mail|4.0|', event_id, '|\\t', 'devTime=', {_ISO}, '\\tsrc=', src, '\\tdst=', dst, '\\tdpt=', dpt, '\\tusr=', usr)",
    "json": f"concat('{{\"timestamp\":\"', {_ISO}, '\",\"src_ip\":\"', src, '\",\"dst_ip\":\"', dst, '\",\"dst_port\":', dpt, ',\"action\":\"', act, '\",\"meta\":{{\"kind\":\"', event_type, '\",\"n\":', sev, '}}}}')",
    "rfc5424": f"concat('<', 128 + sev, '>1 ', {_ISO}, ' host', user_id % 20, ' router ', 1000 + event_id % 9000, ' ID', event_id % 50, ' - link ', event_type)",
    "rfc3164": "concat('<', 128 + sev, '>', date_format(ts, 'MMM d HH:mm:ss'), ' host', user_id % 20, ' sshd[', 1000 + event_id % 9000, ']: link ', event_type)",
    "cisco": "concat('%ASA-', sev, '-106023: ', case event_id % 3 when 0 then 'Deny' when 1 then 'Permit' else 'Built' end, ' tcp src outside:', src, '/', spt, ' dst inside:', dst, '/', dpt, ' by rule')",
    "auditd": f"concat('type=SYSCALL msg=audit(', floor({_MS} / 1000), '.', lpad({_MS} % 1000, 3, '0'), ':', event_id, '): success=', case when event_id % 2 = 0 then 'yes' else 'no' end, ' pid=', 1000 + event_id % 9000, ' comm=\"cron\" exe=\"/usr/sbin/cron\"')",
    "kv": f"concat('user=\"', usr, '\" src_ip=', src, ' dst_ip=', dst, ' action=''', act, ''' proto=TCP dport=', dpt, ' ts=', {_ISO})",
    "free": "concat('Connection from ', src, ' port ', dpt, ' to ', dst, ' code 0x', lower(hex(event_id)), case when event_id % 2 = 0 then ' blocked' else ' accepted' end)",
    "rare": "concat(event_type, ' request from ', src, ' port ', spt, ' state ', case when event_id % 2 = 0 then 'up' else 'down' end)",
}
MIXED = ("cef", "leef", "json", "rfc5424", "rfc3164", "cisco", "auditd", "kv", "free")
TODAY = "2024-12-31"
CONFIG = C.EngineConfig(today=TODAY)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").selectExpr("*", *[f"{v} as {k}" for k, v in FACTS.items()])


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return facts(spark, sf_dir).selectExpr("event_id", f"{LINES[kind]} as raw")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an event, its format by event_id modulo 9."""
    case = " ".join(f"when {i} then {LINES[k]}" for i, k in enumerate(MIXED))
    return facts(spark, sf_dir).selectExpr("event_id", f"case event_id % {len(MIXED)} {case} end as raw")


def flat(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    given = lines(spark, sf_dir, kind) if kind else mixed(spark, sf_dir)
    return C.flat(C.normalize(given, config=CONFIG), ("event_id",))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _extract(kind: str, parser: Callable, fields: dict[str, str]) -> Query:
    """Fields of a format's lines: column name to key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = lines(spark, sf_dir, kind).select("event_id", parser(F.col("raw")).alias("p"))
        return p.select("event_id", F.col("p.format").alias("format"), F.col("p.ts_raw").alias("ts_raw"), *[F.col("p.fields")[v].alias(k) for k, v in fields.items()])

    return run


_T = "cast({} as varchar)"
_ISO_DUCK = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
query("cef_extract", f"{E} select event_id, 'CEF' as format, {_T.format('(epoch_us(ts) // 1000)')} as ts_raw, src, dst, {_T.format('spt')} as spt, {_T.format('dpt')} as dpt, act, usr, event_type as event_name, {_T.format('sev')} as severity from e")(
    _extract("cef", P.cef_lines, {"src": "src", "dst": "dst", "spt": "spt", "dpt": "dpt", "act": "act", "usr": "suser", "event_name": "event_name", "severity": "severity"}))
query("leef_extract", f"{E} select event_id, 'LEEF' as format, {_ISO_DUCK} as ts_raw, src, dst, {_T.format('dpt')} as dpt, usr, 'Acme' as vendor from e")(
    _extract("leef", P.leef_lines, {"src": "src", "dst": "dst", "dpt": "dpt", "usr": "usr", "vendor": "device_vendor"}))
query("json_flatten", f"{E} select event_id, 'JSON' as format, {_ISO_DUCK} as ts_raw, src, dst, {_T.format('dpt')} as dpt, act, event_type as kind, {_T.format('sev')} as n from e")(
    _extract("json", P.json_lines, {"src": "src_ip", "dst": "dst_ip", "dpt": "dst_port", "act": "action", "kind": "meta.kind", "n": "meta.n"}))
query("syslog5424_extract", f"{E} select event_id, 'SYSLOG_RFC5424' as format, {_ISO_DUCK} as ts_raw, 'host' || (user_id % 20) as host, 'router' as app, {_T.format('1000 + event_id % 9000')} as procid, {_T.format('sev')} as severity, '16' as facility, '- link ' || event_type as message from e")(
    _extract("rfc5424", P.syslog_lines, {"host": "hostname", "app": "app_name", "procid": "procid", "severity": "syslog_severity", "facility": "syslog_facility", "message": "message"}))
query("syslog3164_extract", f"{E} select event_id, 'SYSLOG_RFC3164' as format, strftime(ts, '%b ') || day(ts) || strftime(ts, ' %H:%M:%S') as ts_raw, 'host' || (user_id % 20) as host, 'sshd' as app, {_T.format('1000 + event_id % 9000')} as pid, 'link ' || event_type as message from e")(
    _extract("rfc3164", P.syslog_lines, {"host": "hostname", "app": "app_name", "pid": "pid", "message": "message"}))
query("cisco_extract", f"{E} select event_id, 'SYSLOG_CISCO' as format, cast(null as varchar) as ts_raw, 'ASA' as facility, '106023' as mnemonic, src, dst, {_T.format('spt')} as spt, {_T.format('dpt')} as dpt, case event_id % 3 when 0 then 'Deny' when 1 then 'Permit' else 'Built' end as action, {_T.format('sev')} as severity from e")(
    _extract("cisco", P.syslog_lines, {"facility": "facility", "mnemonic": "mnemonic", "src": "src", "dst": "dst", "spt": "spt", "dpt": "dpt", "action": "action", "severity": "syslog_severity"}))
query("auditd_extract", f"{E} select event_id, 'AUDITD' as format, ((epoch_us(ts) // 1000) // 1000) || '.' || lpad(((epoch_us(ts) // 1000) % 1000)::varchar, 3, '0') as ts_raw, {_T.format('event_id')} as audit_id, {_T.format('1000 + event_id % 9000')} as pid, 'cron' as process, case when event_id % 2 = 0 then 'success' else 'failure' end as status from e")(
    _extract("auditd", P.audit_lines, {"audit_id": "audit_id", "pid": "pid", "process": "process_name", "status": "status"}))
query("kv_extract", f"{E} select event_id, 'KEY_VALUE' as format, {_ISO_DUCK} as ts_raw, usr, src, dst, act, {_T.format('dpt')} as dpt from e")(
    _extract("kv", P.kv_lines, {"usr": "user", "src": "src_ip", "dst": "dst_ip", "act": "action", "dpt": "dport"}))
query("fallback_extract", f"{E} select event_id, 'GENERIC_FALLBACK' as format, cast(null as varchar) as ts_raw, src, dst, {_T.format('dpt')} as dpt, '[\"0x' || lower(hex(event_id)) || '\"]' as codes, case when event_id % 2 = 0 then 'deny' else 'allow' end as act from e")(
    _extract("free", P.fallback_lines, {"src": "src_ip", "dst": "dst_ip", "dpt": "dst_port", "codes": "hex_codes", "act": "action"}))

_IP_DUCK = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"


@query("fallback_tokens", f"select doc_id, len(regexp_extract_all(text, '{_IP_DUCK}')) as n_ips, regexp_extract_all(text, '{_IP_DUCK}')[1] as first_ip from documents")
def fallback_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", P.fallback_lines(F.col("text")).alias("p"))
    ips = F.from_json(F.col("p.fields")["detected_ips"], "array<string>")
    return found.select("doc_id", F.coalesce(F.size(ips), F.lit(0)).cast("long").alias("n_ips"), F.get(ips, F.lit(0)).alias("first_ip"))


_FORMATS = "case event_id % 9 when 0 then 'CEF' when 1 then 'LEEF' when 2 then 'JSON' when 3 then 'SYSLOG_RFC5424' when 4 then 'SYSLOG_RFC3164' when 5 then 'SYSLOG_CISCO' when 6 then 'AUDITD' when 7 then 'KEY_VALUE' else 'GENERIC_FALLBACK' end"


@query("detect_format_counts", f"{E} select {_FORMATS} as format, count(*) as n from e group by all")
def detect_format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select(P.Registry().dispatch(F.col("raw"))["format"].alias("format")).groupBy("format").agg(F.count("*").alias("n"))


def _stamp(name: str, text: str, sql: str) -> None:
    @query(name, f"select event_id, {sql} as epoch_us, true as ok from events")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "events").selectExpr("event_id", f"{text} as raw").select("event_id", N.timestamp(F.col("raw"), TODAY).alias("t"))
        return t.select("event_id", "t.epoch_us", "t.ok")


_stamp("ts_epoch", f"case event_id % 3 when 0 then cast(floor({_MS} / 1000) as string) when 1 then cast({_MS} as string) else cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as string) end",
       "case event_id % 3 when 0 then (epoch_us(ts) // 1000) // 1000 * 1000000 when 1 then (epoch_us(ts) // 1000) * 1000 else epoch_us(ts) end")
_stamp("ts_iso", f"case when event_id % 2 = 0 then {_ISO} else date_format(ts, \"yyyy-MM-dd HH:mm:ss+02:00\") end", "case when event_id % 2 = 0 then epoch_us(ts) else epoch_us(date_trunc('second', ts)) - 7200000000 end")
_stamp("ts_apache", "date_format(ts, \"[d/MMM/yyyy:HH:mm:ss +0530]\")", "epoch_us(date_trunc('second', ts)) - 19800000000")
_stamp("ts_bsd", "date_format(ts, \"MMM  d HH:mm:ss\")", "epoch_us(date_trunc('second', ts))")


@query("ip_classify", f"{E} select event_id, case event_id % 5 when 4 then null else dst end as ip, case event_id % 5 when 4 then null else event_id % 3 <> 0 end as is_private from e")
def ip_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case event_id % 5 when 0 then dst when 1 then ' ' || dst || ' ' when 2 then dst || ':443' when 3 then dst else '999.1.2.3' end")
    return facts(spark, sf_dir).select("event_id", N.classify_ip(raw).alias("c")).select("event_id", "c.ip", "c.is_private")


@query("direction_counts", f"{E} select x_direction as direction, count(*) as n from e group by all")
def direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).select(N.direction(N.classify_ip(F.col("src"))["is_private"], N.classify_ip(F.col("dst"))["is_private"]).alias("direction"))
    return f.groupBy("direction").agg(F.count("*").alias("n"))


@query("action_norm", f"{E} select act as raw, x_action as action, count(*) as n from e group by all")
def action_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(F.col("act").alias("raw")).agg(F.count("*").alias("n")).select("raw", N.action(F.col("raw")).alias("action"), "n")


@query("severity_norm", f"{E} select event_id, x_severity as severity from e")
def severity_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("event_id", N.severity(F.col("sev").cast("string")).alias("severity"))


@query("status_norm", "select event_type, case event_type when 'error' then 'failure' else 'unknown' end as status, count(*) as n from events group by all")
def status_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", N.status(F.col("event_type")).alias("status")).agg(F.count("*").alias("n"))


@query("port_norm", "select event_id, case when event_id % 4 = 3 then null when (event_id * 7) % 70000 between 1 and 65535 then cast((event_id * 7) % 70000 as int) end as port from events")
def port_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case when event_id % 4 = 3 then 'http' else cast((event_id * 7) % 70000 as string) end")
    return table(spark, sf_dir, "events").select("event_id", N.port(raw).alias("port"))


_CATEGORY = "case event_id % 9 when 0 then 'security' when 1 then 'security' when 2 then 'network' when 3 then case when event_type like '%auth%' then 'authentication' else 'unknown' end when 4 then 'system' when 5 then 'network' when 6 then 'security' when 7 then 'network' else 'network' end"


@query("category_infer", f"{E} select event_id, {_CATEGORY} as category from e")
def category_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(mixed(spark, sf_dir), config=CONFIG).select("event_id", "event.event.category")


@query("alias_resolution", f"{E} select event_id, src as src_ip, dst as dst_ip, cast(null as int) as src_port, dpt as dst_port, usr as user_name from e")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.normalize(lines(spark, sf_dir, "kv"), config=CONFIG)
    return e.select("event_id", F.col("event.src_endpoint.ip").alias("src_ip"), F.col("event.dst_endpoint.ip").alias("dst_ip"), F.col("event.src_endpoint.port").alias("src_port"), F.col("event.dst_endpoint.port").alias("dst_port"), F.col("event.actor.user_name").alias("user_name"))


@query("unmapped_keys", "select key, (select count(*) from events) as n from (values ('cef_version'), ('device_version'), ('signature_id'), ('event_name'), ('rt')) t(key)")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.normalize(lines(spark, sf_dir, "cef"), config=CONFIG)
    return e.select(F.explode(F.map_keys("event.unmapped")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_TAG = "case when x_action = 'deny' and dpt in (22, 3389, 445) then 'T1110' when x_direction = 'outbound' and dpt in (8080, 9092) then 'T1071.001' when x_direction = 'internal' and dpt = 445 then 'T1021.002' end"
_RISK = f"case coalesce({_TAG}, '') when 'T1110' then 75 when 'T1071.001' then 70 when 'T1021.002' then 65 else 15 end"


@query("threat_tags", f"{E} select event_id, {_TAG} as mitre_id, {_RISK} as risk_score from e")
def threat_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "cef").select(F.regexp_extract("raw_log", r"1\.0\|(\d+)", 1).cast("long").alias("event_id"), "mitre_id", "risk_score")


_SCORES = {
    "conf_format": ("confidence_format", "case event_id % 9 when 0 then 0.98 when 1 then 0.98 when 2 then 1.0 when 3 then 0.95 when 4 then 0.95 when 5 then 0.95 when 6 then 0.92 when 7 then 0.85 else 0.35 end"),
    "conf_field": ("confidence_field", "case event_id % 9 when 3 then 0.3 when 4 then 0.3 when 5 then 0.86 when 6 then 0.3 when 7 then 0.767 when 8 then 0.825 else 1.0 end"),
    "conf_schema": ("confidence_schema", f"""case event_id % 9 when 0 then case when x_action = 'unknown' then 0.85 else 1.0 end when 1 then 0.85 when 2 then case when x_action = 'unknown' then 0.7 else 0.85 end
      when 3 then 0.4 when 4 then 0.6 when 5 then case when event_id % 3 = 2 then 0.55 else 0.7 end when 6 then 0.6 when 7 then case when x_action = 'unknown' then 0.85 else 1.0 end else 0.7 end"""),
}


@query("canonical_flat", rf"""{E}, r as (select *, 'CEF:0|Acme|Wall|1.0|' || event_id || '|' || event_type || '|' || sev || '|src=' || src || ' dst=' || dst || ' spt=' || spt || ' dpt=' || dpt || ' act=' || act || ' rt=' || (epoch_us(ts) // 1000) || ' suser=' || usr as raw_log from e)
select md5(event_id || chr(31) || raw_log) as id, cast(null as varchar) as created_time, 'security' as category, 'connection' as event_type, x_action as action, x_severity as severity, 'unknown' as status,
  cast((epoch_us(ts) // 1000) as varchar) as timestamp_raw, replace(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%f+00:00'), '.000000', '') as timestamp_normalized, (epoch_us(ts) // 1000) * 1000 as timestamp_epoch_us,
  src as src_ip, cast(spt as int) as src_port, true as src_is_private, dst as dst_ip, cast(dpt as int) as dst_port, event_id % 3 <> 0 as dst_is_private, cast(null as varchar) as network_protocol, x_direction as network_direction,
  cast(null as varchar) as device_hostname, 'Acme' as device_vendor, usr as actor_user_name, cast(null as varchar) as process_name, cast(null as int) as process_pid, 'CEF' as format_detected, 'cef_parser' as parser_used,
  false as inference_used, cast(null as int) as latency_us, case when x_action = 'unknown' then 0.935 else 0.995 end as confidence_overall, 0.98 as confidence_format, 1.0 as confidence_field,
  case when x_action = 'unknown' then 0.85 else 1.0 end as confidence_schema, raw_log,
  '{{"cef_version":"0","device_version":"1.0","signature_id":"' || event_id || '","event_name":"' || event_type || '","rt":"' || (epoch_us(ts) // 1000) || '"}}' as unmapped_json, '[]' as error_codes_json, {_TAG} as mitre_id, {_RISK} as risk_score from r""")
def canonical_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "cef")


def _scores() -> None:
    for name, (column, sql) in _SCORES.items():

        @query(name, f"{E} select event_id, cast({sql} as double) as score from e")
        def run(spark: SparkSession, sf_dir: str, key: str = column) -> DataFrame:
            path = {"confidence_format": "format_confidence", "confidence_field": "field_extraction_confidence", "confidence_schema": "schema_mapping_confidence"}[key]
            return C.normalize(mixed(spark, sf_dir), config=CONFIG).select("event_id", F.col(f"event.processing_metadata.confidence.{path}").alias("score"))


_scores()
_CEF_TABLE = f"{E}, t as (select *, case when x_action = 'unknown' then 0.935 else 0.995 end as confidence_overall from e)"


@query("conf_overall", f"{_CEF_TABLE} select confidence_overall, count(*) as n from t group by all")
def conf_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "cef").groupBy("confidence_overall").agg(F.count("*").alias("n"))


@query("route_review", f"{E} select event_id from e where event_id % 9 in (3, 4, 6) order by 1")
def route_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.needs_review(C.normalize(mixed(spark, sf_dir), config=CONFIG), CONFIG).select("event_id")


@query("dead_letter", f"{E} select 'host' || (user_id % 20) as host, count(*) as n from e group by all")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = sinks.dead_letters(C.normalize(lines(spark, sf_dir, "rfc5424"), config=CONFIG), CONFIG)
    return letters.groupBy(F.col("extracted_fields")["hostname"].alias("host")).agg(F.count("*").alias("n"))


@query("metrics_summary", f"{_CEF_TABLE} select count(*) as total_logs, round(avg(confidence_overall), 3) as avg_confidence, cast(null as double) as avg_latency_us, cast(0 as bigint) as inference_count, cast(count(*) as bigint) as auto_accepted, cast(0 as bigint) as needs_review from t")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.metrics(flat(spark, sf_dir, "cef"), CONFIG)


@query("format_distribution", f"{E} select {_FORMATS} as format_detected, count(*) as count from e group by all")
def format_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(flat(spark, sf_dir), "format_detected")


@query("action_distribution", f"{E} select x_action as action, count(*) as count from e group by all")
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(flat(spark, sf_dir, "cef"), "action")


@query("recent_search", f"{E} select event_id, src as src_ip, dst as dst_ip, dpt as dst_port from e where event_type = 'purchase' order by ts desc, event_id limit 25")
def recent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = C.normalize(lines(spark, sf_dir, "cef").join(facts(spark, sf_dir).select("event_id", "ts"), "event_id"), config=CONFIG)
    t = C.flat(events, ("event_id",)).withColumn("event_id", F.regexp_extract("raw_log", r"1\.0\|(\d+)", 1).cast("long"))
    found = A.holding(t, "|PURCHASE|").orderBy(F.desc("timestamp_epoch_us"), "event_id").limit(25)
    return found.select("event_id", "src_ip", "dst_ip", "dst_port")


@query("top_denied", f"{E} select src as src_ip, dst as dst_ip, cast(dpt as int) as dst_port, count(*) as count from e where x_action = 'deny' group by all order by count desc, src_ip, dst_ip, dst_port limit 10")
def top_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_denied(flat(spark, sf_dir, "cef"))


@query("lateral_probes", f"{E} select src as src_ip, dst as dst_ip, cast(dpt as int) as dst_port, x_action as action, count(*) as count from e where x_direction = 'internal' and dpt in (22, 3389, 445) group by all")
def lateral_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lateral_probes(flat(spark, sf_dir, "cef"))


@query("technique_breakdown", f"{E} select {_TAG} as mitre_id, {_RISK} as risk_score, x_action as action, count(*) as count from e where {_TAG} is not null group by all")
def technique_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.techniques(flat(spark, sf_dir, "cef"))


@query("format_confidence", f"{_CEF_TABLE} select 'CEF' as format_detected, count(*) as count, cast(null as double) as avg_latency_us, round(avg(confidence_overall), 2) as avg_confidence from t")
def format_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.format_latency(flat(spark, sf_dir, "cef"))


@query("route_badge", f"{E} select case when event_id % 9 = 8 then 'degraded' else 'hot' end as badge, count(*) as count from e group by all")
def route_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.badges(flat(spark, sf_dir))


@query("latency_percentiles", """with s as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events)
select min(value) as min, round(avg(value), 6) as avg, max(value) as max, max(value) filter (k = floor(n * 0.5)) as p50, max(value) filter (k = floor(n * 0.9)) as p90, max(value) filter (k = floor(n * 0.99)) as p99 from s""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_percentiles(table(spark, sf_dir, "events"), "value").withColumn("avg", F.round("avg", 6))


@query("accuracy_rates", f"{E} select 100.0::double as auto_accept_pct, 100.0::double as success_pct, 100.0::double as core_field_pct")
def accuracy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy(flat(spark, sf_dir, "cef"), CONFIG)


@query("format_share", f"{E} select {_FORMATS} as format_detected, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 2) as share from e group by all")
def format_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.format_share(flat(spark, sf_dir))


_OVERALL = f"round(0.25 * ({_SCORES['conf_format'][1]}) + 0.35 * ({_SCORES['conf_field'][1]}) + 0.40 * ({_SCORES['conf_schema'][1]}), 3)"
_MIXED_TABLE = f"{E}, t as (select *, cast({_OVERALL} as double) as overall from e)"


@query("metrics_mixed", f"{_MIXED_TABLE} select count(*) as total_logs, round(avg(overall), 3) as avg_confidence, cast(null as double) as avg_latency_us, cast(0 as bigint) as inference_count, cast(count(*) filter (overall >= 0.85) as bigint) as auto_accepted, cast(count(*) filter (overall < 0.6) as bigint) as needs_review from t")
def metrics_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.metrics(flat(spark, sf_dir), CONFIG)


@query("observed_metrics", f"{_MIXED_TABLE} select count(*) as total_logs, round(avg(overall), 3) as avg_confidence, cast(count(*) filter (overall >= 0.85) as bigint) as auto_accepted, cast(count(*) filter (overall < 0.6) as bigint) as needs_review, cast(0 as bigint) as n_blank, cast(count(*) filter (overall < 0.6) as bigint) as dead from t")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that come with the write of the table and the dead letters, and the dead letters read back."""
    at = scratch(spark, "observed")
    got = sinks.write_observed(C.normalize(mixed(spark, sf_dir), config=CONFIG), f"{at}/table", f"{at}/dead", ("event_id",), CONFIG)
    columns = {"total_logs": "bigint", "avg_confidence": "double", "auto_accepted": "bigint", "needs_review": "bigint", "n_blank": "bigint"}
    return sinks.read_dead_letters(spark, f"{at}/dead").agg(F.count("*").alias("dead")).select(*[F.lit(got[k]).cast(t).alias(k) for k, t in columns.items()], "dead")


@query("accuracy_mixed", f"{_MIXED_TABLE} select round(100.0 * count(*) filter (overall >= 0.85) / count(*), 2)::double as auto_accept_pct, 100.0::double as success_pct, round(100.0 * count(*) filter (event_id % 9 not in (3, 4, 6)) / count(*), 2)::double as core_field_pct from t")
def accuracy_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both syslog kinds and of auditd name neither an address nor a user."""
    return A.accuracy(flat(spark, sf_dir), CONFIG)


_RULED = {
    0: "concat('CEF:0|Acme|Wall|1.0|', event_id, '|', event_type, '|5|src=', src, ' dst=', dst, ' act=permit msg=cmd.exe')",
    1: "concat('src_ip=', src, ' dst_ip=', dst, ' target=vault action=permit proto=TCP')",
    2: "concat('{\"detected_ips\":[\"', src, '\",\"', dst, '\"],\"action\":\"permit\"}')",
    3: "concat('{\"src_ip\":\"999.1.1.', event_id % 250, '\",\"dst_ip\":\"', dst, '\",\"network_transport\":\"UDP\"}')",
    4: "concat('{\"process.name\":\"', event_type, '\",\"pid\":', 1000 + event_id % 9000, ',\"vendor\":\"Acme\",\"device_product\":\"Box\"}')",
    5: "concat('{\"hostname\":\"host', user_id % 20, '\",\"detected_ips\":[\"', src, '\"],\"procid\":\"none\"}')",
}
_K = "event_id % 6"


@query("mapping_rules", f"""{E} select event_id, case {_K} when 0 then 'T1059.004' when 1 then 'T1555' end as mitre_id, case {_K} when 0 then 90 when 1 then 80 else 15 end as risk_score,
  case when {_K} in (0, 1, 2, 5) then src end as src_ip, case when {_K} in (0, 1, 2, 3) then dst end as dst_ip, case {_K} when 3 then '["ERR_INVALID_SRC_IP"]' else '[]' end as errors,
  case {_K} when 1 then 'tcp' when 3 then 'udp' end as protocol, case {_K} when 4 then event_type end as process_name, case {_K} when 4 then cast(1000 + event_id % 9000 as int) end as process_pid,
  case {_K} when 5 then 'host' || (user_id % 20) end as hostname, case {_K} when 0 then 'Acme' when 4 then 'Acme' end as vendor, {_K} = 2 as ambiguous from e""")
def mapping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell and secret words, addresses found in a list, a bad address, protocols, processes and devices."""
    case = " ".join(f"when {k} then {v}" for k, v in _RULED.items())
    e = C.normalize(facts(spark, sf_dir).selectExpr("event_id", f"case {_K} {case} end as raw"), config=CONFIG)
    f = lambda path, name: F.col(f"event.{path}").alias(name)
    meta = "event.processing_metadata"
    return e.select(
        "event_id", f("threat_intel.mitre_technique_id", "mitre_id"), f("threat_intel.risk_score", "risk_score"), f("src_endpoint.ip", "src_ip"), f("dst_endpoint.ip", "dst_ip"), F.to_json(f"{meta}.error_codes").alias("errors"), f("network.protocol", "protocol"),
        f("process.name", "process_name"), f("process.pid", "process_pid"), f("device.hostname", "hostname"), f("device.vendor", "vendor"), F.exists(f"{meta}.warnings", lambda w: w.startswith("Ambiguous")).alias("ambiguous"),
    )


_HEAD = "'2026-01-01T00:00:00 event ' || lpad(cast(event_id as {t}), 9, '0')"
_FRAME = "'    at app.Main(line' || lpad(cast(f as {t}), 3, '0') || ')'"


def stack_lines(events: DataFrame) -> DataFrame:
    """A header for each event and event_id % 5 indented frames, in one source for each user."""
    one = events.selectExpr("concat('s', user_id) as source", "event_id", "explode(sequence(0, cast(event_id % 5 as int))) as f")
    return one.selectExpr("source", "event_id * 10 + f as line_no", f"case when f = 0 then {_HEAD.format(t='string')} else {_FRAME.format(t='string')} end as line")


def _stack_sql(cap: int) -> str:
    fits = (cap - 1 - 35 - 24) // 25 + 1  # frames of 24 characters after a header of 35, each but the last with a line end
    return f"""select 's' || user_id as source, event_id * 10 as line_no, cast(event_id % 5 + 1 as int) as n_lines, {_HEAD.format(t='varchar')} ||
      coalesce((select string_agg(chr(10) || {_FRAME.format(t='varchar')}, '' order by f) from range(1, least(event_id % 5, {fits}) + 1) t(f)), '') as raw from events"""


@query("multiline_assemble", _stack_sql(M.CAP))
def multiline_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assemble(stack_lines(spread(table(spark, sf_dir, "events"), "event_id")))


@query("stream_multiline", _stack_sql(M.CAP))
def stream_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the file, run to its end, the last record of each source included."""
    read = table_stream(spark, sf_dir, "events")
    return streams.assemble_all(stack_lines(read), scratch(spark, "records"), scratch(spark, "assembled"))


@query("multiline_overflow", _stack_sql(100))
def multiline_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assemble(stack_lines(spread(table(spark, sf_dir, "events"), "event_id")), cap=100)


_RARE = "event_type || ' request from <IP> port <NUM> state '"
_UPDOWN = "case when event_id % 2 = 0 then 'up' else 'down' end"


@query("mask_tokens", f"select {_RARE} || {_UPDOWN} as masked, count(*) as n from events group by all")
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "rare").groupBy(L.mask(F.col("raw")).alias("masked")).agg(F.count("*").alias("n"))


@query("template_mine", f"select {_RARE} || '<*>' as template, count(*) as n from events group by all")
def template_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mine(lines(spark, sf_dir, "rare")).select("template", "n")


@query("template_signature", f"select distinct 'sig_' || substr(md5({_RARE} || '<*>'), 1, 12) as signature from events")
def template_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mine(lines(spark, sf_dir, "rare")).select("signature")


@query("sandbox_score", "select count(*) as n, count(*) filter (event_type = 'click') as matched, count(*) filter (event_type = 'click') / count(*) as ratio, 2.0::double as avg_fields, round(0.6 * (count(*) filter (event_type = 'click') / count(*)) + 0.16, 3) as score, count(*) filter (event_type = 'click') / count(*) >= 0.6 as valid from events")
def sandbox_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sandbox(lines(spark, sf_dir, "rare"), r"^click request from (\S+) port (\d+) state", 2)


@query("learned_parse", f"{E} select event_id, 'JIT_INFERRED' as format, src as src_ip from e")
def learned_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = lines(spark, sf_dir, "rare")
    e = C.normalize(rare, config=CONFIG, rules=L.learn(rare))
    return e.select("event_id", F.col("event.processing_metadata.format_detected").alias("format"), F.col("event.src_endpoint.ip").alias("src_ip"))


@query("rule_latest", "select user_id as signature, max(event_id) as version, arg_max(event_type, event_id) as state from events group by 1")
def rule_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr("user_id as signature", "event_id as version", "event_type as state")
    return L.latest(log, "signature", "version")


@query("pending_topk", "select event_id, ts as created_at from events where event_type = 'error' order by ts desc, event_id limit 50")
def pending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").selectExpr("event_id", "ts as created_at", "case event_type when 'error' then 'PENDING' else 'APPROVED' end as status")
    return A.pending(queue).select("event_id", "created_at")


@query("review_enqueue", "select event_id, 'PENDING' as status from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'signup' and event_id % 10 = 0)")
def review_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of users who have no sign-up in the queue, each given twice."""
    events = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type")
    queued = events.join(events.where("event_type = 'signup' and event_id % 10 = 0").select("user_id"), "user_id", "left_semi").select("event_id")
    errors = events.where("event_type = 'error'").select("event_id")
    return sinks.enqueue(queued, errors.unionAll(errors))


@query("review_insert", "select user_id as event_id, 'PENDING' as status from events where user_id % 3 <> 0 group by 1")
def review_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("user_id as event_id")
    return sinks.enqueue(events.where("event_id % 3 = 0"), events)


@query("learn_batch", f"{E} select event_id, case when event_id % 2 = 0 then 'CEF' else 'JIT_INFERRED' end as format, src as src_ip from e")
def learn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = facts(spark, sf_dir).selectExpr("event_id", f"case when event_id % 2 = 0 then {LINES['cef']} else {LINES['rare']} end as raw")
    events, _ = batch.learn_and_parse(given, config=CONFIG)
    return events.select("event_id", F.col("event.processing_metadata.format_detected").alias("format"), F.col("event.src_endpoint.ip").alias("src_ip"))


_HARD = {
    0: """concat('{"src_ip":"', src, '","msg":"${', event_type, '} {x}"}')""",
    1: """concat('{"src_ip":"', src, '"} {"dst_port":', dpt, '}')""",
    2: """concat(repeat('{"k":', event_id % 40 + 1), dpt, repeat('}', event_id % 40 + 1))""",
    3: """concat('{"src_ip":"', src, '","ratio":NaN,"low":[-Infinity,', dpt, '],"msg":"NaN"}')""",
    4: """concat('{"src_ip":"old","dst_port":', dpt, ',"src_ip":"', src, '","meta":{"n":1,"n":', sev, '}}')""",
    5: """concat('{"src_ip":"', src, '",}')""",
    6: """concat('{"meta.n":1,"meta":{"n":', sev, ',"e":{}},"src_ip":"', src, '"}')""",
}


@query("json_hard", f"""{E} select event_id, case when event_id % 7 in (1, 5) then null else 'JSON' end as format, case when event_id % 7 in (1, 2, 5) then null else src end as src_ip,
  case event_id % 7 when 0 then '${{' || event_type || '}} {{x}}' when 3 then 'NaN' end as msg, case event_id % 7 when 3 then '[-Infinity,' || dpt || ']' end as low, case event_id % 7 when 3 then 'float' end as ratio_kind,
  case when event_id % 7 in (4, 6) then cast(sev as varchar) end as n, case when event_id % 7 = 2 then cast(dpt as varchar) end as deepest, case when event_id % 7 = 2 then event_id % 40 + 1 end as depth from e""")
def json_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces in texts, two roots, objects within objects to a depth of 40, numbers that JSON lacks, keys that come twice."""
    case = " ".join(f"when {k} then {v}" for k, v in _HARD.items())
    p = facts(spark, sf_dir).selectExpr("event_id", f"case event_id % 7 {case} end as raw").select("event_id", P.json_lines(F.col("raw")).alias("p"))
    f = lambda k: F.col("p.fields")[k]
    deep = F.get(F.filter(F.map_entries("p.fields"), lambda e: e["key"].rlike(r"^k(?:\.k)*$")), F.lit(0))
    return p.select("event_id", F.col("p.format").alias("format"), f("src_ip").alias("src_ip"), f("msg").alias("msg"), f("low").alias("low"), F.col("p.types")["ratio"].alias("ratio_kind"), f("meta.n").alias("n"), deep["value"].alias("deepest"), F.size(F.split(deep["key"], r"\.")).cast("long").alias("depth"))


_V6_HEX = "lower({hex}(cast(event_id % 60000 + 1 as bigint)))"


@query("ip_v6", f"""select event_id, case event_id % 8 when 0 then '2001:db8::' || {_V6_HEX.format(hex='to_hex')} when 1 then '::ffff:10.0.' || (event_id % 250) || '.1' when 2 then 'fe80::' || {_V6_HEX.format(hex='to_hex')} || '%eth0' when 3 then '2606:4700::1:0:0:' || {_V6_HEX.format(hex='to_hex')}
  when 4 then '64:ff9b::808:808' when 5 then null when 6 then '::ffff:8.8.' || (event_id % 250) || '.8' end as ip, case event_id % 8 when 3 then false when 4 then false when 6 then false when 5 then null when 7 then null else true end as is_private from events""")
def ip_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written out, compressed, mapped, upper-case and zoned addresses, and some that are none."""
    h = _V6_HEX.format(hex="hex")
    raw = F.expr(f"""case event_id % 8 when 0 then '2001:0DB8:0:0:0:0:0:' || upper({h}) when 1 then '::ffff:10.0.' || event_id % 250 || '.1' when 2 then 'FE80:0:0::' || {h} || '%eth0' when 3 then '2606:4700:0:0:1:0:0:' || {h}
      when 4 then ' 64:ff9b::8.8.8.8 ' when 5 then '1:2:3:4:5:6:7:8:' || {h} when 6 then '0:0:0:0:0:FFFF:0808:' || hex((event_id % 250) * 256 + 8) else '1::2::' || {h} end""")
    return table(spark, sf_dir, "events").select("event_id", N.classify_ip(raw).alias("c")).select("event_id", "c.ip", "c.is_private")


@query("stream_learned", f"{E} select 'sig_' || substr(md5({{0}}), 1, 12) as signature, count(*) as n from e group by all".format("event_type || ' request from <IP> port <NUM> state <*>'"))
def stream_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of the rules that a stream over the events has learned."""
    events = table_stream(spark, sf_dir, "events").selectExpr("*", *[f"{v} as {k}" for k, v in FACTS.items()])
    at = scratch(spark, "learning")
    streams.ingest_learning(events.selectExpr(f"{LINES['rare']} as raw"), f"{at}/table", f"{at}/rules", f"{at}/used", f"{at}/checkpoint", CONFIG).awaitTermination()
    return R.uses(spark, f"{at}/used")


@query("upsert_latest", "select user_id as id, max(event_id) as seq from events group by 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id as id", "event_id as seq")
    return sinks.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@query("latest_table", "select user_id as id, arg_max(event_id, (event_id % 4) * 1000000000000 + event_id) as seq from events group by 1")
def latest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions of a table that is merged when it is read, compacted between the last two."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id as id", "event_id as seq")
    stored = LatestTable(scratch(spark, "latest"), buckets=16)
    for version in range(4):
        if version == 3:
            stored.compact(spark, 2)
        stored.upsert(rows.where(F.col("seq") % 4 == version), version)
    return stored.read(spark)


@query("review_stream", "select distinct user_id as event_id, 'PENDING' as status from events")
def review_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of a stream of three batches that hold most ids each."""
    events = table(spark, sf_dir, "events").selectExpr("user_id as event_id", "event_id % 3 as part")
    given, queue = scratch(spark, "items"), scratch(spark, "queue")
    for part in range(3):
        events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(given)
    items = spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 1).parquet(given)
    streams.enqueue(items, queue, scratch(spark, "checkpoint")).awaitTermination()
    return sinks.read_queue(spark, queue, items.schema)


@query("search_indexed", f"{E} select event_id, src as src_ip from e where contains(lower(src || '|' || event_type || '|' || event_id || '|'), 'purchase|1') or contains(src, 'purchase|1')")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a text, by the index of trigrams of the table's files."""
    given = facts(spark, sf_dir).select("event_id", F.col("src").alias("src_ip"), F.lit("plain").alias("format_detected"), F.expr("concat(src, '|', event_type, '|', event_id, '|')").alias("raw_log"))
    path, index = scratch(spark, "table"), scratch(spark, "index")
    given.repartitionByRange("event_id").write.parquet(path)
    search.index_table(spark, path, index)
    found = search.candidates(spark, path, index, "PURCHASE|1")
    return A.holding(found, "PURCHASE|1").select("event_id", "src_ip")


@query("plugin_records", f"""{E} select event_id, 0 as part, 'KEY_VALUE' as format, src as src_ip from e
  union all select event_id, 1, 'CEF', src from e where event_id % 5 <> 0""")
def plugin_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one or two records, cut by a table function in a lateral join."""
    splitters.register(spark, "cut_records", "split(raw, ' ;; ')")
    given = facts(spark, sf_dir).selectExpr("event_id", f"concat({LINES['kv']}, case when event_id % 5 = 0 then '' else concat(' ;; ', {LINES['cef']}) end) as raw")
    e = C.normalize(splitters.records(given, "cut_records"), config=CONFIG)
    return e.select("event_id", "part", F.col("event.processing_metadata.format_detected").alias("format"), F.col("event.src_endpoint.ip").alias("src_ip"))


@query("plugin_parse", f"select event_id, 'PLAIN' as format, 'u' || user_id as user_name from events")
def plugin_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = P.Parser("plain", 95, lambda raw: F.when(raw.startswith("plain "), P.parsed("PLAIN", "plain", F.create_map(F.lit("user"), F.split_part(raw, F.lit(" "), F.lit(2))))))
    registry = P.Registry()
    registry.register(plain)
    given = facts(spark, sf_dir).selectExpr("event_id", "concat('plain ', usr) as raw")
    e = C.normalize(given, registry, CONFIG)
    return e.select("event_id", F.col("event.processing_metadata.format_detected").alias("format"), F.col("event.actor.user_name").alias("user_name"))


@query("free_sql", f"{E} select x_action as action, count(*) as n from e where dpt = 22 group by all")
def free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.query(spark, flat(spark, sf_dir, "cef"), "select action, count(*) as n from normalized_logs where dst_port = :port group by action", {"port": 22})


@query("window_counts", "select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as end, event_type, count(*) as count from events group by all")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counts(table(spark, sf_dir, "events"), "ts", "1 hour", by=("event_type",))


@query("stream_window_counts", "select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, event_type, count(*) as count from events group by all")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the file, run to its end; the state is written below the checkpoint folder."""
    read = table_stream(spark, sf_dir, "events")
    read = read.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    counted, at = streams.counts(read, "ts", "1 day", by=("event_type",)), scratch(spark, "counts")
    run = counted.writeStream.outputMode("complete").foreachBatch(lambda whole, _: whole.write.mode("overwrite").parquet(f"{at}/table"))
    run.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/table").select(N.utc(F.col("start")).alias("start"), N.utc(F.col("end")).alias("end"), "event_type", "count")


@query("review_status", "select user_id as event_id, arg_max(case when event_type = 'error' then 'PENDING' else 'APPROVED' end, event_id) as status from events group by 1")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr("user_id as event_id", "case event_type when 'error' then 'PENDING' else 'APPROVED' end as status", "event_id as created_at")
    return R.state(log).select("event_id", "status")


@query("approved_rule", f"{E} select event_id, 'JIT_INFERRED' as format, src as src_ip, cast(spt as int) as dst_port from e")
def approved_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = R.approve("sig_rare", "rare", r"^\w+ request from (\S+) port (\d+) state \w+$", ("src_endpoint.ip", "dst_endpoint.port"), 1)
    e = C.normalize(lines(spark, sf_dir, "rare"), config=CONFIG, rules=R.rules(R.rule_log(spark, [rule])))
    return e.select("event_id", F.col("event.processing_metadata.format_detected").alias("format"), F.col("event.src_endpoint.ip").alias("src_ip"), F.col("event.dst_endpoint.port").alias("dst_port"))


@query("rule_usage", "select 'sig_' || event_type as signature, count(*) as n from events where event_type in ('click', 'view') group by all")
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [R.approve(f"sig_{k}", k, rf"^{k} request", (), 1) for k in ("click", "view")]
    return R.times_used(lines(spark, sf_dir, "rare"), R.rule_log(spark, rules))


@query("file_preview", f"{_CEF_TABLE}, r as (select *, md5(event_id || chr(31) || 'CEF:0|Acme|Wall|1.0|' || event_id || '|' || event_type || '|' || sev || '|src=' || src || ' dst=' || dst || ' spt=' || spt || ' dpt=' || dpt || ' act=' || act || ' rt=' || (epoch_us(ts) // 1000) || ' suser=' || usr) as id from t) select id, case when x_action = 'unknown' then '93.5%' else '99.5%' end as confidence, coalesce({_TAG}, 'N/A') as mitre from r order by id limit 15")
def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.preview(flat(spark, sf_dir, "cef"))


@query("recent_events", f"{_CEF_TABLE}, r as (select *, 'CEF:0|Acme|Wall|1.0|' || event_id || '|' || event_type || '|' || sev || '|src=' || src || ' dst=' || dst || ' spt=' || spt || ' dpt=' || dpt || ' act=' || act || ' rt=' || (epoch_us(ts) // 1000) || ' suser=' || usr as raw_log from t) select src as src_ip, dst as dst_ip, cast(dpt as int) as dst_port, x_action as action, raw_log from r where event_type = 'purchase' order by md5(event_id || chr(31) || raw_log) limit 25")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent(flat(spark, sf_dir, "cef"), "|PURCHASE|").select("src_ip", "dst_ip", "dst_port", "action", "raw_log")


@query("html_fallback", f"select page_id, len(regexp_extract_all(html, '{_IP_DUCK}')) as n_ips from pages")
def html_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", P.fallback_lines(F.col("html"))["fields"]["detected_ips"].alias("ips"))
    return found.select("page_id", F.coalesce(F.size(F.from_json("ips", "array<string>")), F.lit(0)).cast("long").alias("n_ips"))


_DRAWN = "('0x' || substr(md5('1{0}:' || event_id), 1, 8))::bigint % {1}"


@query("synthetic_corpus", f"""with k as (select {_DRAWN.format('kind', 8)} as kind, '10.' || {_DRAWN.format('inb', 255)} || '.' || {_DRAWN.format('inc', 255)} || '.' || ({_DRAWN.format('ind', 254)} + 1) as inner_ip from events)
  select case kind when 0 then 'SYSLOG_CISCO' when 1 then 'JSON' when 2 then 'CEF' when 3 then 'LEEF' when 4 then 'SYSLOG_RFC5424' when 5 then 'AUDITD' else 'KEY_VALUE' end as format, count(*) as n,
  count(distinct case when kind in (1, 3) then inner_ip end) as sources from k group by all""")
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded line for each event, by the format that is found in it; source addresses of the two kinds that name the inner one."""
    found = synthetic(facts(spark, sf_dir).select(F.col("event_id").alias("id"))).select(P.Registry().dispatch(F.col("raw")).alias("p"))
    source = F.when(F.col("p.format").isin("JSON", "LEEF"), F.coalesce(F.col("p.fields")["network.src_ip"], F.col("p.fields")["src"]))
    return found.groupBy(F.col("p.format").alias("format")).agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"))


#: Escapes, quotes and delimiters in values, and heads that are too short for their format.
_ROUGH = {
    0: r"concat('CEF:0|Acme|Wall\\|East|1.0|', event_id, '|Name|5|src=', src, ' dst=', dst, ' cs1=a\\=', usr)",
    1: "concat('CEF:0|Acme|Wall|src=', src)",
    2: "concat('<134>Oct 11 22:14:15 gate CEF:0|Acme|Wall|1.0|', event_id, '|Name|5|src=', dst, ' cs1=\"two ', usr, '\" src=', src)",
    3: "concat('LEEF:2.0|Acme|Mail|4.0|', event_id, '|^|src=', src, '^ note = a=', usr, ' ^empty')",
    4: "concat('LEEF:1.0|Acme|Mail ', event_id)",
    5: "concat('note=\"x ', usr, '\" src_ip: ', dst, ' kind=''a=b'' src_ip=', src)",
    6: "concat('note=', usr, ' src_ip=', src)",
    7: """concat('{"src_ip":"', src, '","note":')""",
}


@query("lines_rough", f"""{E} select event_id, case event_id % 8 when 0 then 'CEF' when 2 then 'CEF' when 3 then 'LEEF' when 5 then 'KEY_VALUE' else 'GENERIC_FALLBACK' end as format,
  case when event_id % 8 <> 4 then src end as src_ip, case event_id % 8 when 0 then 'Wall|East' when 2 then 'Wall' when 3 then 'Mail' end as product,
  case event_id % 8 when 0 then 'a=' || usr when 2 then 'two ' || usr when 3 then 'a=' || usr when 5 then 'x ' || usr end as note from e""")
def lines_rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = " ".join(f"when {k} then {v}" for k, v in _ROUGH.items())
    p = facts(spark, sf_dir).selectExpr("event_id", f"case event_id % 8 {case} end as raw").select("event_id", P.Registry().dispatch(F.col("raw")).alias("p"))
    f = lambda *keys: F.coalesce(*[F.col("p.fields")[k] for k in keys])
    return p.select("event_id", F.col("p.format").alias("format"), f("src", "src_ip").alias("src_ip"), f("device_product").alias("product"), f("cs1", "note").alias("note"))


@query("rules_listed", "select 'sig_' || user_id as signature, max(event_id) as created, arg_max(event_type, event_id) as template from events group by user_id")
def rules_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest form of each rule of a log that holds many versions of each."""
    log = table(spark, sf_dir, "events").selectExpr("concat('sig_', user_id) as signature", "event_type as template", "'^x' as pattern", "array() as fields", "1.0D as score", "true as verified", "event_id as created")
    return R.listed(log).select("signature", "created", "template")


@query("explained", f"{E} select event_id, {_FORMATS} as format, case when event_id % 9 in (0, 1, 2, 5, 7, 8) then src end as src_ip, {_OVERALL}::double as overall from e")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON texts, read back."""
    e = A.explain(C.normalize(mixed(spark, sf_dir), config=CONFIG), "event_id")
    at = lambda path: F.get_json_object("explanation", f"$.{path}")
    meta = "processing_metadata"
    return e.select("event_id", at(f"{meta}.format_detected").alias("format"), at("src_endpoint.ip").alias("src_ip"), F.round(at(f"{meta}.confidence.overall_confidence").cast("double"), 3).alias("overall"))


_CEF_RAW = "'CEF:0|Acme|Wall|1.0|' || event_id || '|' || event_type || '|' || sev || '|src=' || src || ' dst=' || dst || ' spt=' || spt || ' dpt=' || dpt || ' act=' || act || ' rt=' || (epoch_us(ts) // 1000) || ' suser=' || usr"


@query("exported", f"{E}, r as (select *, md5(event_id || chr(31) || {_CEF_RAW}) as id from e) select id, src as src_ip, cast(dpt as int) as dst_port, x_action as action from r order by id limit 1000")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the table as CSV with a header, read back."""
    at = scratch(spark, "export")
    sinks.export(flat(spark, sf_dir, "cef").select("id", "src_ip", "dst_port", "action"), at)
    return spark.read.option("header", True).schema("id string, src_ip string, dst_port int, action string").csv(at)


@query("text_files", f"select 'h' || (user_id % 20) as host, cast(event_id % 5 + 1 as int) as n_lines, {_HEAD.format(t='varchar')} || coalesce((select string_agg(chr(10) || {_FRAME.format(t='varchar')}, '' order by f) from range(1, event_id % 5 + 1) t(f)), '') as raw from events")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file a host, written in order, read as lines and assembled."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 20 as user_id")
    at = scratch(spark, "texts")
    given = stack_lines(events).selectExpr("concat('h', substr(source, 2)) as host", "line_no", "line").repartition("host").sortWithinPartitions("host", "line_no")
    given.select("host", "line").write.partitionBy("host").text(at)
    records = M.assemble(read_lines(spark, at))
    return records.select(F.regexp_extract("source", "host=(h[0-9]+)", 1).alias("host"), "n_lines", "raw")
