"""Scalar normalizers: timestamps, addresses, directions, actions, severities, states and ports."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import contains_any, let, strip

#: Substrings of an action in the order in which they are looked for.
ACTIONS = {
    "allow": ("allow", "permit", "accept", "pass", "granted"),
    "deny": ("deny", "block", "reject", "refused", "prevented"),
    "drop": ("drop", "discard"),
    "alert": ("alert", "alarm", "warn"),
    "log": ("log", "info", "notice"),
    "modify": ("modify", "update", "change", "write"),
}
#: Spellings of a severity, matched whole in lower case.
SEVERITIES = {
    "emergency": ("0", "emerg", "emergency", "fatal"),
    "alert": ("1", "alert"),
    "critical": ("2", "crit", "critical"),
    "error": ("3", "err", "error", "fail", "failure"),
    "warning": ("4", "warn", "warning"),
    "notice": ("5", "notice"),
    "info": ("6", "info", "informational"),
    "debug": ("7", "debug", "trace"),
}
STATES = {"success": ("success", "ok", "yes", "passed"), "failure": ("failure", "failed", "no", "error")}
#: IPv4 blocks that are not public, as (network, prefix length); exceptions are public again.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
#: IPv6 blocks that are not public, and exceptions. A mapped IPv4 address is judged as IPv4.
PRIVATE_V6 = ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED_V6 = "0" * 20 + "ffff"
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    cut = F.substring_index
    part = [t.cast("bigint") for t in (cut(ip, ".", 1), cut(cut(ip, ".", 2), ".", -1), cut(cut(ip, ".", -2), ".", 1), cut(ip, ".", -1))]
    return F.when(ip.rlike(V4), part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def v6_hex(ip: Column) -> Column:
    """An IPv6 address without a zone, in lower case, as 32 hex digits; null if it is none. The last four groups of digits may be
    an IPv4 address; `::` stands for one group of zeros or more, once."""

    def padded(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def of(t: Column) -> Column:
        tail = F.substring_index(t, ":", -1)
        number = v4_number(tail)
        quad = lambda n: F.lower(F.concat(F.lpad(F.hex(F.floor(n / 65536)), 4, "0"), F.lit(":"), F.lpad(F.hex(n % 65536), 4, "0")))
        plain = F.when(~t.contains("."), t).otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), quad(number)))
        return let(plain, of_groups)

    def of_groups(t: Column) -> Column:
        sides = F.split(t, "::")
        groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
        left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
        n = F.size(left) + F.when(F.size(sides) == 2, F.size(right)).otherwise(0)
        every = F.concat(left, F.when(F.size(sides) == 2, right).otherwise(F.array().cast("array<string>")))
        fine = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        whole = F.when((F.size(sides) == 1) & (n == 8), padded(left)).when((F.size(sides) == 2) & (n <= 7), F.concat(padded(left), F.repeat(F.lit("0000"), 8 - n), padded(right)))
        return F.when(fine, whole)

    return F.when(ip.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$"), let(ip, of))


def _v6_text(hex32: Column) -> Column:
    """The usual text: groups without leading zeros, the first of the longest runs of two zero groups or more as `::`, mapped
    addresses with a dotted end."""
    group = lambda i: F.regexp_replace(F.substring(hex32, 4 * i + 1, 4), "^0{1,3}", "")
    marked = F.concat(F.lit(":"), F.array_join(F.array(*[group(i) for i in range(8)]), ":"), F.lit(":"))

    def shortened(t: Column) -> Column:
        out = F.substring(t, F.lit(2), F.length(t) - 2)
        for run in range(2, 9):
            mark = ":" + "0:" * run
            at = F.instr(t, mark)
            cut = F.concat(F.substring(t, F.lit(1), at - 1), F.lit("::"), F.substring(t, at + len(mark), F.length(t)))
            bare = F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")
            out = F.when(at > 0, bare).otherwise(out)
        return out

    byte = lambda i: F.conv(F.substring(hex32, 2 * i + 1, 2), 16, 10)
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[byte(i) for i in range(12, 16)]))
    return F.when(hex32.startswith(MAPPED_V6), mapped).otherwise(let(marked, shortened))


def _in_blocks(number: Column, blocks: tuple[str, ...]) -> Column:
    """IPv4 numbers are longs, IPv6 numbers texts of 32 hex digits, which are in order as texts."""
    out = F.lit(False)
    for n in map(ipaddress.ip_network, blocks):
        a, b = (v if n.version == 4 else f"{v:032x}" for v in (int(n.network_address), int(n.broadcast_address)))
        out = out | ((number >= F.lit(a)) & (number <= F.lit(b)))
    return out


def _private(number: Column, private: tuple[str, ...], public: tuple[str, ...]) -> Column:
    return _in_blocks(number, private) & ~_in_blocks(number, public)


def classify_ip(raw: Column, ipv6: bool = True) -> Column:
    """struct<ip, is_private, version>: stripped, one `:port` of an IPv4 address cut off; all null if invalid.

    Column expressions throughout. IPv6 texts may be compressed, mapped or have a zone, which stays behind the address;
    ipv6=False takes them for invalid.
    """
    def of(t: Column) -> Column:
        v4 = let(v4_number(t), lambda n: classified(t, n))
        return F.when(t.rlike(TWO_COLONS), classified(t, F.lit(None).cast("bigint"), v6_found(t))).otherwise(v4) if ipv6 else v4

    return F.coalesce(let(ip_text(raw), of), no_ip())


TWO_COLONS = ":.*:"


def _ip_found(ip: Column, private: Column, version: Column) -> Column:
    return F.struct(ip.cast("string").alias("ip"), private.cast("boolean").alias("is_private"), version.cast("string").alias("version"))


def no_ip() -> Column:
    return _ip_found(F.lit(None), F.lit(None), F.lit(None))


def ip_text(raw: Column) -> Column:
    """Stripped, one `:port` of an IPv4 address cut off."""
    return without_port(strip(raw))


def without_port(s: Column) -> Column:
    """ip_text() of a stripped text."""
    return F.when(s.contains(".") & (F.length(s) - F.length(F.replace(s, F.lit(":"))) == 1), F.split_part(s, F.lit(":"), F.lit(1))).otherwise(s)


def v6_found(t: Column) -> Column:
    """As classify_ip() for an ip_text() of two colons or more; null for others and invalid ones."""

    def v6(t: Column) -> Column:
        zone = F.when(t.contains("%"), F.substring(t, F.instr(t, "%"), F.length(t))).otherwise("")
        address = F.lower(F.substring_index(t, "%", 1))
        fine = (zone == "") | zone.rlike("^%[^%]+$")
        of_mapped = lambda h: _private(F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint"), PRIVATE_V4, PUBLIC_V4)
        private = lambda h: F.when(h.startswith(MAPPED_V6), of_mapped(h)).otherwise(_private(h, PRIVATE_V6, PUBLIC_V6))
        return F.when(fine, let(v6_hex(address), lambda h: F.when(h.isNotNull(), _ip_found(F.concat(_v6_text(h), zone), private(h), F.lit("IPv6")))))

    return F.when(t.rlike(TWO_COLONS), let(t, v6))


def classified(t: Column, number: Column, v6: Column | None = None) -> Column:
    """classify_ip() of an ip_text(), by its v4_number() and v6_found(), which no text has both of."""
    v4 = F.when(number.isNotNull(), _ip_found(t, _private(number, PRIVATE_V4, PUBLIC_V4), F.lit("IPv4")))
    return F.coalesce(*([] if v6 is None else [v6]), v4, no_ip())


def direction(src_private: Column, dst_private: Column) -> Column:
    both = F.when(src_private & ~dst_private, "outbound").when(~src_private & dst_private, "inbound").when(src_private & dst_private, "internal").otherwise("external")
    return F.when(src_private.isNull() | dst_private.isNull(), "unknown").otherwise(both)


def action(raw: Column) -> Column:
    """By substring of the lower-cased text; the first group that fits wins (so `disallow` is allow and `login` is log)."""
    low, out = F.lower(raw), None
    for name, words in ACTIONS.items():
        out = (F if out is None else out).when(contains_any(low, words), name)
    return out.otherwise("unknown")


def severity(raw: Column) -> Column:
    """By whole word; null, empty and unknown words are info. Falsy numbers are to be given as null."""
    low, out = F.lower(strip(raw)), None
    for name, words in SEVERITIES.items():
        out = (F if out is None else out).when(low.isin(*words), name)
    return out.otherwise("info")


def status(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin(*STATES["success"]), "success").when(low.isin(*STATES["failure"]), "failure").otherwise("unknown")


def port(raw: Column) -> Column:
    """int of a port from 1 to 65535; null for anything else."""
    n = raw.try_cast("bigint")
    return F.when(n.between(1, 65535), n.cast("int"))


@F.arrow_udf(T.LongType())
def _free_form(texts: pa.Array, reference: pa.Array) -> pa.Array:
    """Microseconds of a free-form date, missing parts taken from the reference date, no zone: UTC."""
    from datetime import UTC, datetime, timedelta

    from dateutil import parser

    out, zero = [], datetime(1970, 1, 1, tzinfo=UTC)
    for x, ref in zip(texts.to_pylist(), reference.to_pylist(), strict=True):
        try:
            if x is None:
                raise ValueError
            t = parser.parse(x, default=datetime.fromisoformat(ref))
            t = t.replace(tzinfo=UTC) if t.tzinfo is None else t
            out.append((t - zero) // timedelta(microseconds=1))
        except (ValueError, OverflowError, TypeError, AttributeError):
            out.append(None)
    return pa.array(out, pa.int64())


def utc(t: Column) -> Column:
    """A timestamp as local time in UTC, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))


def timestamp(raw: Column, today: str, free_form: bool = False) -> Column:
    """struct<epoch_us, iso, timezone, ok> of a raw time text.

    today ('yyyy-MM-dd') supplies the year of a BSD date and what a free-form date leaves out, and stands
    in for the clock: where nothing fits, epoch_us is its midnight (UTC) and ok is false. Epochs of 10, 13 and
    16 digits, Apache, BSD and ISO dates are column expressions; with free_form the rest goes to one
    Arrow function. Nothing depends on the session's time zone.
    """
    if free_form:  # an Arrow function cannot stand inside a lambda
        s = time_text(raw)
        return let(F.struct(s.alias("s"), time_found(s, today, True).alias("found")), lambda x: stamped(x["s"], x["found"], today))
    return let(time_text(raw), lambda t: let(time_found(t, today), lambda found: stamped(t, found, today)))


def time_text(raw: Column) -> Column:
    """Stripped, brackets and quotes at both ends cut off."""
    return F.regexp_replace(strip(raw), r"^[\[\]\"']+|[\[\]\"']+$", "")


def time_found(s: Column, today: str, free_form: bool = False) -> Column:
    """Microseconds of a time_text(); null if nothing fits."""
    if not free_form:
        return _native(s, today)
    native = let(s, lambda t: _native(t, today))
    return F.coalesce(native, _free_form(F.when(native.isNull() & (s != ""), s), F.lit(today)))


APACHE = rf"^\d{{1,2}}/{MONTH}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}$"


def _native(s: Column, today: str) -> Column:
    """Microseconds by column expressions; null for other forms."""
    us = F.unix_micros
    number = (
        F.when(s.rlike(r"^\d{10}(?:\.\d{1,6})?$"), (s.try_cast("double") * 1000000).cast("bigint"))
        .when(s.rlike(r"^\d{13}$"), s.try_cast("bigint") * 1000)
        .when(s.rlike(r"^\d{16}$"), s.try_cast("bigint"))
    )
    single = F.regexp_replace(s, r"\s+", " ")
    apache = F.when(s.rlike(APACHE), us(F.try_to_timestamp(single, F.lit("d/MMM/yyyy:HH:mm:ss Z"))))
    bsd = F.when(s.rlike(rf"^{MONTH}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}$"), us(F.try_to_timestamp(F.concat(F.lit(today[:4] + " "), single, F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss Z"))))
    day = F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(s, F.lit("Z")))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?)?$"), us(F.try_to_timestamp(day)))
    return F.coalesce(number, apache, bsd, iso)


def stamped(s: Column, found: Column, today: str) -> Column:
    """timestamp() of a time_text() and its time_found()."""
    zone = F.when(s.rlike(APACHE) & ~s.rlike(r"[+-]0000$"), F.concat(F.lit("UTC"), F.regexp_extract(s, r"([+-]\d{2})(\d{2})$", 1), F.lit(":"), F.regexp_extract(s, r"([+-]\d{2})(\d{2})$", 2))).otherwise("UTC")
    epoch = F.coalesce(found, F.unix_micros(F.lit(today + "T00:00:00Z").cast("timestamp")))
    text = F.date_format(utc(F.timestamp_micros(epoch)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.struct(epoch.alias("epoch_us"), F.regexp_replace(text, r"\.000000", "").alias("iso"), zone.alias("timezone"), found.isNotNull().alias("ok"))
