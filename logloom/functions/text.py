"""Text helpers with the exact semantics that log parsing needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of str.strip(): Unicode blanks and the separators \x1c-\x1f.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Texts that begin and end with a visible ASCII character are left alone: to trim by a set of characters, Spark looks each
    up in the set and goes through the whole text, which takes microseconds a text."""
    fine = F.substring(s, 1, 1).between("!", "~") & F.substring(s, -1, 1).between("!", "~")
    return F.when(fine, s).otherwise(F.btrim(s, F.lit(BLANKS)))


def contains_any(s: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True if s holds one of the words anywhere, as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def group(s: Column, pattern: str, i: int) -> Column:
    """Group i of the first match; null where the pattern does not match at all."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, i))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row. A lambda computes what it refers to anew for every element,
    and Spark finds no common parts inside; a lambda's own variable is held."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_of_each(entries: Column) -> Column:
    """An array of structs with a `key`; of equal keys the last stays. Time n log n in the entries, n if no key comes twice."""

    def build(e: Column) -> Column:
        placed = F.array_sort(F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x.alias("entry"))))
        lasts = let(placed, lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1)["key"] != x["key"])))
        ordered = F.array_sort(F.transform(lasts, lambda x: F.struct(x["i"].alias("i"), x["entry"].alias("entry"))))
        return F.when(F.size(F.array_distinct(e["key"])) == F.size(e), e).otherwise(ordered["entry"])

    return let(entries, build)


def last_wins(entries: Column) -> Column:
    """Map of an array of struct<key, value>; of equal keys the last stays."""
    return F.map_from_entries(last_of_each(entries))


def mapped(keys: Column, values: Column) -> Column:
    """As last_wins(), of two arrays: where no key comes twice, nothing is done one by one."""

    def build(t: Column) -> Column:
        k, v = t["keys"], t["values"]
        twice = last_wins(F.zip_with(k, v, lambda key, value: F.struct(key.alias("key"), value.alias("value"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.map_from_arrays(k, v)).otherwise(twice)

    return let(F.struct(keys.alias("keys"), values.alias("values")), build)


def matches(s: Column, pattern: str, groups: tuple[int, ...] = (2, 3)) -> Column:
    """struct<keys, values> of all matches, two arrays: a key is group 1, a value that of `groups` which took part (one does). All
    but the last of `groups` are texts in quotes, and are looked for in lines with quotes alone. A pass over the text for each
    group: to match each pair anew for its parts costs several times as much."""

    def build(t: Column) -> Column:
        every = lambda i: F.regexp_extract_all(t, F.lit(pattern), F.lit(i))
        values = every(groups[-1])
        for i in groups[:-1]:
            values = F.zip_with(every(i), values, lambda own, other: F.when(own != "", own).otherwise(other))
        values = F.when(t.contains('"') | t.contains("'"), values).otherwise(every(groups[-1]))
        return F.when(t.isNotNull(), F.struct(every(1).alias("keys"), values.alias("values")))

    return let(s, build)


def pairs(s: Column, pattern: str, groups: tuple[int, ...] = (2, 3)) -> Column:
    """matches() as an array of struct<key, value>."""
    return let(matches(s, pattern, groups), lambda m: F.zip_with(m["keys"], m["values"], lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def each_stripped(values: Column) -> Column:
    """strip() of each text. One search tells whether any of them begins or ends with more than a visible ASCII character."""
    rough = "(?dm)^[^!-~]|[^!-~]$"
    return let(values, lambda vs: F.when(F.array_join(vs, "\n").rlike(rough), F.transform(vs, strip)).otherwise(vs))


def fields_of(s: Column, pattern: str, n: int) -> Column:
    """Array of the n groups of a pattern that fits the whole of a stripped line, else null. The groups must not take
    in a line end: it parts them, so that the pattern runs once."""
    cut = F.regexp_replace(s, pattern, "".join(f"\n${i}" for i in range(1, n + 1)))
    return let(cut, lambda t: F.when(t.startswith("\n"), F.slice(F.split(t, "\n"), 2, n)))
