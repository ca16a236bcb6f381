"""Learning rules from lines that no parser takes: masking, template mining, synthesis, sandbox, rule store."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import let, strip
from logloom.operators.parsers import fallback_lines, parsed
from logloom.sources.tables import checkpointed

IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
#: Masks in the order in which they are applied.
MASKS = (
    (IPV4, "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d+\b", "<NUM>"),
)
WILD = "<*>"
MASKED = {"<IP>": IPV4, "<HEX>": "0x[0-9a-fA-F]+", "<UUID>": "[0-9a-fA-F-]{36}", "<NUM>": r"\d+"}
STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
#: Words before a variable, the field it then is, and its pattern.
ROLES = (
    (("from", "src", "source", "client"), "src_ip", "src_endpoint.ip", rf"{IPV4}|\S+"),
    (("to", "dst", "dest", "server", "target"), "dst_ip", "dst_endpoint.ip", rf"{IPV4}|\S+"),
    (("port", "pt", "dport"), "dst_port", "dst_endpoint.port", r"\d{1,5}"),
    (("time", "date", "["), "timestamp", "timestamp.raw", rf"{STAMP}|\S+"),
    (("user", "usr", "account"), "user_name", "actor.user_name", r"[a-zA-Z0-9_\-.@]+"),
    (("status", "action", "event"), "action", "event.action", r"\w+"),
)
MIN_MATCH = 0.60


@dataclass(frozen=True)
class MinerConfig:
    """Depth of the prefix tree, and share of tokens that must agree for a merge."""

    depth: int = 4
    similarity: float = 0.5


def mask(line: Column) -> Column:
    out = line
    for pattern, name in MASKS:
        out = F.regexp_replace(out, pattern, name)
    return out


def signature(template: Column) -> Column:
    return F.concat(F.lit("sig_"), F.substring(F.md5(template.cast("binary")), 1, 12))


def leaf_of(masked: Column, config: MinerConfig | None = None) -> Column:
    """Token count and leading tokens of a masked line or a template, tokens with digits and masks being wild: lines meet the
    templates, and later the rules, of their leaf only."""
    config = config or MinerConfig()
    lead = lambda t: F.when(t.rlike(r"\d|^<(?:IP|HEX|UUID|NUM)>"), WILD).otherwise(t)
    return let(F.split(masked, r"\s+"), lambda t: F.concat_ws(" ", F.size(t).cast("string"), F.transform(F.slice(t, 1, config.depth - 2), lead)))


#: Distinct masked lines of a leaf that one task merges by the algorithm itself, and lines of a leaf that one task holds.
SEEDS, SHARE = 2_000, 50_000


def _coded(texts: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([[known.setdefault(w, len(known)) for w in t.split()] for t in texts], np.int64)


def _drain(own: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Templates of a leaf's lines, most frequent first (ties by text): each joins the most alike template, whose differing
    tokens become wild, or begins one."""
    own = own.sort_values(["n", "masked"], ascending=[False, True])
    known: dict[str, int] = {}
    coded = _coded(own["masked"].tolist(), known)
    words = [*known, WILD]
    found = np.full(coded.shape, -1, np.int64)
    counts, samples, k = [], [], 0
    for line, n, sample in zip(coded, own["n"].tolist(), own["sample"].tolist(), strict=True):
        alike = (found[:k] == line).sum(axis=1) / len(line)
        at = int(alike.argmax()) if k else -1
        if k and alike[at] >= similarity:
            found[at][found[at] != line] = -1
            counts[at] += n
        else:
            found[k] = line
            counts.append(n)
            samples.append(sample)
            k += 1
    return pd.DataFrame({"leaf": own["leaf"].iloc[0], "tid": range(k), "tokens": [[words[c] for c in t] for t in found[:k]], "n": counts, "sample": samples})


def _assign(lines: pd.DataFrame, templates: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """A share of a leaf's lines against the leaf's templates. Rows with a tid: what the lines that fit it have in common, and their
    number; rows without: lines that fit none."""
    columns = ["leaf", "tid", "tokens", "masked", "n", "sample"]
    if lines.empty:
        return pd.DataFrame([], columns=columns)
    templates = templates.sort_values("tid")
    known: dict[str, int] = {}
    coded = _coded(lines["masked"].tolist(), known)
    best, at = np.full(len(coded), -1.0), np.full(len(coded), -1)
    for tid, tokens in zip(templates["tid"], templates["tokens"], strict=True):
        own = np.array([-1 if w == WILD else known.get(w, -2) for w in tokens])
        alike = (coded == own).sum(axis=1)
        share = alike / coded.shape[1]
        closer = (share > best) & ((share >= similarity) | (alike == (own != -1).sum()))
        best[closer], at[closer] = share[closer], tid
    words, out = [*known], []
    of_template = dict(zip(templates["tid"], templates["tokens"], strict=True))
    n, sample, leaf = lines["n"].to_numpy(), lines["sample"], lines["leaf"].iloc[0]
    for tid in np.unique(at[at >= 0]):
        mine_ = coded[at == tid]
        same = (mine_ == mine_[0]).all(axis=0)
        tokens = [words[c] if s and w != WILD and w == words[c] else WILD for c, s, w in zip(mine_[0], same, of_template[tid], strict=True)]
        out.append((leaf, int(tid), tokens, None, int(n[at == tid].sum()), sample[at == tid].min()))
    rest = lines[at < 0]
    out += [(leaf, None, None, m, int(c), x) for m, c, x in zip(rest["masked"], rest["n"], rest["sample"], strict=True)]
    return pd.DataFrame(out, columns=columns).astype({"tid": "Int64"})


def mine(lines: DataFrame, line: str = "raw", config: MinerConfig | None = None) -> DataFrame:
    """(template, signature, n, sample) of masked lines, after the Drain algorithm: lines meet by token count and
    leading tokens, and merge where enough tokens agree, the others becoming wild.

    Equal masked lines are counted before anything meets. A leaf of up to SEEDS distinct lines is merged in one task. Of a
    larger one the SEEDS most frequent lines are; then all of its lines, dealt to tasks of some SHARE each, are held against
    those templates, and what the lines of a template have in common, which merges in any order, becomes the template.
    Lines that fit none make the next round. So no task gets a whole leaf, and the result depends neither on the
    order of the input nor on the number of shares.
    """
    config = config or MinerConfig()
    masked = lines.select(strip(mask(F.col(line))).alias("masked"), F.col(line).alias("line")).where("masked <> ''")
    counted = masked.groupBy("masked").agg(F.count("*").alias("n"), F.min("line").alias("sample"))
    left = checkpointed(counted.select(leaf_of(F.col("masked"), config).alias("leaf"), "masked", "n", "sample"))
    made, similarity = [], config.similarity
    template = "leaf string, tid long, tokens array<string>, n long, sample string"
    while True:
        sizes = left.groupBy("leaf").agg(F.count("*").alias("size"))
        first = left.withColumn("k", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n"), "masked"))).where(F.col("k") <= SEEDS).drop("k")
        merged = checkpointed(first.groupBy("leaf").applyInPandas(lambda own: _drain(own, similarity), template))
        large = checkpointed(sizes.where(F.col("size") > SEEDS).withColumn("shares", F.ceil(F.col("size") / SHARE).cast("int")))
        made.append(merged.join(large, "leaf", "left_anti").select("tokens", "n", "sample"))
        if large.isEmpty():
            break
        dealt = left.join(large, "leaf").withColumn("share", F.pmod(F.xxhash64("masked"), F.col("shares")).cast("int")).drop("size", "shares")
        held = merged.join(large, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("leaf", "share", "tid", "tokens")
        met = dealt.groupBy("leaf", "share").cogroup(held.groupBy("leaf", "share")).applyInPandas(lambda a, b: _assign(a, b, similarity), "leaf string, tid long, tokens array<string>, masked string, n long, sample string")
        met = checkpointed(met)
        common = F.aggregate(F.collect_list("tokens"), F.first("tokens"), lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(WILD)))
        made.append(met.where("tid is not null").groupBy("leaf", "tid").agg(common.alias("tokens"), F.sum("n").alias("n"), F.min("sample").alias("sample")).select("tokens", "n", "sample"))
        left = checkpointed(met.where("tid is null").select("leaf", "masked", "n", "sample"))
    mined = made[0]
    for more in made[1:]:
        mined = mined.unionByName(more)
    mined = mined.withColumn("template", F.array_join("tokens", " "))
    return mined.groupBy("template").agg(F.sum("n").alias("n"), F.min("sample").alias("sample")).select("template", signature(F.col("template")).alias("signature"), "n", "sample")


@dataclass(frozen=True)
class Rule:
    """A learned rule: its pattern has plain groups, whose fields stand in `fields` in order."""

    signature: str
    template: str
    pattern: str
    fields: tuple[str, ...]
    score: float
    verified: bool = False
    created: int = 0


def synthesize(template: str) -> tuple[str, tuple[str, ...]]:
    """Pattern and fields of a template: each wild or masked token becomes a group, named after the words before it.

    Masked tokens are typed groups, so that a template matches the lines it was mined from.
    """
    out, fields, before = [], [], ""
    for part in re.split(r"(<\*>|<IP>|<HEX>|<UUID>|<NUM>)", template):
        if part not in MASKED and part != WILD:
            out.append(r"\s+".join(re.escape(w) for w in re.split(r"\s+", part)))
            before = part.lower()
            continue
        role = next((r for r in ROLES if any(w in before for w in r[0])), None)
        field, pattern = (role[2], role[3]) if role else (f"unmapped.var_{len(fields) + 1}", r"\S+")
        pattern = MASKED.get(part, pattern)
        if part == "<IP>" and not field.endswith(".ip"):
            field = "src_endpoint.ip"
        if field in fields:
            field = "dst_endpoint.ip" if field == "src_endpoint.ip" and "dst_endpoint.ip" not in fields else f"unmapped.var_{len(fields) + 1}"
        out.append(f"({pattern})")
        fields.append(field)
    return "^" + "".join(out) + "$", tuple(fields)


def sandbox(samples: DataFrame, pattern: str, n_fields: int, line: str = "raw") -> DataFrame:
    """One row (n, matched, ratio, avg_fields, score, valid) of a pattern over the sample lines."""
    hit = F.col(line).rlike(pattern)
    filled = sum((F.when(strip(F.regexp_extract(line, pattern, i + 1)) != "", 1).otherwise(0) for i in range(n_fields)), F.lit(0))
    counted = samples.agg(F.count(line).alias("n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(hit, filled)), F.lit(0)).alias("filled"))
    ratio = F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0)
    each = F.when(F.col("matched") > 0, F.col("filled") / F.col("matched")).otherwise(0.0)
    scored = counted.select("n", "matched", ratio.alias("ratio"), each.alias("avg_fields"))
    score = F.when(F.col("matched") > 0, 0.6 * F.col("ratio") + F.least(F.lit(0.4), F.col("avg_fields") / 5.0 * 0.4)).otherwise(0.0)
    return scored.withColumn("score", F.round(score, 3)).withColumn("valid", F.col("ratio") >= MIN_MATCH)


RULES = "signature string, template string, pattern string, fields array<string>, score double, verified boolean, created bigint"
#: An analyst's rule goes before key-value lines, a learned one behind.
LEARNED, APPROVED = 65, 72
#: Bytes of a rule table that are sent to every executor; beyond it lines and rules are shuffled by leaf.
BROADCAST_BYTES = 32 << 20


def learn(lines: DataFrame, line: str = "raw", config: MinerConfig | None = None, at_least: int = 1, make: Callable[[str], tuple[str, tuple[str, ...]]] = synthesize, created: int = 0) -> DataFrame:
    """The rule table (RULES) of all templates of at_least lines whose pattern passes the sandbox on their own sample.

    make turns a template into a pattern and its fields. Rules are made in the tasks that hold their templates.
    """

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sig, template, sample in zip(batch["signature"], batch["template"], batch["sample"], strict=True):
                pattern, fields = make(template)
                m = re.search(pattern, sample.strip())
                if m:
                    filled = sum(bool(g and g.strip()) for g in m.groups())
                    out.append((sig, template, pattern, list(fields), round(0.6 + min(0.4, filled / 5 * 0.4), 3), False, created))
            yield pd.DataFrame(out, columns=["signature", "template", "pattern", "fields", "score", "verified", "created"])

    return mine(lines, line, config).where(F.col("n") >= at_least).mapInPandas(rules, RULES)


def by_leaf(rules: DataFrame, config: MinerConfig | None = None) -> DataFrame:
    """(leaf, rules): the rules of each leaf in the order in which they are tried, newest first. Verified rules, whose patterns an
    analyst wrote, may fit any line: their leaf is WILD."""
    leaf = F.when(F.col("verified"), F.lit(WILD)).otherwise(leaf_of(F.col("template"), config))
    whole = F.concat(F.lit("(?s)\\A.*?(?-s:"), F.col("pattern"), F.lit(").*\\z"))
    groups = F.when(F.size("fields") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.size("fields"), F.lit(1))), lambda i: F.concat(F.lit("\x01$"), i)), "")).otherwise("\x01")
    entry = F.struct((-F.col("created")).alias("age"), "signature", "pattern", whole.alias("whole"), groups.alias("groups"), "fields")
    return rules.select(leaf.alias("leaf"), entry.alias("rule")).groupBy("leaf").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def with_candidates(lines: DataFrame, raw: str, rules: DataFrame, unknown: Column, open_: Column, config: MinerConfig | None = None) -> DataFrame:
    """lines with `learned` and `approved`: the rules that may fit a line, by its leaf and by WILD; null where there are none.
    Only lines that are unknown look for learned ones, and those that are open_ for approved ones.

    The rule table is joined, not made part of the plan: ten thousand rules plan like one. Up to BROADCAST_BYTES it is
    broadcast, so the lines stay where they are; beyond it both sides are shuffled, lines that look for nothing evenly.
    """
    table = checkpointed(by_leaf(rules, config))
    size = table.agg(F.sum(F.length(F.to_json("rules")))).first()[0] or 0
    side = F.broadcast if size <= BROADCAST_BYTES else (lambda t: t)
    nothing = F.concat(F.lit("~"), F.xxhash64(raw).cast("string"))
    out = lines.withColumn("__leaf", F.when(unknown, leaf_of(strip(mask(F.col(raw))), config)).otherwise(nothing)).withColumn("__wild", F.when(open_, F.lit(WILD)).otherwise(nothing))
    for key, name, own in (("__leaf", "learned", table.where(F.col("leaf") != WILD)), ("__wild", "approved", table.where(F.col("leaf") == WILD))):
        out = out.join(side(own.select(F.col("leaf").alias(key), F.col("rules").alias(name))), key, "left").drop(key)
    return out


def fitting(rules: Column, raw: Column) -> Column:
    """Those of the candidate rules whose pattern fits the line."""
    return F.filter(rules, lambda r: F.rlike(raw, r["pattern"]))


def _read(rules: Column, raw: Column) -> Column:
    def of(r: Column) -> Column:
        values = F.slice(F.split(F.regexp_replace(raw, r["whole"], r["groups"]), "\x01"), F.lit(2), F.size(r["fields"]))
        filled = F.filter(F.zip_with(r["fields"], values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda e: strip(e["value"]) != "")
        return F.when(r.isNotNull(), let(F.map_from_entries(filled), lambda f: parsed("JIT_INFERRED", "jit_inferred", f, ts_raw=F.coalesce(*[f[k] for k in ("timestamp", "time", "date", "event_time", "datetime")]))))

    return let(F.get(fitting(rules, raw), F.lit(0)), of)


def apply_rules(lines: DataFrame, rules: DataFrame, priorities: dict[str, int], raw: str = "raw_log", p: str = "p", config: MinerConfig | None = None) -> DataFrame:
    """lines, whose column p is what the parsers made of them (null: nothing), with p filled by the rules and, at last, by the
    fallback. A parser of a higher priority than a rule's goes before it."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])[F.col(f"{p}.parser")], F.lit(0))
    met = with_candidates(lines, raw, rules, F.col(p).isNull(), rank < APPROVED, config)
    s = F.col(raw)
    found = F.coalesce(F.when(rank >= APPROVED, F.col(p)), _read(F.col("approved"), s), F.col(p), _read(F.col("learned"), s), fallback_lines(s))
    kept = [c for c in lines.columns if c != p]
    return met.select(*kept, F.explode_outer(F.array(found)).alias(p))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log; of equal orders any one, so orders should be unique."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("__n", n).where("__n = 1").drop("__n")


def novel(lines: DataFrame, parsed_col: str = "p") -> DataFrame:
    """Lines that no parser took: what the miner gets."""
    return lines.where(F.col(f"{parsed_col}.format") == "GENERIC_FALLBACK")


__all__ = ["MASKS", "MinerConfig", "Rule", "apply_rules", "latest", "learn", "mask", "mine", "novel", "sandbox", "signature", "synthesize"]
