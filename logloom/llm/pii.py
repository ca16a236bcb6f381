"""Personal data: fixed patterns, and a semi-Markov conditional random field that finds spans beside them.

The field scores whole candidate spans (counts, shapes, checks and surroundings of all their tokens together) for each kind; a
token outside of spans scores nothing. Viterbi over spans of bounded length picks boundaries and kinds jointly.
It is trained here, on windows around what the patterns find, on rewritten forms of those and on windows without any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

#: Kinds in the order of ties. Patterns are written so that no part is read twice.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
#: Longest span of the field, in tokens and characters, and the text around a hit that it sees.
TOKENS, CHARS, AROUND = 16, 64, 96
#: Windows a kind that the field is fitted on at most (of the smallest hash), and of windows without any; rounds of fitting.
SAMPLE, ROUNDS, DECAY = 100, 40, 2e-3
#: Rewritten forms of one window, fewer where there are many windows.
WAYS = 6
#: Text around a hit, and characters at most, of a window for the fit.
NEAR, PIECE = 40, 160
#: Log odds that a span of the field must have over none.
MARGIN = 2.0
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\n|[^\S\n]|.", re.DOTALL)
LETTERS, DIGITS, SPACE, LINE, AT, DOT, DASH, PLUS, BRACKET, OTHER, EDGE = range(11)
_KIND_OF = {"@": AT, ".": DOT, "-": DASH, "+": PLUS, **dict.fromkeys("()[]", BRACKET), "\n": LINE}
#: Lines of numbers that are no personal data.
CLEAN = (
    "on 2024-05-17 at 12:30 we", "in 1999 and 2003-2007 the", "price 1,299.00 or 3.14 each", "version 1.2.3 of 10.4", "pages 12-19, 4 of 250", "built 17.05.2023 for 45 %",
    "id 8f3a91c0de44b7 set", "ISBN 978-3-16-148410-0 here", "room 204, floor 3", "score 3-2 in 90 min", "sum of 1 000 000 and 25 000", "call 911 now", "at 5 p.m. on 3/4/21", "v2 @ 30 fps, 4 x 100 m",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find and the checks pass, in order; time linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@dataclass
class Tokens:
    """A text's tokens: where they start and end, and what they are."""

    text: str
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray

    def __len__(self) -> int:
        return len(self.kind)


def tokens(text: str, offset: int = 0) -> Tokens:
    start, end, kind = [], [], []
    for m in _TOKEN.finditer(text):
        x = text[m.start()]
        start.append(m.start() + offset)
        end.append(m.end() + offset)
        kind.append(DIGITS if "0" <= x <= "9" else _KIND_OF[x] if x in _KIND_OF else SPACE if x.isspace() else LETTERS if x.isalpha() else OTHER)
    return Tokens(text, np.array(start, np.int64), np.array(end, np.int64), np.array(kind, np.int64))


#: Values of each feature; a candidate has one value of each.
SIZES = {
    "one": 1, "digits": 21, "letters": 7, "at": 3, "dots": 6, "dashes": 5, "spaces": 5, "plus": 3, "brackets": 5, "others": 4, "groups": 63, "first": 11, "last": 11, "before": 11, "after": 11,
    "luhn": 3, "bytes": 3, "mixed": 63, "domain": 2, "lead": 42, "cue": 64,
}
_BASE = np.cumsum([0, *list(SIZES.values())[:-1]])
WIDTH = sum(SIZES.values())


def candidates(t: Tokens, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start token, tokens less one, features) of every span that may begin at tokens first to last - 1: it holds a digit
    or an @, no line end, no blank at its ends."""
    n = len(t)
    kind = np.concatenate([t.kind, np.full(TOKENS + 1, LINE)])
    size = np.concatenate([t.end - t.start, np.zeros(TOKENS + 1, np.int64)])
    begin = np.arange(first, last)
    at = begin[:, None] + np.arange(TOKENS)
    k, s = kind[at], size[at]
    count = lambda what, of=1: np.cumsum(np.where(k == what, of, 0), axis=1)
    digits, ats = count(DIGITS, s), count(AT)
    ok = (np.cumsum(k == LINE, axis=1) == 0) & (digits + ats > 0) & (np.cumsum(s, axis=1) <= CHARS) & (k != SPACE) & (k[:, :1] != SPACE) & (k != OTHER) & (k[:, :1] != OTHER)
    value = np.zeros(len(kind), np.int64)
    for i in np.flatnonzero(t.kind[first : min(n, last + TOKENS)] == DIGITS) + first:
        value[i] = min(int(t.text[t.start[i] - t.start[0] : t.end[i] - t.start[0]][:4]), 999) if size[i] <= 4 else 999
    groups, longest = count(DIGITS), np.maximum.accumulate(np.where(k == DIGITS, s, 0), axis=1)
    largest = np.maximum.accumulate(value[at], axis=1)
    row, length = np.nonzero(ok)
    start, end = begin[row], begin[row] + length
    take = lambda x: x[row, length]
    nd, letters, dots = take(digits), take(count(LETTERS, s)), take(count(DOT))
    few = np.searchsorted([1, 2, 3, 6, 11, 21], letters, side="right")
    before = np.where(start > 0, kind[start - 1], EDGE)
    after = np.where(end + 1 < n, kind[end + 1], EDGE)
    passes = np.zeros(len(start), np.int64)
    for i in np.flatnonzero((nd >= 12) & (nd <= 19) & (letters == 0)):
        span = t.text[t.start[start[i]] - t.start[0] : t.end[end[i]] - t.start[0]]
        passes[i] = 1 if luhn("".join(c for c in span if "0" <= c <= "9")) else 2
    four = (take(groups) == 4) & (letters == 0)
    ends = (ats[row, length] == 1) & (kind[end] == LETTERS) & (size[end] >= 2) & (size[end] <= 6) & (kind[np.maximum(end - 1, 0)] == DOT)
    named: dict[int, int] = {}
    cue = np.zeros(len(start), np.int64)
    for b in np.unique(start):
        word = next((i for i in range(b - 1, max(-1, b - 4), -1) if t.kind[i] == LETTERS), None)
        named[b] = 0 if word is None else 1 + zlib.crc32(t.text[t.start[word] - t.start[0] : t.end[word] - t.start[0]].lower().encode("utf-8", "replace")) % 63
    if len(start):
        cue = np.array([named[b] for b in start.tolist()])
    features = np.stack(
        [
            np.zeros_like(start), np.minimum(nd, 20), few, np.minimum(take(ats), 2), np.minimum(dots, 5), np.minimum(take(count(DASH)), 4), np.minimum(take(count(SPACE)), 4), np.minimum(take(count(PLUS)), 2),
            np.minimum(take(count(BRACKET)), 4), np.minimum(take(count(OTHER)), 3), np.minimum(take(groups), 6) * 9 + np.minimum(take(longest), 8), kind[start], kind[end], before, after, passes,
            np.where(four, np.where(take(largest) <= 255, 1, 2), 0), np.minimum(nd, 20) * 3 + np.minimum(few, 2), ends.astype(np.int64), (kind[start] == PLUS) * 21 + np.minimum(nd, 20), cue,
        ],
        axis=1,
    )
    return start, length, features + _BASE


@dataclass
class Field:
    """Weights of the features by kind, and the weight of a span right behind another."""

    weights: np.ndarray
    behind: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) if len(features) else np.zeros((0, len(KINDS)))

    def spans(self, t: Tokens, margin: float = MARGIN) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation, each span's score lowered by the margin."""
        found: dict[int, list[tuple[int, float, int]]] = {}
        for first in range(0, len(t), 2048):
            start, length, features = candidates(t, first, min(first + 2048, len(t)))
            s = self.scores(features) - margin
            best = s.argmax(axis=1) if len(s) else np.zeros(0, np.int64)
            for i in np.flatnonzero(s.max(axis=1, initial=-1) > 0):
                found.setdefault(int(start[i] + length[i] + 1), []).append((int(start[i]), float(s[i, best[i]]), int(best[i])))
        if not found:
            return []
        # two states at each place: the last token was none of a span, or ended one
        out, inside, came = np.zeros(len(t) + 1), np.full(len(t) + 1, -np.inf), {}
        for i in range(1, len(t) + 1):
            out[i] = max(out[i - 1], inside[i - 1])
            for at, s, kind in found.get(i, ()):
                total = s + max(out[at], inside[at] + self.behind)
                if total > inside[i]:
                    inside[i], came[i] = total, (at, kind)
        spans, i, in_span = [], len(t), inside[len(t)] > out[len(t)]
        while i > 0:
            if in_span:
                at, kind = came[i]
                spans.append((int(t.start[at]), kind, int(t.end[i - 1])))
                in_span = inside[at] + self.behind > out[at]
                i = at
            else:
                in_span = inside[i - 1] > out[i - 1]
                i -= 1
        return spans[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.log(np.exp(x - top).sum(axis=axis) + 1e-300) + np.squeeze(top, axis)


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS, decay: float = DECAY, rate: float = 0.5) -> Field | None:
    """Largest conditional likelihood of windows (text, spans in order that do not overlap), by forward and backward sums over
    all segmentations of all windows at once; None without any span."""
    made = []
    for text, spans in windows:
        t = tokens(text)
        if len(t):
            made.append((t, {(s, e, k) for s, k, e in spans}))
    if not any(spans for _, spans in made):
        return None
    n, long, kinds = len(made), max(len(t) for t, _ in made), len(KINDS)
    who, start, length, features = [], [], [], []
    gold, gold_behind = [], 0
    for i, (t, spans) in enumerate(made):
        s, l, f = candidates(t, 0, len(t))
        who.append(np.full(len(s), i))
        start.append(s)
        length.append(l)
        features.append(f)
        of = {(a, b): k for a, b, k in spans}
        gold += [of.get((int(t.start[a]), int(t.end[a + b])), -1) for a, b in zip(s.tolist(), l.tolist(), strict=True)]
        ends = {b for _, b, _ in spans}
        gold_behind += sum(a in ends for a, _, _ in spans)
    who, start, length, features, gold = np.concatenate(who), np.concatenate(start), np.concatenate(length), np.concatenate(features), np.array(gold)
    weights, behind = np.zeros((WIDTH, kinds)), -1.0
    squares, square = np.full((WIDTH, kinds), 1e-8), 1e-8
    truth = np.zeros((WIDTH, kinds))
    for k in range(kinds):
        truth[:, k] = np.bincount(features[gold == k].ravel(), minlength=WIDTH)
    for _ in range(rounds):
        s = weights[features].sum(axis=1)
        any_kind = np.full((n, long + TOKENS, TOKENS), -np.inf)
        any_kind[who, start, length] = _log_sum(s, 1)
        out, inside = np.zeros((n, long + 1)), np.full((n, long + 1), -np.inf)
        before = np.zeros((n, long + 1))  # log sum of what leads to a span that begins here
        for i in range(1, long + 1):
            l = np.arange(min(i, TOKENS))
            inside[:, i] = _log_sum(before[:, i - 1 - l] + any_kind[:, i - 1 - l, l], 1)
            out[:, i] = np.logaddexp(out[:, i - 1], inside[:, i - 1])
            before[:, i] = np.logaddexp(out[:, i], inside[:, i] + behind)
        total = np.logaddexp(out[:, long], inside[:, long])
        rest_out, rest_in = np.zeros((n, long + TOKENS + 1)), np.zeros((n, long + TOKENS + 1))
        spanned = np.full((n, long + 1), -np.inf)
        for i in range(long - 1, -1, -1):
            l = np.arange(TOKENS)
            spanned[:, i] = _log_sum(any_kind[:, i, l] + rest_in[:, i + 1 + l], 1)
            rest_out[:, i] = np.logaddexp(rest_out[:, i + 1], spanned[:, i])
            rest_in[:, i] = np.logaddexp(rest_out[:, i + 1], behind + spanned[:, i])
        odds = np.exp(before[who, start] + rest_in[who, start + length + 1] - total[who])[:, None] * np.exp(s)
        gradient = truth.copy()
        for k in range(kinds):
            gradient[:, k] -= np.bincount(features.ravel(), np.repeat(odds[:, k], features.shape[1]), WIDTH)
        gradient = gradient / n - decay * weights
        twice = np.exp(inside[:, : long + 1] + behind + spanned - total[:, None]).sum()
        slope = (gold_behind - twice) / n - decay * behind
        squares += gradient**2
        square += slope**2
        weights += rate * gradient / np.sqrt(squares)
        behind = min(0.0, behind + rate * slope / np.sqrt(square))
    return Field(weights, float(behind))


def regions(text: str, around: int = AROUND) -> Iterator[tuple[int, int]]:
    """Parts of a text that hold all spans around digits and @, and what the field sees beside them."""
    begin, end = None, 0
    for m in _HIT.finditer(text):
        at = m.start()
        if begin is None:
            begin, end = max(0, at - around), at + 1 + around
        elif at - around > end:
            yield begin, min(end, len(text))
            begin, end = at - around, at + 1 + around
        else:
            end = at + 1 + around
    if begin is not None:
        yield begin, min(end, len(text))


def added_spans(field: Field | None, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field that touch none of the base."""
    if field is None:
        return []
    taken = np.zeros(len(text) + 1, bool)
    for s, _, e in base:
        taken[s:e] = True
    out = []
    for a, b in regions(text):
        if not all(taken[m.start() + a] for m in _HIT.finditer(text[a:b])):
            out += [x for x in field.spans(tokens(text[a:b], a)) if not taken[x[0] : x[2]].any()]
    return out


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans that overlap the longest stays; none longer than the field's."""
    kept: list = []
    for x in sorted(spans, key=lambda x: (x[0] - x[2], x)):
        if x[2] - x[0] <= CHARS and all(x[2] <= y[0] or x[0] >= y[2] for y in kept):
            kept.append(x)
    return sorted(kept)


def windows_of(text: str) -> list[str]:
    """Parts around the text's digits and @, cut at blanks where there are any near."""
    out = []
    for a, b in regions(text, NEAR):
        for at in range(a, b, PIECE):
            to = min(b, at + PIECE)
            left = at if at == 0 else next((i for i in range(at, min(at + NEAR // 2, to)) if text[i].isspace()), at)
            right = to if to == len(text) else next((i for i in range(to, max(to - NEAR // 2, left), -1) if text[i].isspace()), to)
            out.append(text[left:right])
    return out


def rewritten(text: str, spans: list[tuple[int, int, int]], way: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The window with its spans in other spellings that the patterns miss: parted by other marks, without a plus, with
    brackets. Cards whose check fails after a changed digit become no span."""
    out, found, at = "", [], 0
    for start, kind, end in spans:
        own, is_span = text[start:end], True
        if kind == 0:
            own = own.replace("@", (" @ ", "(@)", "[@]")[way % 3], 1)
        elif kind == 1:
            own = own.replace(".", ("[.]", "(.)", " . ")[way % 3])
        elif kind == 2:
            digits = "".join(c for c in own if c.isdigit())
            if way % 2:
                digits, is_span = digits[:5] + str((int(digits[5]) + 1 + way % 7) % 10) + digits[6:], False
            own = (".", "/", ". ")[way % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
            is_span = is_span and luhn(digits)
        else:
            digits = re.findall(r"[0-9]+", own)
            if len(digits) > 2:
                own = (f"({digits[1]}) " + "-".join(digits[2:]), "-".join(digits[1:]), "00" + " ".join(digits), ".".join(digits[1:]))[way % 4]
        out += text[at:start]
        if is_span:
            found.append((len(out), kind, len(out) + len(own)))
        out += own
        at = end
    return out + text[at:], [x for x in found if x[2] - x[0] <= CHARS]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """Fitted on at most `sample` windows a kind, and as many without any span, of the smallest hash over the whole table: a
    bound of the fit, not of what is searched."""

    @F.arrow_udf("array<struct<kind: int, window: string>>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            seen: dict[int, int] = {}
            own = []
            for part in windows_of(x or ""):
                spans = _apart(base_spans(part))
                kind = spans[0][1] if spans else len(KINDS)
                seen[kind] = seen.get(kind, 0) + 1
                if seen[kind] <= 3:  # no more than a few of one text, so that the sample is of many
                    own.append({"kind": kind, "window": part})
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("window", pa.string())])))

    made = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.explode(cut(F.col(text_col))).alias("w")).select("w.kind", "w.window")
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64(F.lit("sample"), "window"), "window"))
    chosen = made.withColumn("n", first).where(F.col("n") <= sample).orderBy("kind", "n").collect()
    windows: list = [(x, []) for x in CLEAN]
    ways = min(WAYS, max(1, 2 * sample * len(KINDS) // max(1, len(chosen))))
    for i, r in enumerate(chosen):
        own = (r["window"], _apart(base_spans(r["window"])))
        windows.append(own)
        if own[1]:
            windows += [rewritten(*own, i + way) for way in range(ways)]
    return fit(windows)


SPANS = "array<struct<start: int, kind: int, end: int>>"


def find(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs with `base` and `added`: arrays of struct<start, kind, end> (kind a place in KINDS, code points, end exclusive),
    by start and kind.

    base has the leftmost matches of each pattern that pass their check; added has the field's spans, none of which touches a
    base span. A field span holds a digit or an @ and at most TOKENS tokens and CHARS characters, in one line; texts
    without such a character are not looked at further. Null and empty texts have no spans; rows stay as they are, repeated ones
    too, an empty table stays empty; columns named base or added are replaced.
    """
    field = train(docs, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"struct<base: {SPANS}, added: {SPANS}>")
    def spans(texts: pa.Array) -> pa.Array:
        base, added = [], []
        named = lambda xs: [{"start": s, "kind": k, "end": e} for s, k, e in xs]
        for x in texts:
            text = x.as_py() or ""
            own = base_spans(text)
            base.append(named(own))
            added.append(named(added_spans(shared.value, text, own)) if text else [])
        return pa.StructArray.from_arrays([pa.array(base, kind), pa.array(added, kind)], ["base", "added"])

    (found,) = common.free(docs, "found")
    looked = F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col))
    out = docs.withColumn(found, spans(looked))
    return out.withColumns({"base": F.col(f"{found}.base"), "added": F.col(f"{found}.added")}).drop(found)


def listed(spans: Column) -> Column:
    """`kind:start:end` of the spans by start, then kind, joined by commas."""
    name = lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), name), ",")
