"""Edit-aware token counts: segment trees over pre-tokens, re-encoded only where edits touch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logloom.llm import bpe

#: A leaf: what stands between blanks, with the blanks behind it. No pre-token and no special token holds a blank, so
#: the token counts of leaves add up.
_LEAF = re.compile(r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+")
_BLANK = frozenset(" \t\n\x0b\x0c\r")
#: Children of a node.
FAN = 16
#: Leaves whose counts a Python worker keeps.
HELD = 250_000

TREE = "struct<leaves: int, chars: array<int>, tokens: array<int>>"
EDIT = "struct<at: int, cut: int, put: string>"


Levels = list[np.ndarray]


def leaves(text: str) -> list[str]:
    """The leaves of a text, one for each blank-closed word; an empty text has one empty leaf."""
    return _LEAF.findall(text) or [""]


def tree(sums: np.ndarray) -> list[np.ndarray]:
    """Levels of a segment tree: the leaves' values, then the sums of FAN nodes each, up to the root alone."""
    levels = [sums]
    while len(levels[-1]) > 1:
        levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
    return levels


def unpacked(flat: np.ndarray, n: int) -> list[np.ndarray]:
    """Levels of a tree of n leaves from their concatenation."""
    levels, at = [], 0
    while True:
        levels.append(flat[at : at + n])
        if n <= 1:
            return levels
        at, n = at + n, -(-n // FAN)


def find(levels: list[np.ndarray], at: int) -> tuple[int, int]:
    """Leaf that holds position at (the last one, if at is the end), and where that leaf starts."""
    i, start = 0, 0
    for level in reversed(levels[:-1]):
        upto = np.cumsum(level[i * FAN : i * FAN + FAN])
        j = min(int(np.searchsorted(upto, at - start, "right")), len(upto) - 1)
        start += int(upto[j - 1]) if j else 0
        i = i * FAN + j
    return i, start


def splice(levels: list[np.ndarray], first: int, last: int, new: np.ndarray) -> list[np.ndarray]:
    """The tree with leaves first to last replaced; sums above them are brought up to date, and those of later
    nodes only if their number changes."""
    same = len(new) == last + 1 - first
    out = [np.concatenate([levels[0][:first], new, levels[0][last + 1 :]])]
    for level in levels[1:]:
        if len(out[-1]) == 1:
            return out
        first, last = first // FAN, last // FAN
        below = out[-1]
        to = (last + 1) * FAN if same else len(below)
        part = below[first * FAN : to]
        sums = np.add.reduceat(part, np.arange(0, len(part), FAN)) if len(part) else part
        out.append(np.concatenate([level[:first], sums, level[last + 1 :]]) if same else np.concatenate([level[:first], sums]))
    return [*out[:-1], *tree(out[-1])]


def edited(text: str, chars: list[np.ndarray], at: int, cut: int, new: str) -> tuple[str, list[np.ndarray], int, int, list[str]]:
    """One edit: the text and the tree of characters after it, and the leaves (first, last, new ones) that changed.

    Those are the leaves that the edit touches, and the next one if the blank before it is lost.
    """
    total = int(chars[-1][0])
    at = max(0, min(at, total))
    cut = max(0, min(cut, total - at))
    first, start = find(chars, at)
    last, end = find(chars, at + cut)
    end += int(chars[0][last])
    region = text[start:at] + new + text[at + cut : end]
    while last + 1 < len(chars[0]) and (not region or region[-1] not in _BLANK):
        last += 1
        region += text[end : end + int(chars[0][last])]
        end += int(chars[0][last])
    own = leaves(region)
    return text[:start] + region + text[end:], splice(chars, first, last, np.array([len(x) for x in own], np.int32)), first, last, own


class Counts:
    """Tokens of leaves; new ones are encoded together."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = bpe.tokenizer(path), {}

    def of(self, groups: list[list[str]]) -> Iterator[np.ndarray]:
        """The token counts of each group's leaves."""
        new = set(chain.from_iterable(groups))
        if len(self.known) + len(new) > HELD:
            self.known.clear()
        new = [x for x in new if x not in self.known]
        if new:
            split = [self.tokenizer.pieces(x) for x in new]
            self.tokenizer.learn(set(chain.from_iterable(split)))
            ids = self.tokenizer.known
            self.known.update(zip(new, [sum([len(ids[w]) for w in words]) // 4 for words in split], strict=True))
        known = self.known.__getitem__
        for own in groups:
            yield np.fromiter(map(known, own), np.int32, len(own))


@cache
def counts(path: str) -> Counts:
    """One per Python worker and path."""
    return Counts(path)


def _runs(sizes: list[int]) -> Iterator[range]:
    """Neighbouring rows of about bpe.TOGETHER characters."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= bpe.TOGETHER or i == len(sizes) - 1:
            yield range(first, i + 1)
            first, size = i + 1, 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def _trees(chars: list[Levels], tokens: list[Levels]) -> pa.StructArray:
    flat = lambda trees: _lists([np.concatenate(t) for t in trees])
    return pa.StructArray.from_arrays([pa.array([len(t[0]) for t in chars], pa.int32()), flat(chars), flat(tokens)], ["leaves", "chars", "tokens"])


def build(text: str | Column, path: str) -> Column:
    """struct<leaves, chars, tokens>: the segment trees of a text, level by level from the leaves, the root last; a null
    or empty text is one empty leaf."""

    @F.arrow_udf(TREE)
    def of(texts: pa.Array) -> pa.Array:
        chars, tokens = [], []
        given = [x or "" for x in texts.to_pylist()]
        for run in _runs([len(x) for x in given]):
            own = _built([given[i] for i in run], counts(path))
            chars += [c for c, _ in own]
            tokens += [t for _, t in own]
        return _trees(chars, tokens)

    return of(text)


def _built(texts: list[str], of: Counts) -> list[tuple[Levels, Levels]]:
    cut = [leaves(x) for x in texts]
    return [(tree(np.fromiter(map(len, own), np.int32, len(own))), tree(n)) for own, n in zip(cut, of.of(cut), strict=True)]


def _applied(texts: list[str], trees: list[tuple[Levels, Levels]], edits: list[list | None], of: Counts) -> list[tuple[str, Levels, Levels, int]]:
    """(text, trees, characters encoded again) of each document after its edits; the leaves that changed in any of them are counted together."""
    out, changed = [], []
    for i, (x, (chars, tokens), own) in enumerate(zip(texts, trees, edits, strict=True)):
        size = 0
        for e in own or []:
            if e is not None:
                x, chars, first, last, new = edited(x, chars, e["at"] or 0, e["cut"] or 0, e["put"] or "")
                changed.append((i, first, last, new))
                size += sum(map(len, new))
        out.append((x, chars, tokens, size))
    for (i, first, last, _), values in zip(changed, of.of([new for *_, new in changed]), strict=True):
        x, chars, tokens, size = out[i]
        out[i] = (x, chars, splice(tokens, first, last, values), size)
    return out


def apply_edits(text: str | Column, trees: str | Column, edits: str | Column, path: str) -> Column:
    """struct<text, tree, encoded>: the text and its trees after the edits, and the characters encoded again: those of the
    leaves that edits touch.

    edits: array of struct<at, cut, put>, in order, each on the text that the ones before it left: at
    `at` (code points from 0) `cut` are taken out and `put` comes in. Positions outside the text are
    moved to its nearest end; a null edit or a null list changes nothing, a null put is empty.
    """

    @F.arrow_udf(f"struct<text: string, tree: {TREE}, encoded: int>")
    def of(texts: pa.Array, trees: pa.Array, edits: pa.Array) -> pa.Array:
        given, n = [x or "" for x in texts.to_pylist()], trees.field("leaves").to_pylist()
        chars, tokens = ([x.values.to_numpy() for x in trees.field(k)] for k in ("chars", "tokens"))
        out = []
        for run in _runs([len(x) for x in given]):
            own = [(unpacked(chars[i], n[i]), unpacked(tokens[i], n[i])) for i in run]
            out += _applied([given[i] for i in run], own, [edits[i].as_py() for i in run], counts(path))
        texts_after, chars, tokens, encoded = zip(*out, strict=True) if out else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(texts_after, pa.string()), _trees(chars, tokens), pa.array(encoded, pa.int32())], ["text", "tree", "encoded"])

    return of(text, trees, edits)


def recount(docs: DataFrame, edits: str | Column, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("text", "tree")) -> DataFrame:
    """(id_col, text, tree, n_before, n_after, n_chars, encoded) of every row, repeated rows and null ids included; `edits`
    is an array column of docs, as in apply_edits(), n_chars the length after them. An empty table gives none; other
    columns are not looked at.

    Trees are built and edits applied in one pass, in runs of about bpe.TOGETHER characters, which is what a
    worker holds; what `keep` does not name (the text, the tree) is not given out.
    """

    def run(keys: list, texts: list[str], own: list) -> pa.RecordBatch:
        built = _built(texts, counts(path))
        done = _applied(texts, built, own, counts(path))
        after, chars, tokens, encoded = zip(*done, strict=True)
        root = lambda trees: pa.array([int(t[-1][0]) for t in trees], pa.int32())
        columns = {id_col: pa.array(keys, kind), "text": pa.array(after, pa.string()) if "text" in keep else None, "tree": _trees(chars, tokens) if "tree" in keep else None}
        columns |= {"n_before": root([t for _, t in built]), "n_after": root(tokens), "n_chars": root(chars), "encoded": pa.array(encoded, pa.int32())}
        return pa.record_batch({k: v for k, v in columns.items() if v is not None})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, own, size = [], [], [], 0
        for batch in batches:
            for key, text, e in zip(*batch.columns, strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                own.append(e.as_py())
                size += len(texts[-1])
                if size >= bpe.TOGETHER:
                    yield run(keys, texts, own)
                    keys, texts, own, size = [], [], [], 0
        if keys:
            yield run(keys, texts, own)

    kind = to_arrow_type(docs.schema[id_col].dataType)
    given = docs.select(F.col(id_col), F.col(text_col), (F.col(edits) if isinstance(edits, str) else edits).alias("edits"))
    more = [f"{k}: {t}" for k, t in {"text": "string", "tree": TREE}.items() if k in keep]
    schema = T.StructType.fromDDL(", ".join([*more, "n_before: int, n_after: int, n_chars: int, encoded: int"]))
    return given.mapInArrow(of, T.StructType([docs.schema[id_col], *schema.fields]))
