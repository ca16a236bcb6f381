"""BPE encoding and decoding: greedy proposals, vectorised checks of adjacent pairs, exact merges for the rest."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words whose ids a Python worker keeps; beyond it the memory starts anew.
HELD_WORDS = 100_000
#: Failed words whose merges run side by side.
MERGED_AT_ONCE = 20_000
#: Stands for the end-of-word suffix; no byte has it as its symbol.
END = "\n"
_LEAF, NONE = -1, 1 << 31


def _packed(ids: list[int] | np.ndarray) -> bytes:
    return np.asarray(ids, np.int32).tobytes()


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it prints, else 256 onwards in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class WordBpe:
    """A tokenizers file of kind BPE with an end-of-word suffix, a Split pattern and byte-level symbols.

    In such a file ids follow the symbols in the order of the merges, so that an id is its merge's rank.
    """

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.added}.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.full(len(self.ids), _LEAF, np.int32)
        self.right = np.full(len(self.ids), _LEAF, np.int32)
        x, y, new = (np.array([self.ids[w] for w in words], np.int64) for words in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.left[new], self.right[new] = x, y
        order = np.argsort(x << 32 | y)
        self.keys, self.made = (x << 32 | y)[order], new[order]
        self.symbols = _byte_symbols()
        close = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) else t
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.ids.items():
            self.trie.add_word(close(t), i << 8 | len(close(t)))  # no token has 256 symbols
        self.trie.make_automaton()
        self.single = {close(t): i for t, i in self.ids.items() if len(close(t).rstrip(END)) == 1}
        # white space as Unicode has it; Python's \s would add \x1c-\x1f
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split.replace(r"[^\s", f"[^{blank}"))
        ascii_only = self.pattern.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(blank, r"\t-\r ")
        self.ascii_pattern = re.compile(ascii_only)  # the same on lower-cased ASCII, in less time
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.known = {t: _packed([i]) for t, i in self.added.items()}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens: NFC, lower case by character, pattern."""
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # no final sigma by context
        return self.pattern.findall(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens that stand in the text (kept as they are, so no word can equal one)."""
        if self.specials is None or "<|" not in text:
            return self.words(text)
        split = enumerate(self.specials.split(text))
        return [x for i, part in split for x in ([part] if i % 2 else self.words(part))]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of new words, packed as int32, in self.known: all are proposed, then all pairs are checked, then the failed are merged."""
        new = sorted([w for w in words if w not in self.known])
        if len(self.known) + len(new) > HELD_WORDS:
            self.known = {t: _packed([i]) for t, i in self.added.items()}
            new = sorted([w for w in words if w not in self.known])
        if not new:
            return
        # one string of all words; END stands for the suffix, which ends every word
        spelled = [w if w.isascii() and w.isprintable() else "".join([self.symbols[b] for b in w.encode()]) for w in new]
        text = END.join(spelled) + END
        ends = np.cumsum([len(w) + 1 for w in spelled])
        found = np.fromiter(chain.from_iterable(self.trie.iter_long(text)), np.int64).reshape(-1, 2)
        tokens, chars = found[:, 1] >> 8, found[:, 1] & 0xFF
        word = np.searchsorted(ends, found[:, 0], side="right")
        sizes = np.bincount(word, minlength=len(new))
        # a token that crosses no word border, with nothing left between, is a proposal
        covered = np.bincount(word, chars, len(new)) == [len(w) + 1 for w in spelled]
        inside = np.flatnonzero(word[1:] == word[:-1])
        codes, at = np.unique(tokens[inside] << 32 | tokens[inside + 1], return_inverse=True)
        fits = self.compatible(codes >> 32, codes & 0xFFFFFFFF)
        covered[word[inside[~fits[at]]]] = False
        ids, cuts = _packed(tokens), [0, *np.cumsum(4 * sizes).tolist()]
        for i in np.flatnonzero(covered).tolist():
            self.known[new[i]] = ids[cuts[i] : cuts[i + 1]]
        failed = np.flatnonzero(~covered).tolist()
        for at in range(0, len(failed), MERGED_AT_ONCE):
            part = failed[at : at + MERGED_AT_ONCE]
            for i, own in zip(part, self._merged([spelled[i] for i in part]), strict=True):
                self.known[new[i]] = own

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """True where BPE of the two tokens' joint text gives back the two tokens.

        Undoes merges from the later one back: at each boundary pair, a merge of that pair with a
        rank below the last one undone would have come first and have joined the tokens.
        """
        ok, left, right = np.ones(len(left), bool), left.copy(), right.copy()
        limit, open_ = np.full(len(left), np.iinfo(np.int64).max), np.arange(len(left))
        while len(open_):
            x, y = left[open_], right[open_]
            code = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            joins = (self.keys[at] == code) & (self.made[at] < limit[open_])
            ok[open_[joins]] = False
            open_, x, y = open_[~joins], x[~joins], y[~joins]
            # the side that was made later is undone first; at equal ids the right one was made later in the text
            undo_left = x > y
            can_left, can_right = self.left[x] != _LEAF, self.left[y] != _LEAF
            go_left = np.where(undo_left, can_left, ~can_right & can_left)
            go_right = ~go_left & can_right
            limit[open_] = np.where(go_left, x, np.where(go_right, y + 1, 0))
            left[open_] = np.where(go_left, self.right[x], x)
            right[open_] = np.where(go_right, self.left[y], y)
            open_ = open_[go_left | go_right]
        return ok

    def _merged(self, spelled: list[str]) -> list[bytes]:
        """Exact BPE of many words at once: each round joins every word's pair of lowest rank, the leftmost of equals."""
        ids = np.array([self.single[c] for w in spelled for c in [*w[:-1], w[-1] + END]], np.int64)
        word = np.repeat(np.arange(len(spelled)), [len(w) for w in spelled])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            made = np.full(len(ids), NONE, np.int64)
            code = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            made[:-1] = np.where((self.keys[at] == code) & (word[:-1] == word[1:]), self.made[at], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(made * len(ids) + np.arange(len(ids)), starts)  # by rank, then place
            goes = best < NONE * len(ids)
            rest = np.repeat(~goes, lengths)
            done.append((word[rest], ids[rest]))
            place = best[goes] % len(ids)
            ids[place] = best[goes] // len(ids)
            keep = ~rest
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        words, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(words, kind="stable")
        cuts = (4 * np.searchsorted(words[order], np.arange(len(spelled) + 1))).tolist()
        flat = _packed(ids[order])
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new words of all texts are learned together."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a blank, the file having no decoder; ids that the vocabulary lacks are left out."""
        try:
            return " ".join([self.tokens[i] for i in ids])
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@cache
def tokenizer(path: str) -> WordBpe:
    """One per Python worker and path."""
    return WordBpe(path)


#: Characters of documents whose new words are proposed and checked together.
TOGETHER = 1 << 20


def encode(text: str | Column, path: str) -> Column:
    """array<int> of ids, special tokens of the text as their own ids, none added; null: empty.

    Documents are worked on in runs of about TOGETHER characters so that pair checks are large arrays.
    """

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        bpe, out, run, size = tokenizer(path), [], [], 0
        for i, x in enumerate(texts):
            run.append(x.as_py() or "")
            size += len(run[-1])
            if size >= TOGETHER or i == len(texts) - 1:
                out += bpe.encode(run)
                run, size = [], 0
        offsets = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))

    return of(text)


def decode(ids: str | Column, path: str) -> Column:
    """Text of array<int> ids; a null array gives null, unknown or null ids are left out."""

    @F.arrow_udf("string")
    def of(arrays: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        flat = arrays.flatten()
        if flat.null_count:
            return pa.array([None if a is None else bpe.decode([i for i in a if i is not None]) for a in arrays.to_pylist()], pa.string())
        flat = flat.to_numpy()
        ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        spans = zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else []
        return pa.array([bpe.decode(flat[a:b].tolist()) if x else None for (a, b), x in zip(spans, arrays.is_valid().to_pylist(), strict=True)], pa.string())

    return of(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every row, repeated rows included; null texts have no ids and decode to ''.

    Decoding gives the normalised tokens, not the text. Rows come and go in runs of about TOGETHER
    characters, so a worker holds one Arrow batch of texts and one run, however long the documents are.
    """

    def run(bpe: WordBpe, keys: list, texts: list[str]) -> pa.RecordBatch:
        ids = bpe.encode(texts)
        offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
        return pa.record_batch([pa.array(keys, kind), lists, pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())], [id_col, "ids", "decoded"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, keys, texts, size = tokenizer(path), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield run(bpe, keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield run(bpe, keys, texts)

    kind = to_arrow_type(docs.schema[id_col].dataType)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(of, schema)
