"""Quality rules: base counts of words and lines, and bands of n-gram perplexity by language."""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import common, ngrams

#: Characters of an n-gram: true code points, as the text has them. What is counted grows with the input.
N = 5
UNKNOWN = "und"
#: A band reaches from the median by so many spreads down and up (of the middle 80 %, in standard deviations of a
#: normal distribution), each side at least LEAST in log perplexity.
SPREADS, LEAST = (6.0, 4.0), 0.05
#: Entries (12 bytes each) of the models that workers hold at once; more are scored in several passes.
PACK = 1 << 23
SYMBOLS = frozenset("#*$%&|<>")
#: Hash of no symbols.
START = 0x632BE59BD9B4E019
_DROP_SYMBOLS = str.maketrans("", "", "".join(SYMBOLS))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: zeros.

    Words are runs without ASCII white space. A repeated word lies in a 3-word window that the text holds
    twice or more, the first time included.
    """
    words = text.encode().split() if text else []
    if not words:
        return 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(text) - len(text.translate(_DROP_SYMBOLS)) if not text.isascii() else sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            n, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if n[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


@cache
def _marks() -> np.ndarray:
    """True for each code point that is neither letter, combining mark, digit nor white space."""
    return np.array([not (chr(i).isalnum() or chr(i).isspace() or unicodedata.category(chr(i))[0] == "M") for i in range(0x110000)])


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of a text in pieces of about PART, each after the N - 1 before it (0 before the first). A run of one
    mark counts as one."""
    codes = ngrams.code_points(text)
    again = codes[1:] == codes[:-1]
    if again.any():
        again &= _marks()[codes[1:]]
        codes = codes[np.concatenate([[True], ~again])]
    return ngrams.parts(np.concatenate([np.zeros(N - 1, np.uint32), codes]), N)


def _mixed(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    h = (h ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def hashes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of order N. The last symbol goes in first, so that each order's hash continues the one below."""
    wide, h = symbols.astype(np.uint64), np.uint64(START)
    for k in range(N):
        h = _mixed(h, wide[N - 1 - k : len(wide) - k])
    return h


def _part(symbol: np.ndarray, parts: int) -> np.ndarray:
    return _mixed(np.uint64(7), symbol.astype(np.uint64)) % np.uint64(parts)


#: Bits of a symbol within a task, and characters whose n-grams are sorted together.
BITS, SORTED = 60 // N, 1 << 22


def _distinct(symbols: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The distinct n-grams of a run of symbols and their counts, those left out that reach from a fresh symbol's text into
    the one before. Symbols are numbered within the run, which is halved while it has more than BITS can tell."""
    own = np.zeros(0x110000, np.int64)
    own[symbols] = 1
    alphabet = np.flatnonzero(own)
    if len(alphabet) > 1 << BITS:
        half = len(symbols) // 2
        yield from _distinct(symbols[: half + N - 1], fresh[: half + N - 1])
        yield from _distinct(symbols[half:], fresh[half:])
        return
    own[alphabet] = np.arange(len(alphabet))
    ids = own[symbols]
    keys = ids[: len(ids) - N + 1].copy()
    for k in range(1, N):
        keys = keys << BITS | ids[k : len(ids) - N + 1 + k]
    keys, n = np.unique(keys[~fresh[N - 1 :]], return_counts=True)
    rows = np.stack([alphabet[keys >> BITS * (N - 1 - k) & (1 << BITS) - 1] for k in range(N)], axis=1).astype("<u4")
    text = rows.tobytes().decode("utf-32-le")
    yield [text[at : at + N] for at in range(0, len(text), N)], n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of order N and their counts; each task adds up its own as far as HELD allows, Spark the rest."""
    waiting: dict[str, list[np.ndarray]] = {}
    counts: dict[str, Counter[str]] = {}
    held = 0

    def settle() -> None:
        for lang, texts in waiting.items():
            symbols, fresh = np.concatenate(texts), np.concatenate([np.arange(len(x)) < N - 1 for x in texts])
            own = counts.setdefault(lang, Counter())
            for grams, n in _distinct(symbols, fresh):
                own.update(dict(zip(grams, n.tolist(), strict=True)))
        waiting.clear()

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(own), pa.string()), "gram": pa.array(list(own), pa.string()), "n": pa.array(list(own.values()), pa.int64())})
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for piece in _pieces(text.as_py()):
                waiting.setdefault(lang.as_py(), []).append(piece)
                held += len(piece)
                if held >= SORTED:
                    settle()
                    held = 0
                    if sum(map(len, counts.values())) >= HELD:
                        yield from hand_on()
    settle()
    yield from hand_on()


#: Distinct n-grams that a task holds before it hands their counts on.
HELD = 1 << 20


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of counts of 1, 2 and 3 or more, from the counts of
    counts; halves of the counts where those are too few."""
    of = [F.count_if(F.col("n") == i).alias(f"t{i}") for i in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    few = F.least("t1", "t2", "t3", "t4") == 0
    d = [F.when(few, 0.5 * i).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95 * i), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")))).alias(f"d{i}") for i in (1, 2, 3)]
    return grams.groupBy("lang").agg(*of).select("lang", *d)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes, as hashes() gives them, and symbols of n-grams (level above 0) and contexts."""
    for batch in batches:
        level, given = batch["level"].to_numpy(), batch["gram"].to_pylist()
        sizes = np.where(level > 0, level, -level)
        h, symbol = np.full(len(given), START, np.uint64), np.full(len(given), -1, np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            size = int(sizes[own[0]])
            symbols = np.frombuffer("".join([given[i] for i in own]).encode("utf-32-le"), "<u4").reshape(len(own), size)
            at = h[own]
            for i in range(size - 1, -1, -1):
                at = _mixed(at, symbols[:, i].astype(np.uint64))
            h[own] = at
            if size > (k > 0):
                symbol[own] = symbols[:, -2 if k > 0 else -1]
        yield pa.record_batch({"lang": batch["lang"], "level": batch["level"], "symbol": pa.array(symbol), "hash": pa.array(h.view(np.int64)), "value": batch["value"]})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", folder: str | None = None) -> DataFrame:
    """(lang, level, symbol, hash, value): modified Kneser-Ney models of all texts, interpolated down to single symbols
    and there with a uniform share for unseen ones. Null languages share one model.

    Everything is counted, discounted and interpolated by Spark. Level k of 1 to N holds the probability of each seen
    n-gram of order k, level -k the back-off weight of each seen context of k symbols; symbol is the one before the
    last of an n-gram, the last of a context (-1 where there is none). The models lie in folder, a new one below the shared
    one if none is named; the counts they come from are removed.
    """
    folder = folder or new_folder(docs)
    given = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    # few tasks of many texts add up more n-grams before they are shuffled than many tasks of few
    given = given.coalesce(8 * docs.sparkSession.sparkContext.defaultParallelism)
    counted = given.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = {N: common.written(counted, f"{folder}/counts/{N}")}
    for k in range(N - 1, 0, -1):  # lower orders count the distinct symbols to the left
        suffix = F.substring("gram", 2, k).alias("gram")
        grams[k] = common.written(grams[k + 1].groupBy("lang", suffix).agg(F.count("*").alias("n")), f"{folder}/counts/{k}")
    lower, out = None, []
    for k in range(1, N + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.substring("gram", 1, k - 1)
        own = grams[k].join(common.small(_discounts(grams[k])), "lang").select("lang", "gram", context.alias("context"), "n", taken.alias("taken"))
        totals = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("weight"))
        if k == 1:  # one of 2 ** 20 symbols, if none was seen
            below = own.withColumn("below", F.lit(2.0**-20))
        else:
            below = own.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("value").alias("below")), ["lang", "suffix"])
        value = (F.col("n") - F.col("taken")) / F.col("total") + F.col("weight") * F.col("below")
        lower = common.written(below.join(totals, ["lang", "context"]).select("lang", "gram", value.alias("value")), f"{folder}/counts/lower-{k}")
        own = lower.select("lang", F.lit(k).alias("level"), "gram", F.col("value").cast("float").alias("value"))
        weights = totals.select("lang", F.lit(1 - k).alias("level"), F.col("context").alias("gram"), F.col("weight").cast("float").alias("value"))
        out = [*out, own, weights]
    entries = common.written(reduce(DataFrame.unionByName, out).mapInArrow(_entries, "lang string, level int, symbol long, hash long, value float"), f"{folder}/entries")
    common.remove(docs.sparkSession, f"{folder}/counts")
    return entries


def new_folder(docs: DataFrame) -> str:
    return f"{common.shared_folder(docs.sparkSession)}/models-{uuid.uuid4().hex}"


class Model:
    """One language's model in sorted arrays of hashes, or the part of it for what follows one group of symbols."""

    def __init__(self, level: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> None:
        self.levels = {}
        for k in range(1 - N, N + 1):
            own = np.flatnonzero(level == k)
            own = own[np.argsort(hashes[own])]
            self.levels[k] = hashes[own], values[own]

    def look_up(self, level: int, h: np.ndarray, absent: float) -> np.ndarray:
        known, values = self.levels[level]
        if not len(known):
            return np.full(len(h), absent)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, values[at], absent).astype(float)

    def probability(self, grams: list[np.ndarray], contexts: list[np.ndarray], order: int = N) -> np.ndarray:
        """Of last symbols after what stands before; grams and contexts: hashes by order, from 1."""
        if order == 0:
            return np.full(len(grams[0]), 2.0**-20)
        p = self.look_up(order, grams[order - 1], -1)
        new = np.flatnonzero(p < 0)
        if len(new):
            weight = self.look_up(1 - order, contexts[order - 2][new] if order > 1 else np.full(len(new), START, np.uint64), 1)
            p[new] = weight * self.probability([g[new] for g in grams], [c[new] for c in contexts], order - 1)
        return p

    def surprise(self, symbols: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
        """Negative log probability of each symbol after the first N - 1; 0 for those that other parts are to score."""
        windows = np.lib.stride_tricks.sliding_window_view(symbols, N)
        own = np.arange(len(windows)) if parts == 1 else np.flatnonzero(_part(symbols[N - 2 : -1], parts) == part)
        _, at = np.unique(hashes(symbols)[own], return_inverse=True)
        one = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        one[at] = own
        grams, contexts = [], []
        for last, out in ((N - 1, grams), (N - 2, contexts)):
            h = np.full(len(one), START, np.uint64)
            for k in range(last, -1, -1):
                h = _mixed(h, windows[one, k].astype(np.uint64))
                out.append(h)
        values = np.zeros(len(windows))
        values[own] = -np.log(self.probability(grams, contexts))[at]
        return values


def surprises(models: dict[str, Model], langs: list[str], texts: list[str | None], part: int, parts: int) -> list[float | None]:
    """Mean surprise a character of each text under its language's model, texts of a language worked on together (the
    share of one part, if there are more); None for empty texts and languages that models lacks."""
    out: list[float | None] = [None] * len(texts)
    sizes_of = [0] * len(texts)
    waiting: dict[str, list[tuple[int, np.ndarray]]] = {}

    def settle(lang: str) -> None:
        own = waiting.pop(lang)
        sizes = [len(x) for _, x in own]
        values = models[lang].surprise(np.concatenate([x for _, x in own]), part, parts)
        values = np.concatenate([np.zeros(N - 1), values])
        starts = np.cumsum([0, *sizes[:-1]])
        for k in range(N - 1):  # start symbols of each text
            values[starts + k] = 0
        for (i, _), value in zip(own, np.add.reduceat(values, starts), strict=True):
            out[i] = (out[i] or 0.0) + float(value)

    held: dict[str, int] = {}
    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        if not text or lang not in models:
            continue
        for piece in _pieces(text):
            sizes_of[i] += len(piece) - N + 1
            waiting.setdefault(lang, []).append((i, piece))
            held[lang] = held.get(lang, 0) + len(piece)
            if held[lang] >= ngrams.PART:
                settle(lang)
                held[lang] = 0
    for lang in list(waiting):
        settle(lang)
    return [x if x is None else x / n for x, n in zip(out, sizes_of, strict=True)]


def packs(sizes: dict[str, int], most: int = PACK) -> list[tuple[list[str], int, int]]:
    """(languages, part, parts) of each pass: small models together, one of more than `most` entries in parts."""
    out, now, held = [], [], 0
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if n > most:
            parts = -(-n // most)
            out += [([lang], part, parts) for part in range(parts)]
            continue
        if now and held + n > most:
            out.append((now, 0, 1))
            now, held = [], 0
        now.append(lang)
        held += n
    return [(now, 0, 1), *out] if now or not out else out


def _inside(part: int, parts: int) -> Callable[..., Column]:
    @F.arrow_udf("boolean")
    def of(symbols: pa.Array) -> pa.Array:
        return pa.array(_part(symbols.to_numpy(zero_copy_only=False), parts) == part)

    return of


def _models(entries: DataFrame, langs: list[str], part: int, parts: int) -> dict[str, Model]:
    """The models of one pass: PACK entries or about so many, which is all that the driver holds at a time."""
    own = entries.where(F.col("lang").isin(langs))
    if parts > 1:
        own = own.where((F.col("symbol") < 0) | _inside(part, parts)("symbol"))
    got = own.select("lang", "level", "hash", "value").toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else None
    level, h, value = got["level"].to_numpy(), got["hash"].to_numpy().view(np.uint64), got["value"].to_numpy()
    out = {}
    for i, name in enumerate(lang.dictionary.to_pylist() if got.num_rows else []):
        at = lang.indices.to_numpy(zero_copy_only=False) == i
        out[name] = Model(level[at], h[at], value[at])
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _base(texts: pa.Array) -> pa.Array:
    given = texts.to_pylist()
    columns = list(zip(*map(base_counts, given), strict=True)) or [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def _score(shared: Broadcast, part: int, parts: int) -> Callable[..., Column]:
    @F.arrow_udf("double")
    def of(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array(surprises(shared.value, langs.to_pylist(), texts.to_pylist(), part, parts), pa.float64())

    return of


def measured(docs: DataFrame, entries: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = PACK) -> DataFrame:
    """(id, lang, base counts, log_perplexity) of every row; log_perplexity is the mean surprise a character, null
    for empty texts. One pass over the texts for each pack of models, each pass with its own, released broadcast."""
    spark = docs.sparkSession
    sizes = {r["lang"]: r["n"] for r in entries.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"), F.lit(None).cast("double").alias("log_perplexity"))
    passes = packs(sizes, most)
    for i, (langs, part, parts) in enumerate(passes):
        shared = spark.sparkContext.broadcast(_models(entries, langs, part, parts))

        found = _score(shared, part, parts)("text", "lang")
        upto = F.coalesce("log_perplexity", F.lit(0.0)) + F.coalesce(found, F.lit(0.0))
        value = F.when(F.col("log_perplexity").isNotNull() | found.isNotNull(), upto) if i else found
        rows = rows.withColumn("log_perplexity", value)
        if i == len(passes) - 1:
            rows = rows.select("id", "lang", _base("text").alias("m"), "log_perplexity").select("id", "lang", "m.*", "log_perplexity")
        rows = common.checkpointed(rows)
        shared.destroy()
    return rows


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spreads: tuple[float, float] = SPREADS, least: float = LEAST, pack: int = PACK) -> DataFrame:
    """(id_col, lang, counts, base_failed, log_perplexity, lower, upper, kept) of every row.

    base_failed: fewer than 50 words, or over half of the words repeated (base_counts). A document that
    passes is kept if its log perplexity under its own language's model, over the whole text, lies in that language's
    band: median, less spreads[0] and more spreads[1] spreads, over the documents of that language that pass, all of them. Null languages are
    one language. Empty and null texts fail the base rules. Repeated rows give repeated rows, an empty table none;
    null ids are judged like any other; other columns are not looked at.
    """
    folder = new_folder(docs)
    rows = measured(docs, train(docs, text_col, lang_col, folder), id_col, text_col, lang_col, pack)
    common.remove(docs.sparkSession, folder)  # rows are checkpointed
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    q = rows.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.1, 0.5, 0.9], 10_000).alias("q"))
    spread = lambda a: F.greatest((F.get("q", F.lit(a + 1)) - F.get("q", F.lit(a))) / 1.2816 * spreads[a], F.lit(least))
    bands = q.select("lang", (F.get("q", F.lit(1)) - spread(0)).alias("lower"), (F.get("q", F.lit(1)) + spread(1)).alias("upper"))
    met = rows.join(common.small(bands), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return met.select(F.col("id").alias(id_col), *[c for c in met.columns if c != "id"], (~F.col("base_failed") & inside).alias("kept"))
