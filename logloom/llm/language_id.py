"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import common, ngrams

N = 3
#: Bytes of filters that a worker holds at once; larger ones are cut by the n-grams' hash, one pass over the texts a part.
MOST_BYTES = 1 << 27
#: A language does not count as holding an n-gram that is so many times rarer in it than in the language where it is most
#: frequent: in enough text every language holds every n-gram, as a name, a quotation or a slip.
RARER = 1000
HASHES, BITS_PER_ENTRY = 4, 12
UNKNOWN = "und"
_TEXTS = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """Packed letter trigrams of the lower-cased text; each run of other characters is one blank, also at both ends. Empty if no letter."""
    codes = ngrams.code_points((text or "").lower())
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    codes = codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]
    packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return packed[codes[1:-1] != 32]


def shorter(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter pairs and letters of trigrams: the last two symbols, and the one in the middle, which is a letter."""
    return keys & np.uint64((1 << 42) - 1), keys >> np.uint64(21) & np.uint64((1 << 21) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, waiting, held = ngrams.Counts(), {}, 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, keys, n in counts.take():
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield pa.record_batch({"lang": pa.array([lang] * len(part)), "gram": part.view(np.int64), "n": n[at : at + (1 << 16)]})

    def settle() -> None:
        for lang, arrays in waiting.items():
            counts.add(lang, np.concatenate(arrays))
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = grams(text.as_py())
            if len(own):
                waiting.setdefault(lang.as_py(), []).append(own)
                held += len(own)
            if held >= _TEXTS:
                settle()
                held = 0
                if counts.size() >= ngrams.HELD:
                    yield from hand_on()
    settle()
    yield from hand_on()


def width(entries: int) -> int:
    """Bits of each language's filter for so many entries in the largest language."""
    return 1 << max(10, math.ceil(math.log2(max(entries, 1) * BITS_PER_ENTRY)))


class Filters:
    """Bloom filters of up to 64 languages per word, sliced by position: one look-up answers for all languages.

    words: for every 64 languages an array of as many words as a filter has bits.
    """

    def __init__(self, langs: list[str], words: np.ndarray) -> None:
        self.langs, self.words, self.mask = langs, words, np.uint64(words.shape[1] - 1)
        filled = np.array([np.count_nonzero(words[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))], float)
        self.false = (filled / words.shape[1]) ** HASHES

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        return places(keys, self.mask)

    def rates(self, keys: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language holds, less its expected false positives."""
        return np.clip(self.hits(keys) / len(keys), 0, 1)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Number of the n-grams that each language holds, less its expected false positives."""
        hits = np.zeros(len(self.langs))
        for cut in ngrams.parts(keys, 1):
            for w, sliced in enumerate(self.words):
                found = np.full(len(cut), ~np.uint64(0))
                for at in self.places(cut):
                    found &= sliced[at]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    hits[i] += np.count_nonzero(found >> np.uint64(i % 64) & np.uint64(1))
        return (hits - len(keys) * self.false) / (1 - self.false)


def places(keys: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
    """The HASHES positions of keys in a filter."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield (h + np.uint64(i) * step) & mask


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part, of so many, that an n-gram's filter entry is in."""
    return (keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)) % np.uint64(parts)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """The languages, most text first, and (gram, langs) of every letter trigram, pair and letter of all rows with a
    language and a letter, langs being places in that list: those that hold it, by RARER."""
    given = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counted = common.checkpointed(given.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not langs:
        return [], counted.select("gram", F.array(F.lit(0)).alias("langs"))
    place = counted.sparkSession.createDataFrame(list(enumerate(langs)), "place int, lang string")
    every = F.explode(F.array(F.col("gram"), F.col("gram").bitwiseAND(F.lit((1 << 42) - 1)), F.shiftright("gram", 21).bitwiseAND(F.lit((1 << 21) - 1))))
    totals = F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total")).join(place, "lang"))
    met = counted.join(totals, "lang").select("place", "total", "n", every.alias("gram")).groupBy("gram", "place").agg((F.sum("n") / F.first("total")).alias("rate"))
    held = F.filter(F.collect_list(F.struct("place", "rate")), lambda x: x["rate"] * RARER >= F.max("rate"))
    return langs, common.checkpointed(met.groupBy("gram").agg(F.transform(held, lambda x: x["place"]).alias("langs")))


def filters(langs: list[str], known: DataFrame, bits: int, part: int = 0, parts: int = 1) -> Filters:
    """Filters of `bits` bits a language, for one part of the n-grams. Spark joins the languages of each position; the driver gets one word for each
    position that is set, `bits` for every 64 languages at most."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["langs"]
            keys = np.repeat(batch["gram"].to_numpy().view(np.uint64), np.diff(own.offsets.to_numpy()))
            mine = part_of(keys, parts) == part
            keys, lang = keys[mine], own.flatten().to_numpy()[mine]
            for at in places(keys, np.uint64(bits - 1)):
                yield pa.record_batch({"word": pa.array(lang // 64, pa.int32()), "at": pa.array(at.view(np.int64)), "bits": pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))})

    got = known.mapInArrow(set_bits, "word int, at long, bits long").groupBy("word", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((max(1, -(-len(langs) // 64)), bits), np.uint64)
    words[got["word"].to_numpy(), got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filters(langs, words)


def predict(spark: SparkSession, model: Filters, text: Column) -> Column:
    """struct<lang, score>: the language with the highest corrected share of the text's trigrams.

    Where no language has any, its letter pairs decide, then its letters, then the language of the most learned text; so
    do ties go to the language of more learned text. score is the share over the sum of all languages' shares, 0 where
    nothing was found. A null text, one without a letter, or filters of no language give ('und', 0).
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        model, langs, scores = shared.value, [], []
        for x in texts:
            keys = grams(x.as_py())
            if not len(keys) or not model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            rates = model.rates(keys)
            for less in shorter(keys) if not rates.any() else ():
                rates = model.rates(less)
                if rates.any():
                    break
            best = int(rates.argmax())
            langs.append(model.langs[best])
            scores.append(float(rates[best] / rates.sum()) if rates[best] else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return of(text)


def predict_in_parts(rows: DataFrame, langs: list[str], known: DataFrame, bits: int, parts: int) -> DataFrame:
    """(row, found) of rows (row, text), as predict() decides, with filters of `bits` bits a language and part: each part
    is held in turn, and a text's hits are added up."""
    made = None
    for part in range(parts):
        shared = rows.sparkSession.sparkContext.broadcast(filters(langs, known, bits, part, parts))

        @F.arrow_udf("array<double>")
        def hits(texts: pa.Array, shared=shared, part=part) -> pa.Array:
            out = []
            for x in texts:
                keys = grams(x.as_py())
                out.append(np.concatenate([[len(k), *shared.value.hits(k[part_of(k, parts) == part])] for k in (keys, *shorter(keys))]))
            return pa.array(out, pa.list_(pa.float64()))

        own = common.checkpointed(rows.select("row", hits("text").alias("hits")))
        shared.unpersist()
        made = own if made is None else made.unionByName(own)

    @F.arrow_udf("struct<lang: string, score: double>")
    def decide(sums: pa.Array) -> pa.Array:
        out = []
        for x in sums.to_pylist():
            best = (UNKNOWN, 0.0)
            for level in np.array(x).reshape(3, -1):
                if level[0]:
                    rates = np.clip(level[1:] * parts / level[0], 0, 1)  # the number of n-grams is there once a part
                    best = (langs[int(rates.argmax())], float(rates.max() / rates.sum()) if rates.any() else 0.0)
                    if rates.any():
                        break
            out.append({"lang": best[0], "score": best[1]})
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    added = F.aggregate(F.collect_list("hits"), F.array_repeat(F.lit(0.0), 3 * (1 + len(langs))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return made.groupBy("row").agg(added.alias("sums")).select("row", decide("sums").alias("found"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row, learned from all of the rows that are not held out.

    Filters are as large as the n-grams that were learned need; where that is more than most_bytes they are cut by the
    n-grams' hash into parts of that size, which the texts visit one after the other. Repeated rows give repeated rows,
    null ids are held out, an empty table gives none; other columns are not looked at.
    """
    held = common.is_held_out(id_col)
    langs, known = learn(docs.where(~held), text_col, lang_col)
    entries = known.select(F.explode("langs").alias("place")).groupBy("place").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    of_bits = lambda bits: bits * 8 * -(-len(langs) // 64)
    bits = width(entries)
    parts = max(1, -(-of_bits(bits) // most_bytes))
    texts = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    if parts == 1:
        out = texts.select("id", "held_out", predict(docs.sparkSession, filters(langs, known, bits), F.col("text")).alias("found"))
    else:
        rows = common.checkpointed(texts.withColumn("row", F.monotonically_increasing_id()))
        out = rows.drop("text").join(predict_in_parts(rows, langs, known, width(-(-entries // parts)), parts), "row")
    lang, score = F.col("found.lang"), F.col("found.score")
    return out.select(F.col("id").alias(id_col), "held_out", lang.alias("lang_pred"), score.alias("score"))
