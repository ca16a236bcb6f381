"""Quality, mixing, BPE, token counts, language, toxicity and HTML against brute force, libraries and held-out rows."""

import math
import os
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, html_text, language_id, mixing, quality, queries, token_counts, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "A\x0b\x0cb", "Ünï  cödé\r\nÄÖ", "x " * 30_000, "a" * 50_000, "Hello<|endoftext|>World <|startoftext|>", "ΣΑΣ İ ẞ é don't WE'LL", "数学 ١٢٣ 😀", "\x1c\x1d\x85b　c", "!!!???..."]
SCHEMA = "doc_id long, text string, lang string, source string, ids string"


def docs(spark, texts, lang="en", source="src1"):
    return spark.createDataFrame([(i, t, lang, source, "clash") for i, t in enumerate(texts)], SCHEMA)


def brute_counts(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), doubled, len(inside)


def test_base_counts():
    random.seed(1)
    texts = [*ODD, *["".join(random.choices("ab#| \n\t", k=random.randint(0, 80))) for _ in range(300)], "a b c a b c", "a b c\na b c\n\n\na b c", "x x x x"]
    for t in texts:
        assert quality.base_counts(t) == brute_counts(t), repr(t)[:80]


def brute_kneser_ney(texts, n):
    """Modified Kneser-Ney by dictionaries: probability of a symbol after n - 1 others."""
    runs = [re.sub(r"([^\w\s])\1+", r"\1", t) for t in texts]
    grams = {n: Counter((("\0" * (n - 1)) + t)[i : i + n] for t in runs for i in range(len(t)))}
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {}
    for k, own in grams.items():
        t = [sum(c == i for c in own.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        d[k] = [0.5 * i if not all(t[1:]) else max(0, min(0.95 * i, i - (i + 1) * y * t[i + 1] / t[i])) for i in (1, 2, 3)]
    total, left = {}, {}
    for k, own in grams.items():
        for g, c in own.items():
            total[g[:-1], k] = total.get((g[:-1], k), 0) + c
            left[g[:-1], k] = left.get((g[:-1], k), 0) + d[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 2.0**-20
        if (g[:-1], k) not in total:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return ((c - d[k][min(c, 3) - 1] if c else 0) + left[g[:-1], k] * p(g[1:])) / total[g[:-1], k]

    def log_perplexity(text):
        run = re.sub(r"([^\w\s])\1+", r"\1", text)
        whole = "\0" * (n - 1) + run
        return -sum(math.log(p(whole[i : i + n])) for i in range(len(run))) / len(run)

    return log_perplexity


@pytest.mark.parametrize("pack", [quality.PACK, 300])
def test_perplexity_and_verdict(spark, pack):
    """Against a dictionary version, in one pass and in several over parts of the models."""
    rng = random.Random(12)
    of = {"en": ["the", "cat!!", "sat", "on", "Mats", "über", "12", "&&&", "数学"], "de": ["der", "Hund", "läuft", "weg", "und", "...", "ja"]}
    rows = [(i, " ".join(rng.choices(of[k], k=rng.randint(1, 90))) + "\n", k) for i, k in enumerate(rng.choices(["en", "de"], k=60))]
    rows += [(100, "der Hund läuft " * 20, "en"), (101, "q z x %" * 60, "de"), (102, None, "de"), (103, "", "en"), (104, "only one", "fr"), (None, "the cat " * 40, None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, sum string")
    models = {k: brute_kneser_ney([t for _, t, lang in rows if t and lang == k], quality.N) for k in ("en", "de", "fr", None)}
    got = sorted(quality.judge(df, pack=pack).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    for r, (i, text, lang) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        if text:
            assert r["log_perplexity"] == pytest.approx(models[lang](text), rel=1e-5), i
        else:
            assert r["log_perplexity"] is None
    for lang in ("en", "de", "und"):
        fine = sorted(r["log_perplexity"] for r in got if r["lang"] == lang and not r["base_failed"])
        if not fine:
            continue
        q = [fine[max(0, math.ceil(p * len(fine)) - 1)] for p in (0.1, 0.5, 0.9)]
        low = q[1] - max((q[1] - q[0]) / 1.2816 * quality.SPREADS[0], quality.LEAST)
        high = q[1] + max((q[2] - q[1]) / 1.2816 * quality.SPREADS[1], quality.LEAST)
        for r in got:
            if r["lang"] == lang:
                assert r["kept"] == (not r["base_failed"] and low <= r["log_perplexity"] <= high)


def test_packs_hold_every_model_once():
    assert quality.packs({"a": 5, "b": 4, "c": 25}, 10) == [(["b", "a"], 0, 1), (["c"], 0, 3), (["c"], 1, 3), (["c"], 2, 3)]
    assert quality.packs({}, 10) == [([], 0, 1)]


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n)) + "."


def test_quality_bands(spark):
    rng = random.Random(2)
    words = ["river", "stone", "walks", "under", "the", "bright", "morning", "and", "carries", "water", "toward", "green", "hills", "where", "people", "gather"]
    texts = [prose(rng, words, 80) for _ in range(80)] + ["".join(rng.choices("zqxkvjw957%&#|~^ ", k=800)), *ODD]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["kept"] for i in range(80))
    assert not got[80]["kept"]
    for i, t in enumerate(texts):
        n = brute_counts(t)
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality.judge(docs(spark, [])).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [*ODD, *["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC '’é.,!0123 \n", k=rng.randint(0, 90))) for _ in range(400)], *["".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(0x391, 0x3C9), rng.randint(0x4E00, 0x9FA5)])) for _ in range(30)) for _ in range(100)]]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, repr(t)[:80]
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = docs(spark, texts).select("doc_id", bpe.encode("text", PATH).alias("e")).select("doc_id", "e", bpe.decode("e", PATH).alias("d"))
    assert all(r["e"] == got[r["doc_id"]]["ids"] and r["d"] == got[r["doc_id"]]["decoded"] for r in again.collect())


def test_pairs_fit_as_merging_says():
    t = bpe.WordBpe(PATH)
    rng = random.Random(4)
    plain = [i for w, i in t.ids.items() if i >= 512 and w.isascii() and w.isalpha()]
    left, right = (np.array(rng.choices(plain, k=400), np.int64) for _ in range(2))
    fits = t.compatible(left, right)
    spelled = [t.tokens[a] + t.tokens[b] + bpe.END for a, b in zip(left, right, strict=True)]
    # joint text without an end of word: merge it with one stand-in symbol behind and compare what stands before
    merged = [np.frombuffer(x, np.int32).tolist() for x in t._merged([s[:-1] + "!" for s in spelled])]
    for ok, a, b, ids in zip(fits, left, right, merged, strict=True):
        alone = [np.frombuffer(x, np.int32).tolist() for x in t._merged([t.tokens[a] + "!", t.tokens[b] + "!"])]
        if alone[0][0] == a and alone[1][0] == b and len(ids) and ids[-1] == t.ids["!</w>"]:
            assert ok == (ids[:-1] == [a, b])


def test_token_counts(spark):
    rng = random.Random(5)
    texts = [t if t is None or "\x85" not in t else t for t in ODD] + [" ".join(rng.choices(["alpha", "beta", "don't", "<|endoftext|>", "x" * 700], k=400)) for _ in range(5)]
    edits = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(c).alias("cut"), F.lit(p).alias("put")) for a, c, p in [(5, 1, ""), (600, 900, " new words "), (0, 0, "start"), (10**6, 3, "end"), (-4, 2, None)]])
    tok = bpe.WordBpe(PATH)
    for r in token_counts.recount(docs(spark, texts), edits, PATH).collect():
        before = texts[r["doc_id"]] or ""
        after = before
        for at, cut, put in [(5, 1, ""), (600, 900, " new words "), (0, 0, "start"), (10**6, 3, "end"), (-4, 2, "")]:
            at = max(0, min(at, len(after)))
            after = after[:at] + put + after[at + cut :]
        assert r["text"] == after
        assert (r["n_before"], r["n_after"]) == tuple(len(x) for x in tok.encode([before, after]))
        assert r["tree"]["tokens"][-1] == r["n_after"] and r["tree"]["chars"][-1] == len(after)
        cut, n = token_counts.leaves(after), r["tree"]["leaves"]
        assert r["tree"]["chars"][:n] == [len(x) for x in cut]
        assert r["tree"]["tokens"] == [int(x) for t in token_counts.tree(np.array([len(x) for x in tok.encode(cut)])) for x in t]


def test_stored_trees_are_edited_as_whole_documents_are(spark):
    rng = random.Random(15)
    texts = [*ODD, *[" ".join(rng.choices(["a", "bc", "Don't", "é"], k=rng.randint(0, 700))) for _ in range(20)]]
    df = docs(spark, texts).withColumn("edits", queries.edits())
    whole = {r["doc_id"]: r for r in token_counts.recount(df, "edits", PATH).collect()}
    apart = df.withColumn("t", token_counts.build("text", PATH)).withColumn("d", token_counts.apply_edits("text", "t", "edits", PATH))
    for r in apart.collect():
        w = whole[r["doc_id"]]
        assert (r["d"]["text"], r["d"]["tree"], r["d"]["encoded"], r["t"]["tokens"][-1]) == (w["text"], w["tree"], w["encoded"], w["n_before"])


def test_only_touched_leaves_are_encoded(spark):
    """Whatever the text's length: what an edit puts in, the words at its two ends, and the next word where a blank is lost."""
    words = [f"word{i}" for i in range(40_000)]
    text = " ".join(words)
    edits = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(c).alias("cut"), F.lit(p).alias("put")) for a, c, p in [(100_000, 5000, "new words here"), (7, 0, "x"), (200_000, 3, "")]])
    r = token_counts.recount(docs(spark, [text]), edits, PATH).first()
    assert r["encoded"] <= len("new words here") + 1 + 3 * 4 * 10
    assert r["n_after"] == len(bpe.WordBpe(PATH).encode([r["text"]])[0])


def test_trees_after_many_edits():
    rng = random.Random(13)
    text = " ".join("w" * rng.randint(1, 5) for _ in range(600))
    chars = token_counts.tree(np.array([len(x) for x in token_counts.leaves(text)]))
    for _ in range(300):
        at, cut, put = rng.randint(-5, len(text) + 5), rng.choice([0, 1, 3, 40, 2000]), "".join(rng.choices("ab \n", k=rng.choice([0, 1, 9, 300])))
        low = max(0, min(at, len(text)))
        want = text[:low] + put + text[low + max(0, min(cut, len(text) - low)) :]
        text, chars, *_ = token_counts.edited(text, chars, at, cut, put)
        assert text == want
        fresh = token_counts.tree(chars[0])
        assert all((a == b).all() for a, b in zip(chars, fresh, strict=True)) and chars[-1][0] == len(text)
        assert "".join(token_counts.leaves(text)) == text


def test_null_edits(spark):
    r = token_counts.recount(docs(spark, ["one two"]), F.lit(None).cast("array<struct<at:int,cut:int,put:string>>"), PATH).first()
    assert (r["text"], r["n_before"], r["n_after"]) == ("one two", 2, 2)


def language_rows(n=60):
    rng = random.Random(6)
    of = {"en": "the of and water stone under people gather with this house", "de": "der die und wasser stein unter über schön straße nicht haus", "fr": "le la et eau pierre sous où été maison avec fenêtre", None: "zzz"}
    return [(i, " ".join(rng.choices(of[k].split(), k=25)), k) for i, k in enumerate(rng.choices(list(of), k=n * 4))]


def test_language_id(spark):
    rows = language_rows()
    odd = [(1000 + i, t, None) for i, t in enumerate(ODD + ["12 34", "..."])]
    df = spark.createDataFrame([(i, t, k, "s", "c") for i, t, k in rows + odd], "doc_id long, text string, lang string, source string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    known = [(i, k) for i, t, k in rows if k and got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == k for i, k in known]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, t, _ in odd:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), repr(t)
    assert language_id.identify(df.limit(0)).count() == 0
    assert language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def brute_language(rows, text):
    """Shares of exact sets of trigrams, then of letter pairs, then of letters."""
    import zlib

    learned = [(t, k) for i, t, k in rows if k and t and i is not None and zlib.crc32(str(i).encode()) % 5]
    size = Counter()
    sets = {}
    for t, k in learned:
        own = language_id.grams(t).tolist()
        size[k] += len(own)
        for level, keys in zip((3, 2, 1), (own, *[x.tolist() for x in language_id.shorter(language_id.grams(t))]), strict=True):
            sets.setdefault((k, level), set()).update(keys)
    langs = sorted(size, key=lambda k: (-size[k], k))
    keys = language_id.grams(text)
    if not len(keys):
        return "und", 0.0, 0
    for level, own in zip((3, 2, 1), (keys.tolist(), *[x.tolist() for x in language_id.shorter(keys)]), strict=True):
        hits = [sum(g in sets[k, level] for g in own) for k in langs]
        if any(hits):
            return langs[hits.index(max(hits))], max(hits) / sum(hits), level
    return langs[0], 0.0, 0


@pytest.mark.parametrize("most_bytes", [language_id.MOST_BYTES, 50_000, 1 << 14])
def test_language_id_against_brute_force(spark, most_bytes):
    rows = language_rows(20)
    rows += [(2000 + i, t, None) for i, t in enumerate([*ODD, "zzz qqq", "ß", "é", "数学", "the the der"])] + [(None, "the water", "en"), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, found string")
    got = language_id.identify(df, most_bytes=most_bytes).collect()
    assert len(got) == len(rows)
    want = {i: brute_language(rows, t) for i, t, _ in rows}
    # a Bloom filter may be wrong about single n-grams, so texts of known ones are held against it
    wrong = [i for i in {r["doc_id"] for r in got} if want[i][1] > 0.6 and want[i][2] == 3 and {r["lang_pred"] for r in got if r["doc_id"] == i} != {want[i][0]}]
    assert wrong == []
    for r in got:
        assert (r["lang_pred"] == "und") == (want[r["doc_id"]][0] == "und")
        if want[r["doc_id"]][2] == 3 and want[r["doc_id"]][1] > 0.6:
            assert abs(r["score"] - want[r["doc_id"]][1]) < 0.1


def test_parts_of_filters_add_up(spark):
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(104729)
    known = spark.createDataFrame([(int(k), [i % 3]) for i, k in enumerate(keys)], "gram long, langs array<int>")
    made = [language_id.filters(["a", "b", "c"], known, language_id.width(500), p, 4) for p in range(4)]
    parts = language_id.part_of(keys, 4)
    assert set(parts.tolist()) == {0, 1, 2, 3}
    for i in range(3):
        own = keys[i::3]
        hits = sum(f.hits(own[language_id.part_of(own, 4) == p]) for p, f in enumerate(made))
        assert hits[i] == pytest.approx(len(own))
        assert all(abs(h) < 0.05 * len(own) for j, h in enumerate(hits) if j != i)


def test_languages_do_not_fill_up(spark):
    """Where every language holds every n-gram somewhere, bare membership tells nothing apart; rates do."""
    words = {"en": "the water of stone", "de": "das wasser vom stein"}
    rows = [(i, " ".join([words[k]] * 400 + ([words["de" if k == "en" else "en"]] if i % 40 == 0 else [])), k) for i, k in enumerate(["en", "de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, known = language_id.learn(docs.where("doc_id % 5 <> 4"))
    sizes = [len(r["langs"]) for r in known.collect()]
    shared = set(language_id.grams(words["en"]).tolist()) & set(language_id.grams(words["de"]).tolist())
    assert sum(n > 1 for n in sizes) <= 40 + len(shared) < len(sizes)
    got = language_id.identify(docs).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] and r["score"] > 0.6 for r in got)


def test_bloom_filters_return_all_languages(spark):
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919)
    langs = np.repeat(np.arange(100), 20)
    known = spark.createDataFrame([(int(k), [int(x)]) for k, x in zip(keys, langs, strict=True)], "gram long, langs array<int>")
    f = language_id.filters([f"l{i:03d}" for i in range(100)], known, language_id.width(20))
    for i in (0, 63, 64, 99):
        assert f.rates(keys[langs == i])[i] == 1.0
    assert f.false.max() < 0.1


def test_toxicity(spark):
    rng = random.Random(7)
    clean = "water stone under people gather with this house morning river light".split()
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = rng.choices(clean, k=30)
        if bad:
            words[5], words[9] = ("idiot", "stupid") if i % 12 else ("grobnik" + rng.choice("abcd"), "grobniku")
        rows.append((i, " ".join(words), "en", "s", "c"))
        if i % 4 != 3:
            labels.append((i, int(bad)))
    rows += [(1000 + i, t, "en", "s", "c") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97
    assert toxicity.drop_toxic(df, lab).columns == df.columns
    none = toxicity.score_documents(df, lab.limit(0)).where("doc_id = 6").first()
    assert none["predicted"] == 1


def sparse(votes):
    return toxicity.Sparse([np.flatnonzero(r) for r in votes], votes.shape[1])


def test_label_model_discounts_copies():
    rng = np.random.default_rng(8)
    y = rng.random(3000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(3000) < hit, rng.random(3000) < false)
    one = vote(0.8, 0.1)
    votes = np.column_stack([one, one, one, vote(0.7, 0.05), vote(0.7, 0.05), vote(0.9, 0.1)]).astype(float)
    m = toxicity.LabelModel(sparse(votes), y.astype(float))
    assert m.say[0] < 0.4 < 0.9 < m.say[3]
    p = m.posterior(sparse(votes))
    assert ((p > 0.5) == y).mean() > 0.9
    assert ((p > 0.5) == y).mean() >= ((votes.sum(axis=1) > 3) == y).mean()  # no worse than the majority
    assert abs(p.mean() - y.mean()) < 0.01
    assert ((p > 0.5) != y).sum() > 20  # where voters say otherwise, the label has no vote


def test_label_model_against_dense_em():
    rng = np.random.default_rng(9)
    y = (rng.random(400) < 0.2).astype(float)
    votes = np.column_stack([rng.random(400) < np.where(y > 0, a, b) for a, b in [(0.8, 0.1), (0.6, 0.02), (0.1, 0.4), (0.5, 0.5)]]).astype(float)
    m = toxicity.LabelModel(sparse(votes), y, rounds=7)
    gold = np.stack([1 - y, y])
    base = (gold @ votes + (votes.sum(axis=0) + 0.1) / 400.2) / (gold.sum(axis=1)[:, None] + 1)

    def say(fires, mass):
        cov = sum(((votes - p) * w[:, None]).T @ (votes - p) for w, p in zip(mass, fires, strict=True))
        both = sum((votes * w[:, None]).T @ votes - w.sum() * np.outer(p, p) for w, p in zip(mass, fires, strict=True))
        var = sum(w.sum() * p * (1 - p) for w, p in zip(mass, fires, strict=True))
        assert cov.shape == both.shape
        r2 = np.clip(both / np.sqrt(np.outer(var, var)), 0, 1) ** 2 * (votes.T @ votes > 0)
        np.fill_diagonal(r2, 1)
        return 1 / r2.sum(axis=1)

    def post(fires, weight):
        x = votes @ (weight * np.log(fires[1] / fires[0]))
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        slope, offset = 1.0, -3.0
        for _ in range(20_000):  # plain descent
            q = 1 / (1 + np.exp(-slope * x - offset))
            slope, offset = slope - 0.1 * ((q - target) * x).mean(), offset - 0.1 * (q - target).mean()
        return 1 / (1 + np.exp(-slope * x - offset))

    fires, weight = base, say(base, gold)
    for i in range(7):
        q = post(fires, weight)
        mass = np.stack([1 - q, q])
        if i in (2, 4):
            weight = say(fires, mass)
        n, n_gold = mass.sum(axis=1)[:, None], gold.sum(axis=1)[:, None]
        fires = (mass @ votes + n_gold * base) / (n + n_gold)
    assert np.allclose(m.posterior(sparse(votes)), post(fires, weight), atol=1e-4)


def test_mined_voters_against_counts(spark):
    rng = random.Random(14)
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((" ".join(rng.choices(["haus", "wald", "bach", "stein"], k=6) + (["grobian"] if bad else ["freund"] if i % 3 else [])), int(bad)))
    base, seen, bad = 50 / 400, Counter(), Counter()
    for t, label in rows:
        own = {s for w in t.split() for s in toxicity.stems_of(w)}
        seen.update(own)
        bad.update(own if label else ())
    part = lambda k, n, share: k * math.log(k / n / share) if k else 0.0
    gain = {s: part(bad[s], n, base) + part(n - bad[s], n, 1 - base) for s, n in seen.items()}
    odds = lambda k, n, of: k / of / ((n - k + 0.5) / (400 - of + 0.5))
    right = lambda s: odds(bad[s], seen[s], 50) >= 1.5 * 7 or odds(seen[s] - bad[s], seen[s], 350) >= 1.5
    want = sorted(s for s, g in gain.items() if g > math.log(sum(n > 1 for n in seen.values())) and right(s))
    assert toxicity.mine(spark.createDataFrame(rows, "text string, label int"), 400, 50, 1.0) == want
    assert "grobian$" in want and "freund$" in want


def mixed(rows, weights, share, epochs, seed):
    """Brute force: fill shares by rounds, then take prefixes of the seeded order."""
    import hashlib

    tokens = {}
    for _, domain, lang, source, n in rows:
        tokens[domain, lang, source] = tokens.get((domain, lang, source), 0) + n

    def spread(budget, nodes):
        out, left, open_ = {}, budget, dict(nodes)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = [k for k, (w, cap) in open_.items() if w and cap * total <= w * left]
            if not full:
                return out | {k: left * w // max(total, 1) if w else 0 for k, (w, _) in open_.items()}
            for k in sorted(full, key=lambda k: open_[k][1] / open_[k][0])[:1]:
                out[k] = open_.pop(k)[1]
                left -= out[k]
        return out

    budgets = {(): min(int(sum(tokens.values()) * share), sum(tokens.values()) * epochs)}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        now = {}
        for parent, budget in budgets.items():
            nodes = {}
            for leaf, n in tokens.items():
                if leaf[: depth - 1] == parent:
                    w, cap = nodes.get(leaf[:depth], (weights.get(level, {}).get(leaf[depth - 1], 1), 0))
                    nodes[leaf[:depth]] = (w, cap + n * epochs)
            now |= spread(budget, nodes)
        budgets = now
    out = Counter()
    for leaf, n in tokens.items():
        whole = min(budgets[leaf] // n, epochs) if n else 1
        rest, upto = budgets[leaf] - whole * n, 0
        own = sorted((hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest(), r[0], r[4]) for r in rows if r[1:4] == leaf)
        for _, i, size in own:
            upto += size
            out[i] += whole + (whole < epochs and upto <= rest)
    return {i: n for i, n in out.items() if n}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 2), (3.0, 2), (0.0, 1)])
def test_mixing(spark, share, epochs):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"]), rng.choice([0, 1, 5, 40, 300])) for i in range(200)]
    df = spark.createDataFrame([(i, "w " * n, lang, s, d, "clash") for i, d, lang, s, n in rows], "doc_id long, text string, lang string, source string, site string, mix_budget string")
    weights = {"domain": {"a": 5}, "lang": {"en": 3, "de": 0}}
    got = Counter(r["doc_id"] for r in mixing.mix(df, weights, share, epochs, 4, F.col("site")).collect())
    assert dict(got) == mixed(rows, weights, share, epochs, 4)


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, "c"), (1, "", "en", "s", "c"), (2, "a b", None, "s", "c"), (2, "a b", None, "s", "c")], SCHEMA)
    assert mixing.mix(df, {}, 1.0, 1).count() == 4
    assert mixing.mix(df.limit(0), {}, 1.0, 1).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 500, 20_000, 60_000, 10**7])
def test_budgets_of_many_siblings(spark, budget):
    """Against filling up in order, with equal and unequal weights and capacities and weights of nothing."""
    draw = random.Random(budget)
    rows = [(p, i, draw.choice((0, 1, 1, 2, 7)), draw.choice((0, 5, 5, 10, 35, draw.randrange(900)))) for p in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "p string, node long, weight long, capacity long").withColumn("budget", F.lit(budget).cast("long"))
    for parent in ([], ["p"]):
        want = {}
        for group in ([rows] if not parent else [[r for r in rows if r[0] == p] for p in "ab"]):
            left, pull = budget, sum(r[2] for r in group)
            for p, i, w, c in sorted((r for r in group if r[2]), key=lambda r: Fraction(r[3], r[2])):
                if c * pull > w * left:
                    break
                want[p, i], left, pull = c, left - c, pull - w
            want |= {(p, i): left * w // max(pull, 1) for p, i, w, _ in group if (p, i) not in want}
        assert {(r["p"], r["node"]): r["share"] for r in mixing.share_out(df, parent).collect()} == want



PAGES = [
    ("<p>a <b>b</b>c<p>d<br>e", "a bc\n\nd\ne"),
    ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>after", "- x\n- y\n  3. 1\n  4. 2\n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>abc<td>1<td hidden>q</table>tail", "Name  N\nabc   1\n\ntail"),
    ("<div style='display:none'>no</div><script>var a='</p>';</script><p>yes &amp; <!-- c -->no&nbsp;w", "yes & no\xa0w"),
    ("<pre> k\n  l</pre>m", " k\n  l\n\nm".strip("\n")),
    ("<head><title>t</title></head><body>b<noscript>n</noscript>", "b"),
    ("a < b <", "a < b <"),
    ("", ""),
    (None, None),
    ("<div>" * 5000 + "deep" + "<table><tr><td>" * 5000 + "in", "deep\n\nin"),
]


def test_html(spark):
    rows = [(i, h, "clash") for i, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == want, i
    odd = html_text.extract_pages(spark.createDataFrame([(None, "<p>a"), (1, "<p>a"), (1, "<p>a")], "page_id long, html string"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in odd.collect()) == [(0, "a"), (1, "a"), (1, "a")]
    assert odd.limit(0).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><title>T</title><p>Hello", "Hello"),
        ("<html><head><meta charset=x> Hello <b>you</b>", "Hello you"),
        ("<head><style>a</style><script>b</script></head><body>c", "c"),
        ("<p>a <span aria-hidden=true>b</span> c", "a b c"),
        ("<p>Pick<select><option>one<option>two</select>", "Pick\none\ntwo"),
        ("<p>See <svg width='9'><title>t</title><text>drawn</text><path d='x'/></svg>", "See\ndrawn"),
        ("<p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>.", "It is x=2."),
        ("<div>a <svg/>b <math />c</div>d", "a b c\nd"),
        ("<div>a <svg><a href=x/>b</a></svg>c</div>", "a bc"),
        ("<object data=x>shown <b>too</b></object>", "shown too"),
        ("<textarea>a &lt; b &amp; <i>c</textarea>", "a < b & <i>c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c</table>", "a    b\n     c"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>", ""),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        ("<table><tr><td>x<table><tr><td>1<td>2<tr><td>3</table><td>y</table>", "x     y\n\n1  2\n3".replace("\n\n", "\n")),
        ("<table><tr>loose<td>a<td>b<tr><b>more</b><td>c<td>d</table>", "loose\nmore\na  b\nc  d"),
        ("<style>.h{display:none}</style><p class='a h'>no</p><p class=ha>yes", "yes"),
        ("<style>p.h, #x { color:red; DISPLAY : NONE } /* .y{display:none} */</style><p class=h>no<div class=h>a</div><div id=x>no</div><b class=y>b", "a\nb"),
        ("<style>.h{display:none} .h.s{display:block} b{display:none!important}</style><p class='h s'>yes<b style='display:inline'>no</b></p>", "yes"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>yes</p><p hidden class=s>no</p>", "yes"),
        ("<style>.s{display:block}</style><p hidden class=s>yes", "yes"),
        ("<style>nav .m i{display:none}</style><nav><p class=m><u><i>no</i></u>a</p><i>b</i></nav><p class=m><i>c</i>", "a\n\nb\n\nc"),
        ("<style>.v{visibility:hidden} .w{visibility:visible}</style><div class=v>no<b class=w>yes</b></div>", "yes"),
        ("<style>@media print{p{display:none}} @media screen{b{display:none}} @import 'x'; i{display:none}</style><p>a<b>no</b><i>no</i>", "a"),
        ("<style media=print>p{display:none}</style><style>p>b{display:none} a:hover{display:none} [x]{display:none}</style><p>a <b>b</b>", "a b"),
        ("<style>p{display:none", ""),
        ("<noscript><style>p{display:none}</style></noscript><p>a", "a"),
        ("<details>no<summary>s</summary><p>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<style>.a .b{display:none}" + "{" * 20_000 + "</style>" + "<div class=a>" * 5000 + "<p class=b>no</p>x", "x"),
        ("x" * 50_000 + "<p>" * 20_000 + "</b>" * 20_000 + "y", "x" * 50_000 + "\n\ny"),
    ],
)
def test_html_shows_what_browsers_show(page, want):
    assert html_text.page_text(page) == want


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    from test_dedup import brute_components, brute_lines
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def kept(rows, name):
        return [r["doc_id"] for r in rows] if name != "line dedup" else [(r["doc_id"], r["text"], r["n_chars"]) for r in rows]

    def toxicity_stage(rows):
        model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        return [r["doc_id"] for r in rows if model.score(r["text"]) < 0.5]

    def near_stage(rows):
        cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
        sets = {r["doc_id"]: cut(r["text"]) for r in rows}
        roots = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        return [i for i, root in roots.items() if i == root]

    def mix_stage(rows):
        number = lambda s: f"d{int(m[0]) % 4}" if (m := re.search("[0-9]+", s or "")) else "d"
        given = [(r["doc_id"], number(r["source"]), r["lang"] or "", r["source"] or "", brute_counts(r["text"])[0]) for r in rows]
        return list(mixed(given, queries.WEIGHTS, corpus_pipeline.MIX_SHARE, 1, queries.SEED))

    brute = {
        "toxicity": toxicity_stage,
        "line dedup": lambda rows: [(i, t, len(t)) for i, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in rows])],
        "SimHash near-dedup": near_stage,
        "mixing": mix_stage,
        "BPE": lambda rows: [r["doc_id"] for r in rows],
    }
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name != "BPE":
            assert out.columns == columns, name
        assert sorted(kept(out.collect(), name)) == sorted(brute[name](rows)), name
        docs = out
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in docs.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in df.select(*order).collect()) == sorted(want.fetchall())


def test_toxicity_odd_tables(spark):
    """Empty tables, repeated rows, ids with two texts and null ids; the least text of an id is learned from."""
    rows = [(i, f"{'idiot stupid' if i % 3 == 0 else 'river house'} word{i % 5}", "en") for i in range(200)] + [(0, "river", "en"), (0, "idiot stupid word0", "en"), (None, "idiot stupid", "en"), (7, "river house word2", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(3, 1), (4, None)], "doc_id long, toxic int")
    runs = [sorted((tuple(r) for r in toxicity.score_documents(df.repartition(n), labels).collect()), key=str) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert len(runs[0]) == len(rows)
    assert [r for r in runs[0] if r[0] is None][0][1:] == (True, *[r for r in runs[0] if r[0] == 0 and r[3]][0][2:])
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
    assert toxicity.score_documents(df, labels.limit(0)).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).where("held_out").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    caught, toxic = sum(got[i]["predicted"] for i, t in labels if t), sum(t for _, t in labels)
    false = sum(got[i]["predicted"] for i, t in labels if not t)
    assert caught / toxic > 0.85
    assert false / (len(labels) - toxic) < 0.01
