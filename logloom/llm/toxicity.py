"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import common

#: Lexicons, one voter each. Words are matched whole, in lower case.
LEXICONS = {
    "insult": "idiot idiots moron morons loser losers scum clown clowns fool fools imbecile imbeciles dumbass jerk jerks creep creeps bastard bastards",
    "contempt": "stupid pathetic worthless disgusting trash garbage useless vile filthy brainless dumb ugly hideous disgrace",
    "hostile": "hate kill die shut destroy hurt beat burn",
    "profane": "damn crap bullshit shit fuck fucking ass asshole bitch",
    "german": "idioten trottel dumm blödmann arschloch scheiße abschaum versager widerlich wertlos",
    "french": "idiote crétin imbécile connard salaud débile ordure minable dégoûtant stupide merde",
    "spanish": "idiota estúpido imbécil basura asqueroso inútil payaso patético escoria mierda",
}
PATTERNS = {
    "address": r"\b(?:you|your|du|tu|vous|usted)\b[^.!?\n]{0,40}\b(?:idiot|moron|loser|stupid|pathetic|worthless|trash|scum)\w*",
    "masked": r"\b[a-z]{1,2}[*#@]{2,}[a-z]*\b",
    "shouted": r"\b[A-Z]{3,}\b[^.\n]{0,20}!!",
    "threat": r"\b(?:i will|i'll|going to) (?:kill|hurt|find|destroy) you\b",
}
_PATTERNS = {name: re.compile(p, re.IGNORECASE if name != "shouted" else 0) for name, p in PATTERNS.items()}
#: A pattern is only looked for in lower-cased texts that hold one of these.
_HINTS = {"address": ("idiot", "moron", "loser", "stupid", "pathetic", "worthless", "trash", "scum"), "masked": ("*", "#", "@"), "shouted": ("!!",), "threat": (" you",)}
_WORD = re.compile(r"\w+")
_LEXICON_OF = {w: tuple(i for i, x in enumerate(LEXICONS.values()) if w in x.split()) for x in LEXICONS.values() for w in x.split()}
FIXED = len(LEXICONS) + len(PATTERNS)
#: Lengths of stems, and the labelled rows that the models are fitted on at most.
STEMS, SAMPLE = (4, 5, 6), 20_000
#: Words and stems that become voters without meaning, expected over all that are looked at.
CHANCE = 10.0
#: Share of the texts of a mined voter that are of the class it speaks for, at least (or so many times the odds of the
#: whole, if that class is the larger one): a voter is right more often than wrong.
RIGHT = 0.6
#: Mined voters at most: those of the largest gain. What they are chosen from is counted whole.
VOTERS = 4096
#: Words whose voters a Python worker keeps, and stems that a task counts before it hands them on.
HELD_WORDS, COUNTED = 30_000, 1 << 17


def stems_of(word: str) -> set[str]:
    """The word, marked as whole, and its stems."""
    return {f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)}


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Voters:
    """Fixed lexicons and patterns (0 to FIXED - 1), then mined words and stems, which may speak for either side."""

    def __init__(self, mined: list[str]) -> None:
        self.mined = {x: FIXED + i for i, x in enumerate(mined)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return FIXED + len(self.mined)

    def fired(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in _words(text):
            own = self.known.get(w)
            if own is None:
                if len(self.known) >= HELD_WORDS:
                    self.known.clear()
                own = self.known[w] = (*_LEXICON_OF.get(w, ()), *(self.mined[x] for x in stems_of(w) if x in self.mined))
            if own:
                out.update(own)
        low = (text or "").lower()
        for i, (name, p) in enumerate(_PATTERNS.items()):
            if any(h in low for h in _HINTS[name]) and p.search(text):
                out.add(len(LEXICONS) + i)
        return out


class Sparse:
    """Rows of the columns that are 1."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(rows), width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], self.n)

    def sums(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, of_rows[self.row], self.width)

    def block(self, first: int, n: int) -> np.ndarray:
        """Rows first to first + n - 1 in full."""
        a, b = np.searchsorted(self.row, [first, first + n])
        out = np.zeros((min(n, self.n - first), self.width), np.float32)
        out[self.row[a:b] - first, self.at[a:b]] = 1
        return out


#: Rows and voters whose correlations are worked on at once.
BLOCK = 1024


class LabelModel:
    """Two-class mixture over binary voters, fitted by EM: how often each voter fires in either class (its accuracy), and
    how voters correlate within a class.

    The given labels are no voter. They calibrate: each accuracy has the voter's rate on the labelled rows
    as its prior, worth `trust` times the rows, so that the classes stay toxic and clean; the posterior is of the
    votes alone. A voter that does not fire has no say of its own (a word of one language says nothing about texts without
    it), but silence counts in all: what the votes add up to is brought to odds by a slope and an offset that fit the
    labels best, so the posteriors' mean is the labels' share and cannot drift from round to round, and rows on which
    nothing fires fall below that share as those on which much does rise. A
    voter's say is divided by the sum of its squared correlations (the variance that it shares), so that ten voters that
    always fire together count as one; correlations come from the labels first, then from the posteriors of earlier rounds.
    """

    def __init__(self, votes: Sparse, labels: np.ndarray, trust: float = 1.0, rounds: int = 20) -> None:
        gold = np.stack([1 - labels, labels]).astype(float)
        overall = (votes.sums(np.ones(votes.n)) + 0.1) / (votes.n + 0.2)
        base = (np.stack([votes.sums(g) for g in gold]) + overall) / (gold.sum(axis=1)[:, None] + 1)
        self.fires, self.slope, self.offset = base, 1.0, 0.0
        self.say = 1 / self.shared(votes, gold)
        for i in range(rounds):
            self._calibrate(votes, labels)
            q = self.posterior(votes)
            mass = np.stack([1 - q, q])
            if i in (rounds // 3, 2 * rounds // 3):
                self.say = 1 / self.shared(votes, mass)
            own, prior = mass.sum(axis=1)[:, None], trust * gold.sum(axis=1)[:, None]
            self.fires = np.clip((np.stack([votes.sums(m) for m in mass]) + prior * base) / (own + prior), 1e-6, 1 - 1e-6)
        self._calibrate(votes, labels)

    def _calibrate(self, votes: Sparse, labels: np.ndarray) -> None:
        """Slope and offset by Newton steps, on targets that one row more of each class keeps from 0 and 1."""
        x, n_bad = self._odds(votes), labels.sum()
        target = np.where(labels > 0, (n_bad + 1) / (n_bad + 2), 1 / (votes.n - n_bad + 2))
        scaled = np.stack([x, np.ones(votes.n)])
        w = np.array([1.0, np.log((n_bad + 1) / (votes.n - n_bad + 1)) - x.mean()])
        loss = lambda w: np.logaddexp(0, w @ scaled).sum() - target @ (w @ scaled)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(w @ scaled, -30, 30)))
            step = np.linalg.solve((scaled * (q * (1 - q))) @ scaled.T + 1e-6 * np.eye(2), scaled @ (q - target))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        self.slope, self.offset = w

    def _odds(self, votes: Sparse) -> np.ndarray:
        return votes.times(self.say * np.log(self.fires[1] / self.fires[0]))

    def shared(self, votes: Sparse, mass: np.ndarray) -> np.ndarray:
        """Sum of the squared correlations of each voter with all that fire beside it, itself included, within classes."""
        of_class = list(zip(mass, self.fires, strict=True))
        var = sum(m.sum() * p * (1 - p) for m, p in of_class)
        out = np.ones(votes.width)
        for at in range(0, votes.width, BLOCK):
            own = np.arange(at, min(at + BLOCK, votes.width))
            cov = -sum(m.sum() * np.outer(p[own], p) for m, p in of_class)
            for first in range(0, votes.n, BLOCK):
                x = votes.block(first, BLOCK)
                for m, _ in of_class:
                    cov += (x[:, own] * m[first : first + BLOCK, None].astype(np.float32)).T @ x
            r2 = np.clip(cov / np.sqrt(np.maximum(np.outer(var[own], var), 1e-12)), 0, 1) ** 2
            r2[np.arange(len(own)), own] = 0
            out[own] += r2.sum(axis=1)
        return out

    def posterior(self, votes: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self._odds(votes) + self.offset, -30, 30)))


def fit_linear(x: Sparse, target: np.ndarray, rounds: int = 300, decay: float = 1e-3, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over 0/1 features, by Adagrad; both classes weigh the same."""
    balance = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3)) / max(x.n, 1)
    weights, bias, squares, own = np.zeros(x.width), -1.0, np.full(x.width, 1e-8), 1e-8
    for _ in range(rounds):
        odds = x.times(weights) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target) * balance
        g, b = x.sums(error) + decay * weights, error.sum()
        squares += g * g
        own += b * b
        weights -= rate * g / np.sqrt(squares)
        bias -= rate * b / np.sqrt(own)
    return weights, float(bias)


class Classifier:
    """A weight of each voter."""

    def __init__(self, voters: Voters, weights: np.ndarray, bias: float) -> None:
        self.voters, self.weights, self.bias = voters, weights.tolist(), bias

    def score(self, text: str | None) -> float:
        odds = self.bias + sum(self.weights[i] for i in sorted(self.voters.fired(text)))
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    bad: Counter[str] = Counter()

    def hand_on() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.record_batch({"stem": pa.array(keys, pa.string()), "n": pa.array([seen[k] for k in keys], pa.int64()), "bad": pa.array([bad[k] for k in keys], pa.int64())})
        seen.clear()
        bad.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            own = set(chain.from_iterable(map(stems_of, _words(text.as_py()))))
            seen.update(own)
            if label.as_py():
                bad.update(own)
            if len(seen) >= COUNTED:
                yield hand_on()
    yield hand_on()


def mine(rows: DataFrame, n: int, n_bad: int, chance: float = CHANCE, right: float = RIGHT) -> list[str]:
    """Words and stems of rows (text, label) whose documents' labels differ from the overall share by more than `chance`
    of them would without any meaning (log likelihood ratio against the number looked at), and that are right in `right`
    of their texts. Counted by Spark; the driver gets those that pass both tests, for toxic or for
    clean, VOTERS at most."""
    stems = common.checkpointed(rows.mapInArrow(_count_stems, "stem string, n long, bad long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    base = n_bad / n
    part = lambda k, share: F.when(k > 0, k * F.ln(k / F.col("n") / share)).otherwise(0.0)
    gain = part(F.col("bad"), base) + part(F.col("n") - F.col("bad"), 1 - base)
    looked_at = stems.where("n > 1").count()
    odds = lambda k, of: (k / of) / ((F.col("n") - k + 0.5) / (n - of + 0.5))
    asked = right / (1 - right)
    toxic = odds(F.col("bad"), n_bad) >= asked * max(1.0, (n - n_bad) / n_bad)
    clean = odds(F.col("n") - F.col("bad"), n - n_bad) >= asked * max(1.0, n_bad / (n - n_bad))
    chosen = stems.where((toxic | clean) & (gain > float(np.log(max(looked_at, 1) / chance)))).select("stem", gain.alias("gain")).orderBy(F.desc("gain"), "stem").limit(VOTERS)
    return sorted(r["stem"] for r in chosen.select("stem").collect())


def _fired(voters: Voters, spark: SparkSession, text: str) -> Column:
    shared = spark.sparkContext.broadcast(voters)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(shared.value.fired(x.as_py())) for x in texts], pa.list_(pa.int32()))

    return of(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Classifier:
    """Learned from rows of docs that have a label in labels (id_col, label_col) and are not held out.

    At most `sample` labelled ids are used, those of the smallest hash: a bound of what is fitted on, not
    of what is scored. Labels that contradict each other for one id count as toxic; of several texts of
    one id the least is learned from. Without
    any labelled row, or with labels of one kind, the fixed voters decide alone.
    """
    given = labels.where(F.col(label_col).isNotNull() & ~common.is_held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = given.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = common.checkpointed(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_bad in (0, n):
        return Classifier(Voters([]), np.array([4.0] * len(LEXICONS) + [2.0] * len(PATTERNS)), -3.0)
    voters = Voters(mine(rows.select("text", "label"), n, n_bad))
    got = rows.select("id", "label", _fired(voters, docs.sparkSession, "text").alias("fired")).orderBy("id").toArrow()
    votes = Sparse([x.values.to_numpy(zero_copy_only=False) for x in got["fired"]], len(voters))
    posterior = LabelModel(votes, got["label"].to_numpy().astype(float)).posterior(votes)
    odds = (n - n_bad) / n_bad  # as if both classes were equally frequent
    posterior = posterior * odds / (posterior * odds + 1 - posterior)
    return Classifier(voters, *fit_linear(votes, posterior))


def score(spark: SparkSession, model: Classifier, text: Column) -> Column:
    """Score from 0 to 1 of a text, higher for toxic; null and empty texts get the score of no words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x.as_py()) for x in texts], pa.float64())

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row, repeated rows and null ids (held out) included; predicted is 1
    from 0.5 on. An empty table gives none; other columns are not looked at."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    scored = docs.select(F.col(id_col), common.is_held_out(id_col).alias("held_out"), score(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay as they are."""
    text = names.get("text_col", "text")
    model = train(docs, labels, **names)
    return docs.where(score(docs.sparkSession, model, F.col(text)) < 0.5)
