"""Toxicity by maximum-scoring segments of token log-odds.

1. Words and their longer beginnings (inflected and compound forms share those) are counted once a document, by label,
   over a bounded sample of labelled documents outside the held-out fold. A key's score is the difference of its log-odds in toxic and
   clean text under a Dirichlet prior in proportion to its frequency in both. A word takes the score of its most
   specific key that is ``least_z`` standard errors from nothing; words without one share one pooled score, which is
   negative, so that clean text drifts down.
2. A linear-time scan over a document's scores finds all maximal segments, each a passage with more evidence than any
   way to extend or cut it.
3. Under the word scores of clean text, the greatest segment of ``n`` words exceeds ``s`` with probability
   ``1 - exp(-K n exp(-lambda s))``: lambda solves the moment equation of the clean scores, K is fitted to the
   segments of clean documents. Segments with a small chance count, by their excess, in the document's evidence.
4. Evidence becomes a probability by a logistic fit on the half of the sample that the word scores have not seen.

Samples hold at most ``per_label`` documents of each label and are picked by a hash of the id. The table keeps the
``most_words`` clearest keys. Null and empty texts have no segment and the score of no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import fold, map_columns, stored, table

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (9, 8, 7, 6, 5, 4)
NO_EVIDENCE = (0.0, 0.0)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def keys_of(word: str) -> list[str]:
    """The word, then its beginnings from the longest to the shortest, marked as such."""
    return [word, *[word[:k] + "~" for k in BEGINNINGS if len(word) > k]]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass with a stack of candidates.

    Each candidate knows the nearest one below it with a lower sum before. Where a new candidate has none, no later step
    can reach the others, so they are final and leave the stack; the time is linear.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at its end, place of the lower one
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][2] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= right:
                break
            start, left, below = stack[at][0], stack[at][2], stack[at][4]
            del stack[at:]
            at = below
        if at < 0:
            done += [(a, b, high - low) for a, b, low, high, _ in stack]
            stack.clear()
        stack.append((start, i + 1, left, right, at))
    return done + [(a, b, high - low) for a, b, low, high, _ in stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray, toxic_words: float, clean_words: float,
             prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Differences of log-odds and their standard scores. The Dirichlet prior has ``prior`` times as many words as
    both kinds of text together, shared as in both."""
    a = np.maximum(prior * (toxic + clean), 1e-9)
    total = prior * (toxic_words + clean_words)

    def odds(y: np.ndarray, n: float) -> np.ndarray:
        return np.log(y + a) - np.log(np.maximum(n + total - y - a, 1e-9))

    gap = odds(toxic, toxic_words) - odds(clean, clean_words)
    return gap, gap / np.sqrt(1 / (toxic + a) + 1 / (clean + a))


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda at which the mean of ``exp(lambda * score)`` is one, for scores of negative mean."""
    low, high = 1e-3, 1e-3
    if not (scores > 0).any():
        return 1.0
    while (shares * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return high


class Model:
    """Word scores, their calibration and the logistic fit; ``words`` maps a word to its score."""

    def __init__(self, words: dict[str, float]):
        self.words, self.rest, self.rate, self.scale = words, -0.05, 1.0, 1.0
        self.fit = np.array([-3.0, 0.0, 0.0])
        self.known: dict[str, float | None] = {}

    def word_score(self, word: str) -> float | None:
        """Score of the word's most specific key in the table; remembered, in a table that starts anew when full."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 300_000:
            self.known.clear()
        found = next((s for k in keys_of(word) if (s := self.words.get(k)) is not None), None)
        self.known[word] = found
        return found

    def set_background(self, rows: list[tuple[float | None, int, int]]) -> None:
        """Set the pooled score of unscored words and lambda from the counts of each score in toxic and clean text."""
        toxic, clean = max(1, sum(r[1] for r in rows)), max(1, sum(r[2] for r in rows))
        rest = [r for r in rows if r[0] is None]
        t, c = sum(r[1] for r in rest), sum(r[2] for r in rest)
        self.rest = min(-0.01, math.log((t + 1) / (toxic + 2)) - math.log((c + 1) / (clean + 2)))
        scores = np.array([self.rest if r[0] is None else r[0] for r in rows])
        self.rate = decay(scores, np.array([r[2] for r in rows], float) / clean)

    def segments(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float]]]:
        """The words of ``text`` and its maximal segments. Runs of unscored words are one step of the scan."""
        found = words_of(text)
        steps, places, last = [], [], -1
        for i, s in enumerate(map(self.word_score, found)):
            if s is None:
                continue
            if i - last > 1:
                steps.append(self.rest * (i - last - 1))
                places.append(last + 1)
            steps.append(s)
            places.append(i)
            last = i
        ends = [*places[1:], last + 1]
        return found, [(places[a], ends[b - 1], s) for a, b, s in maximal_segments(steps)]

    def significant(self, text: str | None, chance: float = 0.05) -> list[tuple[int, int, float]]:
        """Segments that clean text of this length would hold with at most ``chance``, with their excess score."""
        found, all_segments = self.segments(text)
        base = math.log(max(1e-12, self.scale * max(1, len(found))))
        need = -math.log(-math.log1p(-chance))
        return [(a, b, self.rate * s - base - need) for a, b, s in all_segments if self.rate * s - base > need]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the strongest and of the summed excess of the significant segments."""
        excess = [x for _, _, x in self.significant(text)]
        return (math.log1p(max(excess)), math.log1p(sum(excess))) if excess else NO_EVIDENCE

    def calibrate(self, clean: list[tuple[float, int]]) -> None:
        """Fit K to (greatest segment, words) of clean documents: the mean of lambda s - ln n is ln K + 0.5772."""
        gaps = [self.rate * s - math.log(max(1, n)) for s, n in clean]
        self.scale = math.exp(float(np.mean(gaps)) - 0.5772) if gaps else 1.0

    def learn(self, evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> None:
        """Weighted logistic fit by Newton steps with a small ridge."""
        x = np.column_stack([np.ones(len(labels)), evidence])
        fit, ridge = np.zeros(3), 1e-2 * np.eye(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
            slope = x.T @ (weights * (labels - p)) - ridge @ fit
            step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, slope)
            fit = fit + np.clip(step, -4, 4)
        self.fit = fit

    def probability(self, evidence: tuple[float, float]) -> float:
        z = float(self.fit[0] + self.fit[1] * evidence[0] + self.fit[2] * evidence[1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def pick(labels: DataFrame, per_label: int, seed: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` ids of each label (``doc_id, toxic, half``) and how many ids each label has."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    h = F.xxhash64("doc_id", F.lit(seed))
    parts = [marked.where(F.col("toxic") == t).orderBy(h, "doc_id").limit(per_label) for t in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2))), counts


def learn_words(found: list[tuple[str, int, int]], toxic_words: int, clean_words: int, prior: float,
                least_z: float) -> Model:
    """A model from counts of keys (key, in toxic text, in clean text) and the number of words of either kind."""
    t, c = np.array([x[1] for x in found], float), np.array([x[2] for x in found], float)
    odds, z = log_odds(t, c, toxic_words, clean_words, prior)
    return Model({found[i][0]: float(np.clip(odds[i], -3, 5)) for i in np.flatnonzero(np.abs(z) >= least_z).tolist()})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 5000, prior: float = 1.0, least_z: float = 2.0) -> Model:
    """A model learned from ``labels`` (``doc_id``, ``toxic``) and the texts of those ids in ``docs``: every key of those
    texts with a standard score of at least ``least_z`` either way."""
    ids, counts = pick(labels, per_label)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * per_label ids

    def count(batches: Iterator[dict]) -> Iterator[tuple]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                held[toxic].update(set(words_of(text)))
        rows = [(w, t, n) for t, c in held.items() for w, n in c.items()]
        for at in range(0, len(rows), 50_000):
            yield tuple(zip(*rows[at:at + 50_000]))

    def widen(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            rows = [(k, t, c) for w, t, c in zip(batch["word"], batch["t"], batch["c"]) for k in keys_of(w)]
            yield tuple(zip(*rows)) if rows else ([], [], [])

    counted = map_columns(chosen.where("half = 0").select("text", "toxic"), count, "word string, toxic int, n long")
    by_word = stored(counted.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")), "word-counts")
    totals = by_word.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    nt, nc = totals["t"], totals["c"]
    by_key = map_columns(by_word, widen, "key string, t long, c long").groupBy("key").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))
    a, total, floor = F.lit(prior) * (F.col("t") + F.col("c")), prior * (nt + nc), F.lit(1e-9)
    odds = {y: F.log(F.col(y) + a) - F.log(F.greatest(F.lit(n + total) - F.col(y) - a, floor)) for y, n in (("t", nt), ("c", nc))}
    z = (odds["t"] - odds["c"]) / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    far = by_key.where(F.abs(z) >= least_z - 1e-6).collect()  # keys of at most 2 * per_label texts
    model = learn_words(sorted((r["key"], r["t"], r["c"]) for r in far), nt, nc, prior, least_z)

    def by_score(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            yield [model.word_score(w) for w in batch["word"]], batch["t"], batch["c"]

    model.set_background([tuple(r) for r in map_columns(by_word, by_score, "score double, t long, c long").groupBy(
        "score").agg(F.sum("t"), F.sum("c")).orderBy("score").collect()])

    def measure(model: Model):
        def run(batches: Iterator[dict]) -> Iterator[tuple]:
            for batch in batches:
                found = [model.segments(t) for t in batch["text"]]
                most = [max([s for _, _, s in segments], default=0.0) for _, segments in found]
                pairs = [model.evidence(t) for t in batch["text"]]
                yield (batch["toxic"], most, [len(w) for w, _ in found], [p[0] for p in pairs], [p[1] for p in pairs])

        rows = chosen.where("half = 1").orderBy("doc_id").select("text", "toxic")
        return map_columns(rows, run, "toxic int, most double, n int, a double, b double").collect()

    model.calibrate([(r["most"], r["n"]) for r in measure(model) if r["toxic"] == 0])
    rows = measure(model)  # again, as evidence depends on K
    if rows:
        y = np.array([r["toxic"] for r in rows], float)
        seen = {k: max(1.0, float((y == k).sum())) for k in (0, 1)}
        weights = np.array([counts.get(int(v), 0) / seen[int(v)] for v in y])
        weights *= len(rows) / max(1.0, weights.sum())
        model.learn(np.array([[r["a"], r["b"]] for r in rows]), y, weights)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``passages``: the significant segments by word place, with their excess."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        model = Model({})
        vars(model).update(shared.value)
        for batch in batches:
            found = [model.significant(t) for t in batch["text"]]
            marks = [(math.log1p(max(x)), math.log1p(sum(x))) if (x := [e for _, _, e in f]) else NO_EVIDENCE
                     for f in found]
            yield (batch["doc_id"], [model.probability(m) for m in marks],
                   [[{"first": a, "last": b, "excess": e} for a, b, e in f] for f in found])

    return map_columns(docs.select("doc_id", "text"), run,
                       "doc_id long, score double, passages array<struct<first: int, last: int, excess: double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score(docs, fit(docs, labels.where(fold(F.col("doc_id")) != 0)))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
