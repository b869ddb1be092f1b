"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Training is backpropagation through time on a bounded sample: at most ``per_lang`` pieces of ``_SAMPLE_CHARS``
characters for each language, each cut into windows of ``WINDOW`` bytes, from documents outside the held-out fold, picked
by a hash of the id and with a hash-chosen place in the text. Prediction runs over every byte of every text: each
position gets a distribution over languages from both directions, and the document's is the mean over its positions.
The state starts anew in each window of ``WINDOW`` bytes, so no position sees beyond its own.

Null texts and texts without a letter are ``und`` with score 0, as is every text where no language could be learned.
Rows come back one for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medgrain.llm.common import fold, map_columns, table

WINDOW, HIDDEN = 64, 6
_SAMPLE_CHARS = 192


def new_weights(classes: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    """``x`` input table by byte, ``u`` recurrent weights and ``b`` bias of the new state, per direction; ``o`` output.

    Columns hold the update gate, the reset gate and the candidate state.
    """
    rng, out = np.random.default_rng(seed), {}
    for d in "fb":
        out[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        out[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
        out[f"b{d}"] = np.zeros(hidden)
    out["o"] = rng.normal(0, 0.3, (2 * hidden, classes))
    out["ob"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _states(w: dict, d: str, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states of one direction; ``steps`` are bytes by (time, window). ``trace`` gets what training needs."""
    x, u, bias = w[f"x{d}"], w[f"u{d}"], w[f"b{d}"]
    h = len(u)
    state = np.zeros((steps.shape[1], h), np.float32)
    out = np.empty((*steps.shape, h), np.float32)
    order = range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1)
    for t in order:
        into, rec = x[steps[t]], state @ u
        gates = np.tanh(0.5 * (into[:, :2 * h] + rec[:, :2 * h])) * 0.5 + 0.5
        update, reset, back = gates[:, :h], gates[:, h:], rec[:, 2 * h:] + bias
        fresh = np.tanh(into[:, 2 * h:] + reset * back)
        if trace is not None:
            trace.append((t, state, update, reset, back, fresh))
        state = fresh + update * (state - fresh)
        out[t] = state
    return out


def position_scores(w: dict, steps: np.ndarray) -> np.ndarray:
    """Unnormalised class probabilities by (time, class, window), as in training but laid out for speed.

    Units run along the first axis and windows along the last; a gate is ``(1 + tanh(x / 2)) / 2``.
    """
    logits = w["ob"][:, None]
    index = steps.astype(np.intp)
    for i, d in enumerate("fb"):
        h = len(w[f"b{d}"])
        halved = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), h)[:, None]
        x, u, bias = w[f"x{d}"].T * halved, w[f"u{d}"].T * halved, w[f"b{d}"][:, None]
        state, states = np.zeros((h, steps.shape[1]), np.float32), np.empty((len(steps), h, steps.shape[1]), np.float32)
        into, rec = np.empty((2, 3 * h, steps.shape[1]), np.float32)
        gates, fresh, back = into[:2 * h], into[2 * h:], rec[2 * h:]
        for t in range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1):
            np.take(x, index[t], axis=1, out=into, mode="clip")
            np.matmul(u, state, out=rec)
            gates += rec[:2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            back += bias
            back *= gates[h:]
            fresh += back
            np.tanh(fresh, out=fresh)
            state -= fresh
            state *= gates[:h]
            state += fresh
            states[t] = state
        logits = logits + np.matmul(w["o"][i * h:(i + 1) * h].T, states)
    return np.exp(logits)


def gradients(w: dict, steps: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the positions in ``mask`` and its gradient, through time in both directions."""
    traces = {"f": [], "b": []}
    hidden = {d: _states(w, d, steps, traces[d]) for d in "fb"}
    both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
    logits = both @ w["o"] + w["ob"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    count = max(1.0, float(mask.sum()))
    columns = np.arange(steps.shape[1])
    loss = -float((np.log(prob[:, columns, labels] + 1e-12) * mask).sum()) / count
    prob[:, columns, labels] -= 1
    prob *= (mask / count)[:, :, None]
    out = {"o": np.tensordot(both, prob, ((0, 1), (0, 1))), "ob": prob.sum(axis=(0, 1))}
    into = prob @ w["o"].T
    for i, d in enumerate("fb"):
        u = w[f"u{d}"]
        h = len(u)
        gx, gu, gb = np.zeros_like(w[f"x{d}"]), np.zeros_like(u), np.zeros_like(w[f"b{d}"])
        later = np.zeros((steps.shape[1], h), np.float32)
        for t, state, update, reset, back, fresh in reversed(traces[d]):
            g = into[t][:, i * h:(i + 1) * h] + later
            g_fresh = g * (1 - update) * (1 - fresh * fresh)
            g_update = g * (state - fresh) * update * (1 - update)
            g_reset = g_fresh * back * reset * (1 - reset)
            g_rec = np.concatenate([g_update, g_reset, g_fresh * reset], axis=1)
            g_in = np.concatenate([g_update, g_reset, g_fresh], axis=1)
            later = g * update + g_rec @ u.T
            gu += state.T @ g_rec
            gb += (g_fresh * reset).sum(axis=0)
            np.add.at(gx, steps[t], g_in)
        out |= {f"x{d}": gx, f"u{d}": gu, f"b{d}": gb}
    return loss, out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in windows: (time, window) bytes and mask, and the text of each window."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    mask = np.zeros(flat.shape, bool)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        flat[at:at + n].reshape(-1)[:len(text)] = np.frombuffer(text, np.uint8)
        mask[at:at + n].reshape(-1)[:len(text)] = True
        at += n
    return np.ascontiguousarray(flat.T), np.ascontiguousarray(mask.T), np.repeat(np.arange(len(texts)), counts)


def train(samples: list[tuple[bytes, int]], classes: int, rounds: int = 320, batch: int = 192, rate: float = 0.03,
          seed: int = 3) -> dict[str, np.ndarray]:
    """Weights fitted by Adam; batches draw the classes evenly."""
    w, rng = new_weights(classes, seed=seed), np.random.default_rng(seed)
    steps, mask, owner = windows([t for t, _ in samples])
    labels = np.array([c for _, c in samples])[owner]
    members = [m for c in range(classes) if len(m := np.flatnonzero(labels == c))]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for k in range(rounds):
        some = np.concatenate([rng.choice(m, -(-batch // len(members))) for m in members])
        _, g = gradients(w, steps[:, some], labels[some], mask[:, some].astype(np.float32))
        now = rate * min(1.0, (k + 1) / 20) * 0.5 * (1 + np.cos(np.pi * k / rounds))
        for name, value in w.items():
            first[name] += 0.1 * (g[name] - first[name])
            second[name] += 0.01 * (g[name] ** 2 - second[name])
            value -= now * (first[name] / (1 - 0.9 ** (k + 1))) / (
                np.sqrt(second[name] / (1 - 0.99 ** (k + 1))) + 1e-8)
    return w


def pooled(w: dict, texts: list[bytes], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Mean distribution of each text over its positions, and how many positions each class labels."""
    classes = len(w["ob"])
    sums, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes))
    steps, mask, owner = windows(texts)
    for at in range(0, len(owner), at_once):
        some = slice(at, at + at_once)
        scores, here = position_scores(w, steps[:, some]), mask[:, some].astype(np.float32)
        weight = here / scores.sum(axis=1)
        best = scores == scores.max(axis=1, keepdims=True)
        np.add.at(sums, owner[some], np.einsum("tcw,tw->wc", scores, weight))
        np.add.at(labelled, owner[some], np.einsum("tcw,tw->wc", best.astype(np.float32), here))
    return sums / np.maximum(1, [len(t) for t in texts])[:, None], labelled


def sample(docs: DataFrame, per_lang: int, seed: int = 11) -> list[tuple[bytes, str]]:
    """At most ``per_lang`` pieces of text for each language; where documents are few, several from each."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn(
        "h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)))
    counts = rows.groupBy("lang").count()
    picked = rows.join(F.broadcast(counts), "lang").where(F.col("h") < 1_200_000 * per_lang / F.col("count"))
    repeats = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.lit(per_lang) / F.col("count")))).cast("int")
    room = F.greatest(F.lit(1), F.char_length("text") - _SAMPLE_CHARS)
    pieces = picked.withColumn("k", F.explode(F.sequence(F.lit(1), repeats))).select(
        "lang", "h", "doc_id", "k",
        F.substring("text", (F.pmod(F.xxhash64("doc_id", "k"), room) + 1).cast("int"), F.lit(_SAMPLE_CHARS)).alias("t"))
    out, taken = [], {}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"] or 0, r["k"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            out.append((r["t"].encode(), r["lang"]))
    return out


def fit(docs: DataFrame, per_lang: int = 1500, rounds: int = 320) -> tuple[list[str], dict]:
    """Languages and weights learned from ``docs`` (``doc_id``, ``text``, ``lang``)."""
    found = sample(docs, per_lang)
    langs = sorted({x for _, x in found})
    return langs, train([(t, langs.index(x)) for t, x in found], len(langs), rounds) if langs else {}


def identify(docs: DataFrame, langs: list[str], weights: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``lang_pred``, ``score`` and ``agreeing``, the share of the text's
    positions that are labelled with ``lang_pred``."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, weights))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", *keep, F.when(lettered, F.col("text")).alias("_text"))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        langs, weights = shared.value
        for batch in batches:
            texts = [(t or "").encode() if langs else b"" for t in batch["_text"]]
            names, scores, agreeing, at = [], [], [], 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (held < 1 << 20 or stop == at):
                    held += len(texts[stop])
                    stop += 1
                known = [i for i in range(at, stop) if texts[i]]
                mean, labelled = pooled(weights, [texts[i] for i in known]) if known else (None, None)
                found = {}
                for k, i in enumerate(known):
                    best = int(mean[k].argmax())
                    found[i] = (langs[best], float(min(1.0, mean[k][best])), labelled[k][best] / len(texts[i]))
                for i in range(at, stop):
                    name, score, share = found.get(i, ("und", 0.0, 0.0))
                    names.append(name)
                    scores.append(score)
                    agreeing.append(float(share))
                at = stop
            yield (batch["doc_id"], *[batch[c] for c in keep], names, scores, agreeing)

    kind = T.StructType([T.StructField("doc_id", T.LongType()), *[docs.schema[c] for c in keep],
                         T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("agreeing", T.DoubleType())])
    return map_columns(rows, run, kind, as_is=keep)


def keep_known(docs: DataFrame, langs: list[str], weights: dict) -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language: all but null texts and texts without a letter.

    Neither the mix of languages in a text nor the network's certainty rejects it. Where no language could be learned,
    every text with a letter stays.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).where(F.col("text").rlike(r"\p{L}"))
    if not langs:
        return rows.select("_row.*")
    return identify(rows, langs, weights, keep=("_row",)).where(F.col("lang_pred") != "und").select("_row.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, weights = fit(docs.where(fold(F.col("doc_id")) != 0))
    found = identify(docs, langs, weights)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "agreeing")
