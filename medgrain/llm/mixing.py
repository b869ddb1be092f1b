"""Mixing sources to target weights in fixed-length blocks of words.

1. A source's documents, in order of ``doc_id``, are one run of words, cut into blocks of ``block`` words. Where a
   document begins in its run comes from one range-partitioned sort of narrow rows, so a source of any share of the
   rows is spread over tasks.
2. A source's target in words becomes a quota of block slots. For each output shard, the counts of the sources are a
   multinomial draw with the quotas still open as weights; a draw above what is open is drawn again among the others,
   so the shards together meet the quotas exactly.
3. A source's slots run through pseudorandom permutations of its block numbers, one for each pass: a block is not taken
   a third time before every block was taken twice. A permutation is a Feistel network walked until it lands inside
   the range, so any slot is computed on its own.
4. Slots and documents are joined by (source, block).

Targets share all words by the sources' weights 1, 2, 3, repeating in code-point order (null last); a target stops at
``most`` times its source's words and the excess is shared again. Documents without words are never taken; null texts
have none; repeated rows are documents of their own. The table of sources is held on the driver, a row for each source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medgrain.llm.common import WORD, map_columns, ordered, partitions, stored, table

SEED = 20_011


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if unit * weights[i] > most * sizes[i]]
        for i in over or sorted(open_):
            out[i] = most * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def shard_counts(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each shard (rows) and source (columns); columns sum to the quotas."""
    left, total = np.array(quotas, np.int64), int(sum(quotas))
    out = np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        need = total * (k + 1) // shards - total * k // shards
        rng = np.random.default_rng([seed, k])
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(index: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of ``range(size)``."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


@dataclass
class Mix:
    rows: DataFrame  # the documents with src, size, _index and begin, their first word's place in the source
    sources: DataFrame  # src, source_size, target
    slots: DataFrame  # shard, src, slot, block: the mix itself
    spans: DataFrame  # _index, low, high (words of the document), takes: what the mix takes of each document


def plan(docs: DataFrame, keep: tuple[str, ...] = (), block: int = 128, shards: int | None = None, most: float = 3.0,
         weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED) -> Mix:
    """The mix of ``docs``; ``keep`` names columns to carry in ``rows``."""
    spark = docs.sparkSession
    base = docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"), *[c for c in keep if c not in ("doc_id", "source")])
    found = base.groupBy("source").agg(F.sum("size").alias("n")).collect()
    names = sorted([(r["source"], r["n"]) for r in found], key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    blocks = [-(-n // block) for n in sizes]
    quotas = [min(int(most * b), round(g * b / n)) if n else 0 for g, b, n in zip(goal, blocks, sizes)]
    counts = shard_counts(quotas, shards or partitions(spark), seed)
    firsts = np.cumsum(counts, axis=0) - counts

    before = np.cumsum([0, *sizes]).tolist()
    sources = spark.createDataFrame(
        [(i, s, n, g, b) for i, ((s, n), g, b) in enumerate(zip(names, goal, before))],
        "src int, _source string, source_size long, target double, _first long")
    placed = base.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source")))
    rows = ordered(placed.drop("_source", "source_size", "target"), ["src", "doc_id", "tie"], ("size",))
    rows = rows.withColumn("begin", F.col("_before_size") - F.col("_first")).drop("_before_size", "_first", "tie")

    runs = [(k, s, int(firsts[k, s]) + at, min(1 << 16, int(counts[k, s]) - at))
            for k, s in zip(*np.nonzero(counts)) for at in range(0, int(counts[k, s]), 1 << 16)]
    runs = [(int(k), int(s), a, n) for k, s, a, n in runs]

    def draw(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            for k, s, first, n in zip(*[batch[c] for c in ("shard", "src", "first", "n")]):
                slots = np.arange(first, first + n)
                taken = np.zeros(n, np.int64)
                for turn in range(first // blocks[s], (first + n - 1) // blocks[s] + 1):
                    here = slots // blocks[s] == turn
                    keys = np.random.default_rng([seed, s, turn]).integers(1 << 62, size=4).tolist()
                    taken[here] = permuted(slots[here] % blocks[s], blocks[s], keys)
                yield np.full(n, k, np.int32).tolist(), [s] * n, slots.tolist(), taken.tolist()

    run_rows = spark.createDataFrame(runs, "shard int, src int, first long, n long").repartition("shard", "src", "first")
    slots = stored(map_columns(run_rows, draw, "shard int, src int, slot long, block long"), "slots")

    takes = slots.groupBy("src", "block").agg(F.count("*").alias("takes"))
    last = F.col("begin") + F.col("size")
    places = rows.where("size > 0").select("_index", "src", "begin", "size").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((last - 1) / block)))
    ).select(
        "_index", "src", "block", (F.greatest(F.col("block") * block, "begin") - F.col("begin")).alias("low"),
        (F.least((F.col("block") + 1) * block, last) - F.col("begin")).alias("high"))
    spans = places.join(takes, ["src", "block"]).select("_index", "low", "high", "takes")
    return Mix(rows, sources.drop("_source", "_first"), slots, spans)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: copy k of a document holds the words taken at least k times.

    A document whose words are all taken equally often is repeated whole; parts of one are joined by a line end.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = plan(whole, keep=("_row",), **settings)
    spans = found.spans.groupBy("_index").agg(F.sort_array(F.collect_list(F.struct("low", "high", "takes"))).alias("s"))
    joined = found.rows.join(spans, "_index").select(
        F.col("_row.text").alias("text"), "size", "s", F.col("_row").alias("row"))
    word = re.compile(WORD)

    def copies(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            out_rows, out_texts = [], []
            for text, size, spans, row in zip(*[batch[c] for c in ("text", "size", "s", "row")]):
                whole = sum(x["high"] - x["low"] for x in spans) == size
                words = None
                for k in range(1, max(x["takes"] for x in spans) + 1):
                    parts: list[list[int]] = []
                    for x in spans:
                        if x["takes"] >= k:
                            if parts and parts[-1][1] == x["low"]:
                                parts[-1][1] = x["high"]
                            else:
                                parts.append([x["low"], x["high"]])
                    made = text
                    if not (whole and parts == [[0, size]]):
                        words = words or [m.span() for m in word.finditer(text)]
                        made = "\n".join(text[words[a][0]:words[b - 1][1]] for a, b in parts)
                    out_rows.append(row)
                    out_texts.append(made)
            yield out_rows, out_texts

    kind = T.StructType([T.StructField("row", docs.schema), T.StructField("made", T.StringType())])
    made = map_columns(joined, copies, kind)
    fixed = {"text": F.col("made"), "n_chars": F.char_length("made").cast("long")}
    return made.select(*[fixed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(table(spark, sf_dir, "documents"))
    words = found.spans.select("_index", ((F.col("high") - F.col("low")) * F.col("takes")).alias("n"))
    taken = found.rows.select("_index", "doc_id", "size", "src").join(
        words.groupBy("_index").agg(F.sum("n").alias("taken")), "_index", "left")
    return taken.join(F.broadcast(found.sources), "src").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
