"""Document fingerprints by Order MinHash, which estimates edit similarity.

Each k-mer of code points gets an occurrence number, so repeats differ. For each of ``HASHES`` hash functions the
``PICKED`` k-mers of least hash are taken *in the order of the text* and the tuple is hashed: two texts agree in a
component if they share the minimal k-mers and their order. A fingerprint is the components in hex, 16 bits each;
the likeness of two is the share of equal components.

Documents are dealt by ranges of ``doc_id`` and sorted, so that each meets the next one as rows stream by. The first and
last document of each partition meet across partitions in a join of one row for each partition.

Null texts are empty; an empty text has a fingerprint of its own; a text shorter than a k-mer is one k-mer. Rows with the
same id are ordered by text. The last document's next is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medgrain.llm.common import map_columns, stored, table, texts

K, HASHES, PICKED = 6, 64, 2
_BLOCK = 4096
_RNG = np.random.default_rng(7)
_SALT = _RNG.integers(1 << 32, size=(HASHES, 1), dtype=np.uint64).astype(np.uint32)
_ODD = _RNG.integers(1 << 32, size=(HASHES, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def numbered_kmers(text: str) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers, in order of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    k = min(K, len(points))
    hashes = np.full(len(points) - k + 1, k, np.uint64)
    for j in range(k):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[j:j + len(hashes)]
    high = _mix(hashes) & np.uint64(0xFFFFFFFF)
    order = np.arange(len(high), dtype=np.uint64)
    both = np.sort(high << np.uint64(32) | order)
    same, at = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.concatenate([[True], same[1:] != same[:-1]])
    occurrence = order - np.maximum.accumulate(np.where(opens, order, np.uint64(0)))
    out = np.empty(len(high), np.uint32)
    out[at] = (_mix(same + (occurrence << np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def sketch(text: str) -> np.ndarray:
    """The components of a text's fingerprint."""
    if not text:
        return np.zeros(HASHES, np.uint16)
    items = numbered_kmers(text)
    rows, least, places = np.arange(HASHES), [], []
    for begin in range(0, len(items), _BLOCK):
        hashed = (items[begin:begin + _BLOCK] ^ _SALT) * _ODD
        for _ in range(min(PICKED, hashed.shape[1])):
            at = hashed.argmin(axis=1)
            least.append(hashed[rows, at])
            places.append(at + begin)
            hashed[rows, at] = np.uint32(0xFFFFFFFF)
    least, places = np.stack(least, 1), np.stack(places, 1)
    if least.shape[1] > PICKED:
        best = np.argsort(least, axis=1, kind="stable")[:, :PICKED]
        places = np.take_along_axis(places, best, 1)
    places.sort(axis=1)
    out = np.zeros(HASHES, np.uint64)
    for column in places.T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + items[column] + np.uint64(1))
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def to_hex(parts: np.ndarray) -> str:
    return parts.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compared(doc_id: int, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    new = mine if changed == text else sketch(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_hex(mine), to_hex(new),
            likeness(mine, new), likeness(mine, theirs))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row of ``_RESULT`` for each row of ``docs``."""
    placed = texts(docs).repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text").select(
        F.spark_partition_id().alias("part"), "doc_id", "text")
    blank = (None,) * 7

    def stream(batches: Iterator[dict]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            out = []
            for part, doc_id, text in zip(batch["part"], batch["doc_id"], batch["text"]):
                now = (doc_id, text, sketch(text))
                if held is None:
                    out.append((0, part, text, *blank))
                else:
                    out.append((2, part, None, *_compared(*held, *now[1:])))
                held = now
                if len(out) == 500:
                    yield tuple(zip(*out))
                    out = []
            if out:
                yield tuple(zip(*out))
        if held is not None:
            yield tuple([x] for x in (1, part, held[1], held[0], *blank[1:]))

    found = stored(map_columns(placed, stream, "kind int, part int, text string, " + _RESULT), "fingerprints")
    heads = found.where("kind = 0").select("part", F.col("text").alias("following"))
    in_order = Window.orderBy("part")  # a row for each partition
    everywhere = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(everywhere)).alias("to"))
    tails = found.where("kind = 1").select("part", "doc_id", "text").join(after, "part").join(
        heads.withColumnRenamed("part", "to"), "to")

    def ends(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text, following in zip(batch["doc_id"], batch["text"], batch["following"]):
                yield tuple([x] for x in _compared(doc_id, text, sketch(text), following, sketch(following)))

    inner = found.where("kind = 2").drop("kind", "part", "text")
    return inner.unionByName(map_columns(tails.select("doc_id", "text", "following"), ends, _RESULT))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
