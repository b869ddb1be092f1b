"""Exact duplicate removal by composable polynomial fingerprints.

A text's fingerprint is the value of its bytes as a polynomial, modulo 2^61 - 1, at two fixed points. Fingerprints
compose: ``H(A + B) = H(A) * r^len(B) + H(B)``. Short texts are hashed where they are read. A text over
``long_bytes`` is cut into chunks that are dealt over the cluster; each chunk's hash is shifted by the length that
follows it and the shifted hashes are summed, which combines them in any order.

Texts with equal length and fingerprints are then compared with their group's representative (the largest id) chunk
by chunk: the join streams the members' chunks past the one chunk of the representative. Members that differ, which
takes a collision of a 122-bit value, are regrouped by fingerprint and SHA-256.

Nulls count as empty texts. Rows repeated with the same id and text count in ``group_size``; the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import map_columns, stored, table, texts

PRIME = (1 << 61) - 1
POINTS = (1_234_567_890_123_456_789 % PRIME, 987_654_321_987_654_321 % PRIME)
ROW = 512
CHUNK = 1 << 16
LIMB = 21
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["n_bytes", "f1", "f2"]


def normal(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case."""
    return (text or "").encode().translate(LOWER)


def _weights() -> np.ndarray:
    """Powers of both points for one row of bytes, in three limbs each, as exact doubles."""
    out = np.zeros((ROW, 6))
    for p, point in enumerate(POINTS):
        power = 1
        for i in range(ROW - 1, -1, -1):
            for limb in range(3):
                out[i, 3 * p + limb] = power >> LIMB * limb & (1 << LIMB) - 1
            power = power * point % PRIME
    return out


def fingerprint(data: bytes, weights: np.ndarray) -> tuple[int, int]:
    """Both polynomial values of ``data``; row values come from one matrix product, in memory of one chunk."""
    steps = [pow(point, ROW, PRIME) for point in POINTS]
    h1 = h2 = 0
    first = -len(data) % ROW
    for start in range(-first, len(data), CHUNK):
        part = data[max(start, 0):start + CHUNK]
        padded = np.zeros(max(0, -start) + len(part))
        padded[max(0, -start):] = np.frombuffer(part, np.uint8)
        for a0, a1, a2, b0, b1, b2 in (padded.reshape(-1, ROW) @ weights).astype(np.int64).tolist():
            h1 = (h1 * steps[0] + a0 + (a1 << LIMB) + (a2 << 2 * LIMB)) % PRIME
            h2 = (h2 * steps[1] + b0 + (b1 << LIMB) + (b2 << 2 * LIMB)) % PRIME
    return h1, h2


def shift(value: int, n_bytes: int, which: int) -> int:
    """A hash moved to the left of ``n_bytes`` further bytes."""
    return value * pow(POINTS[which], n_bytes, PRIME) % PRIME


def fingerprints(docs: DataFrame, long_bytes: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, f1, f2, text_sha256, copies``: one row for each distinct id and text."""
    source = texts(docs)

    def short(batches: Iterator[dict]) -> Iterator[tuple]:
        weights = _weights()
        for batch in batches:
            data = [normal(t) for t in batch["text"]]
            pairs = [fingerprint(d, weights) if len(d) <= long_bytes else (None, None) for d in data]
            yield (batch["doc_id"], [len(d) for d in data], [p[0] for p in pairs], [p[1] for p in pairs],
                   [hashlib.sha256(d).hexdigest() for d in data])

    def cut(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = normal(text)
                sha = hashlib.sha256(data).hexdigest()
                for start in range(0, len(data), CHUNK):
                    part = data[start:start + CHUNK]
                    yield [doc_id], [sha], [start // CHUNK], [len(data) - start - len(part)], [part]

    def shifted(batches: Iterator[dict]) -> Iterator[tuple]:
        weights = _weights()
        for batch in batches:
            pairs = [fingerprint(c, weights) for c in batch["chunk"]]
            yield (batch["doc_id"], batch["text_sha256"], batch["chunk_no"],
                   *[[shift(p[i], n, i) for p, n in zip(pairs, batch["after"])] for i in (0, 1)])

    rows = stored(
        map_columns(source, short, "doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string")
        .groupBy("doc_id", "n_bytes", "f1", "f2", "text_sha256").agg(F.count("*").alias("copies")),
        "prints",
    )
    pieces = map_columns(source.where(F.octet_length("text") > long_bytes), cut,
                         "doc_id long, text_sha256 string, chunk_no int, after long, chunk binary")
    terms = map_columns(pieces.repartition("doc_id", "chunk_no"), shifted,
                        "doc_id long, text_sha256 string, chunk_no int, t1 long, t2 long").distinct()
    whole = terms.groupBy("doc_id", "text_sha256").agg(
        *[(F.sum(F.col(t).cast("decimal(20,0)")) % F.lit(PRIME)).cast("long").alias(f)
          for t, f in (("t1", "g1"), ("t2", "g2"))]
    )
    far = rows.where("f1 is null").drop("f1", "f2").join(
        whole.withColumnRenamed("doc_id", "whole_id").withColumnRenamed("text_sha256", "whole_sha"),
        F.col("doc_id").eqNullSafe(F.col("whole_id")) & (F.col("text_sha256") == F.col("whole_sha")),
    )
    return rows.where("f1 is not null").unionByName(
        far.select("doc_id", "n_bytes", F.col("g1").alias("f1"), F.col("g2").alias("f2"), "text_sha256", "copies")
    )


def differing(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Ids and digests of the texts that differ from the representative of their fingerprint."""
    groups = stored(
        prints.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "text_sha256")).alias("rep"))
        .where("n > 1"), "print-groups",
    )
    pairs = prints.join(groups, KEY).select(
        "doc_id", "text_sha256", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_sha256").alias("rep_sha"))
    pairs = stored(pairs, "print-pairs")

    def chunks(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            out, held = [], 0
            for text, sha, *ids in zip(*[batch[c] for c in ("text", "text_sha256", "doc_id", "rep_id", "rep_sha")]):
                data = normal(text)
                if hashlib.sha256(data).hexdigest() != sha:
                    continue
                for start in range(0, max(1, len(data)), CHUNK):
                    out.append((*ids, sha, start // CHUNK, data[start:start + CHUNK]))
                held += len(data)
                if held > 64 * CHUNK:
                    yield tuple(zip(*out))
                    out, held = [], 0
            if out:
                yield tuple(zip(*out))

    kinds = "doc_id long, rep_id long, rep_sha string, text_sha256 string, chunk_no int, chunk binary"
    digest = F.sha2(F.translate("text", UPPER, UPPER.lower()), 256)
    own = texts(docs).select(F.col("doc_id").alias("_own"), "text", digest.alias("_digest"))
    met = own.join(pairs, F.col("_own").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("text_sha256")))
    rows = map_columns(met.drop("_own", "_digest"), chunks, kinds)
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_sha256") == F.col("rep_sha"))
    members = rows.where(~is_rep)
    reps = rows.where(is_rep).select(
        "rep_id", "rep_sha", "chunk_no", F.col("chunk").alias("rep_chunk")).dropDuplicates(
        ["rep_id", "rep_sha", "chunk_no"])
    reps = stored(reps.withColumnsRenamed({c: f"_{c}" for c in ("rep_id", "rep_sha", "chunk_no")}), "print-reps")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rep_id", "rep_sha", "chunk_no")]
    return (
        members.join(reps, same[0] & same[1] & same[2])
        .where(F.col("chunk") != F.col("rep_chunk")).select("doc_id", "text_sha256").distinct()
    )


def exact_duplicates(docs: DataFrame, long_bytes: int = CHUNK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: a row for each row of ``docs``.

    Null ids form rows of their own kind: they never stay before a numbered row of the same text.
    """
    prints = stored(fingerprints(docs, long_bytes), "whole-prints")
    unlike = stored(differing(docs, prints), "unlike").select(
        F.col("doc_id").alias("_unlike"), F.col("text_sha256").alias("sub"))
    same = F.col("doc_id").eqNullSafe(F.col("_unlike")) & (F.col("text_sha256") == F.col("sub"))
    marked = prints.join(unlike, same, "left").withColumn("sub", F.coalesce("sub", F.lit(""))).drop("_unlike")
    classes = stored(
        marked.groupBy(*KEY, "sub").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")),
        "print-classes",
    )
    joined = marked.join(classes, [*KEY, "sub"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; of rows repeated with one id and text, the largest stays."""
    found = stored(exact_duplicates(docs), "duplicates")
    sizes = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("group_size").alias("_size"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    sized = rows.join(sizes, F.col("doc_id").eqNullSafe(F.col("_id")))
    alone = sized.where("_size = 1").select("_row")
    digest = F.sha2(F.translate("text", UPPER, UPPER.lower()), 256)
    stay = found.where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    rest = sized.where("_size > 1").withColumn("_digest", digest).join(
        stay, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_sha")))
    one = rest.groupBy("_keep", "_sha").agg(F.max("_row").alias("_row")).select("_row")
    return alone.unionByName(one).select("_row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) AS d
WINDOW w AS (PARTITION BY norm)"""
