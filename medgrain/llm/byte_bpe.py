"""Byte-level BPE with one global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and writes, for every batch of texts, the batch's distinct pre-tokens and
   each text's pre-tokens as positions in that list. Stored once, bucketed by batch.
2. The distinct pre-tokens of all batches are dealt by a hash of the word, packed in one row for each batch and hash
   range, so that each distinct word meets in one place and is encoded once there (again where a range holds more than
   ``MOST_WORDS``); a very common word is sent once for each batch, not once for each use.
3. The ids go back to their batches packed, and each text's ids are put together by position.

Decoding looks each id up in the token-byte table, which is as large as the vocabulary.

Null and empty texts have no ids. Every row of the input has a row in the output, repeated ones too.
"""

from __future__ import annotations

import base64
import itertools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import bucketed, map_columns, partitions, table, texts, tokenizer_file
from medgrain.llm.pretokens import cut, gather

BATCH_CHARS = 8 << 20
MOST_WORDS = 400_000
BATCH = "batch string, doc_ids array<bigint>, counts array<int>, codes binary, words binary"


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def batches_of_words(rows: Iterator[dict], pattern: str, batch_chars: int = BATCH_CHARS) -> Iterator[tuple]:
    """Rows of ``BATCH``: texts as positions in the list of their batch's distinct pre-tokens, commonest first."""
    import regex
    import zstandard

    find = regex.compile(pattern).findall
    state: list = []

    def reset() -> None:
        state[:] = [{}, {}, [], [], 0]  # pieces after a space, pieces as they are, ids, codes, characters

    def flush() -> tuple:
        led, whole, ids, codes, _ = state
        words: dict[str, int] = {}
        sizes = np.zeros(len(led) + len(whole), np.int32)
        starts, flat = np.zeros(len(sizes), np.int32), array("i")
        for known, before in ((led, " "), (whole, "")):
            for piece, code in known.items():
                found = find(before + piece)
                starts[code], sizes[code] = len(flat), len(found)
                flat.extend([words.setdefault(w, len(words)) for w in found])
        flat = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        counts = [int(sizes[c].sum()) for c in codes]
        used, uses, at = np.empty(sum(counts), np.uint32), np.zeros(len(words), np.int64), 0
        for low in range(0, len(codes), 256):
            part = gather(np.concatenate(codes[low:low + 256]), starts, sizes, flat)
            used[at:at + len(part)] = part
            uses += np.bincount(part, minlength=len(words))
            at += len(part)
        by_use = np.argsort(-uses, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_use] = np.arange(len(words))
        np.take(rank, used, out=used)
        names = list(words)
        listed = json.dumps([names[i] for i in by_use.tolist()], ensure_ascii=False).encode()
        return [uuid.uuid4().hex], [ids], [counts], [_pack(used)], [zstandard.compress(listed, 1)]

    def codes_of(pieces: list[str], known: dict[str, int]) -> list[int]:
        found = list(map(known.get, pieces))
        if None in found:
            for i, code in enumerate(found):
                if code is None:
                    found[i] = known.setdefault(pieces[i], len(state[0]) + len(state[1]))
        return found

    reset()
    for batch in rows:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            pieces = cut(text)
            if pieces is None:
                codes = codes_of(find(text), state[1])
            else:
                codes = codes_of(pieces[:1], state[1]) + codes_of(pieces[1:], state[0])
            state[2].append(doc_id)
            state[3].append(np.array(codes, np.int32))
            state[4] += len(text)
            if state[4] >= batch_chars:
                yield flush()
                reset()
    if state[2]:
        yield flush()


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode(docs: DataFrame, rank_file: str, pattern: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``; ids are packed as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_of(rank_file))
    n = partitions(spark)
    stored = bucketed(map_columns(texts(docs), lambda rows: batches_of_words(rows, pattern, batch_chars), BATCH),
                      "words", "batch", "zstd")

    def explode(rows: Iterator[dict]) -> Iterator[tuple]:
        import zstandard

        for batch in rows:
            for key, packed in zip(batch["batch"], batch["words"]):
                words = json.loads(zstandard.decompress(packed))
                part = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % n
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(n), "right").tolist()
                for k, (i, j) in enumerate(zip([0, *ends], ends)):
                    if i < j:
                        some = json.dumps([words[x] for x in order[i:j].tolist()], ensure_ascii=False).encode()
                        yield [k], [key], [_pack(np.diff(order[i:j], prepend=0))], [zstandard.compress(some, 3)]

    def encode_words(rows: Iterator[dict]) -> Iterator[tuple]:
        import tiktoken
        import zstandard

        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[str, list[int]] = {}
        for batch in rows:
            for key, steps, packed in zip(batch["batch"], batch["steps"], batch["words"]):
                words = json.loads(zstandard.decompress(packed))
                if len(known) > MOST_WORDS:
                    known.clear()
                for word in words:
                    if word not in known:
                        known[word] = encoding.encode_ordinary(word)
                ids = list(map(known.__getitem__, words))
                yield ([key], [steps], [_pack(np.fromiter(map(len, ids), np.int64, len(ids)))],
                       [_pack(np.fromiter(itertools.chain.from_iterable(ids), np.int64))])

    def reassemble(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for doc_ids, counts, codes, parts in zip(*[batch[c] for c in ("doc_ids", "counts", "codes", "parts")]):
                at, n, ids = ([_unpack(p[c]) for p in parts] for c in ("steps", "sizes", "ids"))
                at = [np.cumsum(x.astype(np.int64)) for x in at]
                none = np.zeros(0, "<u4")
                at, n = np.concatenate([none.astype(np.int64), *at]), np.concatenate([none, *n])
                values = np.concatenate([none, *ids])
                n = n.astype(np.int64)
                sizes, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                sizes[at], starts[at] = n, np.cumsum(n) - n
                used, stop = _unpack(codes), np.cumsum(counts).tolist()
                begin = 0
                for low in range(0, len(doc_ids), 256):
                    here = stop[low:low + 256]
                    part = [gather(used[i:j], starts, sizes, values).tobytes()
                            for i, j in zip([begin, *here], here)]
                    begin = here[-1]
                    yield doc_ids[low:low + 256], part

    words = map_columns(stored.select("batch", "words"), explode, "part int, batch string, steps binary, words binary")
    packed = map_columns(
        words.repartitionById(n, "part"), encode_words, "batch string, steps binary, sizes binary, ids binary")
    parts = packed.groupBy("batch").agg(F.collect_list(F.struct("steps", "sizes", "ids")).alias("parts"))
    joined = stored.join(parts, "batch", "left").select(
        "doc_ids", "counts", "codes", F.coalesce("parts", F.array()).alias("parts"))
    return map_columns(joined, reassemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` as ``decoded``."""
    ranks = ranks_of(rank_file)
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks are not gapless")
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        sizes = np.array([len(t) for t in shared.value], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(shared.value), np.uint8)
        for batch in rows:
            for low in range(0, len(batch["ids"]), 256):
                some = batch["ids"][low:low + 256]
                yield batch["doc_id"][low:low + 256], some, [
                    gather(np.frombuffer(i, "<u4"), starts, sizes, flat).tobytes() for i in some]

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded bytes, and the columns in ``more``."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    path = rank_file or tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))
