"""Token ids in Parquet list columns, written in order of the document id for selective reads.

Texts are dealt by ranges of ``doc_id`` and sorted, encoded inside the tasks, and written by Spark's Parquet writer: the
id list is dictionary-coded (bit-packed indexes into at most the vocabulary's ids), ids and lengths are delta-coded,
row groups and pages have a set size, and the page index lets a filter on ``doc_id`` skip pages. Reading lengths or
offsets touches no token page.

The library encodes each distinct piece of a worker's tasks once (see ``pretokens``); texts it may not cut are encoded
whole, as are texts that hold the string of an added token, which becomes that token's id as in the library alone. The
table of known pieces is bounded by ``max_pieces`` and starts anew when it is full, which changes no result.

Null and empty texts hold the end id alone; rows with the same id stay in order of their text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medgrain.llm.common import folder, kept_by_worker, map_columns, small_batches, table, texts, tokenizer_file
from medgrain.llm.pretokens import KnownPieces, Numbered, may_cut, numbered_words, runs, sums_by

#: Parquet layout: delta-coded metadata, dictionary-coded tokens, small pages with an index.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
COLUMNS = "shard int, doc_id long, local_start long, n_tokens long, token_ids array<int>"


class Grown:
    """An array that grows at its end in place: its room doubles, so that adding copies little."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.size

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[:self.size] = self.room[:self.size]
            self.room = room
        self.room[self.size:end] = values
        self.size = end

    @contextmanager
    def extended(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """The array with ``values`` behind it; they are let go of at the end."""
        before = self.size
        self.add(values)
        try:
            yield self.room[:self.size]
        finally:
            self.size = before


class PieceEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each known piece once.

    Pieces are words with the space before them; some 60 bytes are held of each, and some
    150 of each one met of late.
    """

    def __init__(self, json: str, max_pieces: int):
        from tokenizers import Tokenizer

        # Spark has a worker for each core; threads of the library's own would each hold memory back.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(json)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.max_pieces, self.recent = max_pieces, Numbered()
        self._clear()

    def _clear(self) -> None:
        self.known, self.recent_codes = KnownPieces(), Grown(np.int64)
        self.sizes, self.starts, self.ids = Grown(np.int32), Grown(np.int64), Grown(np.int32)

    def plain(self, pieces: list[str], at_once: int = 256) -> list[list[int]]:
        """Ids of each piece. An encoding of the library holds far more than its ids, so few are held at a time."""
        return [e.ids for i in range(0, len(pieces), at_once)
                for e in self.tokenizer.encode_batch_fast(pieces[i:i + at_once], add_special_tokens=False)]

    def _encoded(self, pieces: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each with the space before it, and how many each has; a token that opens with a space
        starts a piece."""
        lists = self.plain([" " + " ".join(pieces[i:i + together]) for i in range(0, len(pieces), together)])
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(pieces):
            return ids, np.diff(np.append(first, len(ids))).astype(np.int32)
        lists = self.plain([" " + p for p in pieces])
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int32)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces among those known; unseen ones are encoded."""
        codes, new = self.known.numbers(pieces)
        if len(new):
            ids, sizes = self._encoded([pieces[i] for i in new.tolist()])
            self.starts.add(len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes)
            self.sizes.add(sizes)
            self.ids.add(ids)
        return codes

    def _split(self, texts: list[str], most_recent: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """The number among the known pieces of each piece of the texts, and the texts' bounds. Pieces met of late are
        found by themselves, without their hash."""
        if len(self.recent) > most_recent:
            self.recent, self.recent_codes = Numbered(), Grown(np.int64)
        places, offsets = numbered_words(texts, self.recent)
        if len(self.sizes) + len(self.recent) - len(self.recent_codes) > self.max_pieces:
            self._clear()
        self.recent_codes.add(self._codes(list(itertools.islice(self.recent, len(self.recent_codes), None))))
        return self.recent_codes.room[places], offsets

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        whole = [bool(self.added and self.added.search(t)) or not may_cut(t) for t in batch]
        kept, offsets = self._split([t for t, w in zip(batch, whole) if not w])
        # The first piece of a text has no space before it; a text that may not be cut is its own first piece.
        heads = [t if w else t.split(" ", 1)[0] for t, w in zip(batch, whole)]
        number = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        lists = self.plain(list(number))
        counts = np.ones(len(batch), np.int64)
        counts[~np.array(whole)] = np.diff(offsets)
        opens = np.cumsum(counts) - counts
        codes = np.empty(int(counts.sum()), np.int64)
        rest = np.ones(len(codes), bool)
        rest[opens] = False
        inner = np.ones(len(kept), bool)
        inner[offsets[:-1] - offsets[0]] = False
        codes[rest] = kept[inner]
        # The heads' pieces stand behind the known ones only for as long as this batch.
        codes[opens] = [len(self.sizes) + number[h] for h in heads]
        sizes = np.array([len(x) for x in lists], np.int32)
        with self.starts.extended(len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes) as starts, \
                self.sizes.extended(sizes) as every, \
                self.ids.extended(np.fromiter(itertools.chain.from_iterable(lists), np.int32)) as values:
            n = every[codes]
            return sums_by(n, counts), runs(starts[codes], n, values)


def slices(rows: list[str], limit: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters."""
    begin = held = 0
    for i, text in enumerate(rows):
        held += len(text)
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(rows):
        yield slice(begin, len(rows))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, max_pieces: int = 3_000_000) -> None:
    """Write ``shard, doc_id, local_start, n_tokens, token_ids`` for each row of ``docs`` in ascending ``doc_id``."""
    with open(vocabulary) as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[dict]) -> Iterator[tuple]:
        name = "pieces_" + hashlib.sha256(f"{max_pieces} {json.value}".encode()).hexdigest()
        encoder, position = kept_by_worker(name, lambda: PieceEncoder(json.value, max_pieces)), 0
        for batch in batches:
            for part in slices(batch["text"]):
                lengths, ids = encoder.encode(batch["text"][part])
                whole = lengths + 1
                ends = np.cumsum(whole)
                values = np.full(int(ends[-1]), end_id, np.int32)
                keep = np.ones(len(values), bool)
                keep[ends - 1] = False
                values[keep] = ids
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values))
                yield batch["shard"][part], batch["doc_id"][part], position + ends - whole, whole, lists
                position += int(ends[-1])

    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    encoded = map_columns(ordered.select("doc_id", "text", F.spark_partition_id().alias("shard")), encode, COLUMNS)
    with small_batches(docs.sparkSession):
        encoded.write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the metadata columns alone."""
    rows = spark.read.schema(COLUMNS).parquet(path).select("shard", "doc_id", "local_start", "n_tokens")
    return rows.join(_bases(spark, path), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Tokens of the documents with ids from ``low`` to ``high``; the filter reaches row groups and pages."""
    rows = spark.read.schema(COLUMNS).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before each shard: one row for each file, so the window over all of them stays small."""
    sums = spark.read.schema(COLUMNS).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of each row's ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c != "token_ids"]
    schema = T.StructType([*[tokens.schema[c] for c in kept], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("token_ids"))
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(values[i:j]) for i, j in zip(at, at[1:])]
            arrays = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    return tokens.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary or tokenizer_file("byte_bpe_50k.json"))
    found = checksums(read_tokens(spark, path))
    return found.join(F.broadcast(_bases(spark, path)), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
