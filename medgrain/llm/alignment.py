"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair of ids is.

1. Both tokenizers see a space and the text. Neither has a token that goes on past a space, so where every space has a
   visible character after it, words are encoded and aligned once for each task (``Lexicon``); other texts are one piece.
2. Groups are found by pointer jumping over all tokens of many pieces together: every token points to its farthest-right
   overlapping token, and successors are doubled until each token knows the last one of its component, which labels the
   group. Two tokens that end at the same byte end their groups.
3. Each task writes batches: texts as positions in the batch's list of pieces, the pieces' groups, the distinct links of
   each piece, and for each pair of ids the number of the batch's documents that hold it linked.
4. The counts are added up by ranges of A ids. A range holds all pairs of its A ids, so it also knows each A id's
   highest count. Only packed lists move, one for each task or batch and range, whatever the number of uses of an id.
5. The counts go back to the batches, which add up each document's links. Links are never listed one by one: a group's
   tokens count as distinct ids with their numbers.

Null and empty texts, and texts that either tokenizer changes, have no tokens. Repeated rows are documents of their own.
What is held together: a batch of ``BATCH_CHARS`` characters or one text, and the distinct pairs of a range, which the
vocabularies bound.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import bucketed, map_columns, partitions, small_batches, stored, table, texts, tokenizer_file
from medgrain.llm.pretokens import KnownPieces, gather, may_cut, split_words, sums_by

BATCH_CHARS = 1 << 20
MOST_PIECES, MOST_CHARS = 250_000, 8 << 20
TOGETHER, LEARNT = 200, 2000
SHIFT = 17  # ids of either tokenizer are below 2 ** SHIFT
PAIRS_AT_ONCE = 1 << 21
MOST_RANGES = 512
BATCH = ("batch string, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
         "n_links array<bigint>, counts binary, codes binary, rendered binary, rendered_sizes binary, "
         "link_sizes binary, link_pairs binary, link_times binary, pairs binary, holders binary")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(np.asarray(values).astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label of the group of each A and each B token: its last B token. Both cover the same bytes.

    The farthest-right token that overlaps an A token is the B token over its last byte; the same holds the other way
    round, but a B token whose end an A token shares is the last of its group.
    """
    n = len(b_ends)
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    successor = np.concatenate([np.where(a_ends[over_b] > b_ends, n + over_b, np.arange(n)), over_a])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[n:], successor[:n]
        successor = further


def links_of(label_a: np.ndarray, a: np.ndarray, label_b: np.ndarray, b: np.ndarray,
             piece_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, pair of ids and number of links for each distinct pair of a piece; ``piece_of`` tells a label's piece."""
    mask = (1 << SHIFT) - 1
    ka, ca = np.unique(label_a << SHIFT | a, return_counts=True)
    kb, cb = np.unique(label_b << SHIFT | b, return_counts=True)
    start, stop = (np.searchsorted(kb >> SHIFT, ka >> SHIFT, side) for side in ("left", "right"))
    ends = np.cumsum(stop - start)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = 0
    while low < len(ka):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
        n = (stop - start)[low:high]
        left = np.repeat(np.arange(low, high), n)
        right = gather(np.arange(high - low), start[low:high], n, np.arange(len(kb)))
        key = piece_of[ka[left] >> SHIFT] << 2 * SHIFT | (ka[left] & mask) << SHIFT | kb[right] & mask
        keys, inverse = np.unique(np.concatenate([keys, key]), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([times, ca[left] * cb[right]])).astype(np.int64)
        low = high
    return keys >> 2 * SHIFT, keys & ((1 << 2 * SHIFT) - 1), times


class Lexicon:
    """Pieces encoded by both tokenizers and aligned; words are known again until the lexicon is full."""

    def __init__(self, json: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(json), SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        of_char = byte_of_char()
        a_bytes = [bytes(of_char[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                   else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes = [a_bytes, b_bytes]
        self.sizes = [np.array([len(t) for t in side]) for side in self.bytes]
        self.opens = [np.array([t.startswith(b" ") for t in side]) for side in self.bytes]
        # Rendered tokens with what comes after them: A in a group, last A, B in a group, last B.
        n_a, n_b = len(a_bytes), len(b_bytes)
        self.shown = [b"%d%c" % (i, c) for n, c in ((n_a, 44), (n_a, 124), (n_b, 44), (n_b, 59)) for i in range(n)]
        self.shown_size = np.array([len(x) for x in self.shown], np.int32)
        self.offset = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])
        self.clear()

    def clear(self) -> None:
        self.known, self.chars = KnownPieces(), 0
        self.good = [np.zeros(0, bool)]
        self.rendered, self.rendered_sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        self.counts = [np.zeros((0, 4), np.int64)]  # A tokens, B tokens, groups, links
        self.link_sizes, self.link_pairs, self.link_times = ([np.zeros(0, np.int64)] for _ in range(3))

    def _ids(self, side: int, pieces: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all pieces, of ``whole`` bytes each, and how many each has; nothing where they do not add up to that.

        Words are joined; a token that opens with a space begins a word.
        """
        lines = [" ".join(pieces[i:i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        if side:
            lists = self.b.encode(lines, num_threads=1)
        else:
            lists = [e.ids for e in self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64)
        first = np.flatnonzero(self.opens[side][ids]) if len(pieces) > 1 else np.zeros(min(1, len(ids)), np.int64)
        if len(first) != len(pieces):
            return None
        sizes = np.diff(np.append(first, len(ids)))
        right = np.array_equal(sums_by(self.sizes[side][ids], sizes), whole) and b"".join(
            map(self.bytes[side].__getitem__, ids.tolist())) == " ".join(["", *pieces]).encode()
        return (ids, sizes) if right else None

    def learn(self, pieces: list[str]) -> None:
        for low in range(0, len(pieces), LEARNT):
            self._learn(pieces[low:low + LEARNT])

    def _learn(self, pieces: list[str]) -> None:
        whole = np.array([len(p.encode()) + 1 for p in pieces])
        both = [self._ids(side, pieces, whole) for side in (0, 1)]
        good = np.ones(len(pieces), bool)
        if None in both:
            if len(pieces) > 1:  # halves, down to the piece that a tokenizer changes
                for half in (pieces[:len(pieces) // 2], pieces[len(pieces) // 2:]):
                    self._learn(half)
                return
            both, good = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2, np.zeros(1, bool)
        self.chars += int(whole.sum())
        ids, sizes = zip(*both)
        pieces_of = [np.repeat(np.arange(len(pieces)), n) for n in sizes]
        labels = groups_of(*(np.cumsum(self.sizes[s][ids[s]]) for s in (0, 1)))
        piece, pair, times = links_of(labels[0], ids[0], labels[1], ids[1], pieces_of[1])
        # In the order of groups, A before B.
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        key = 2 * np.concatenate(labels) + side
        order = np.argsort(key, kind="stable")
        last = np.append(np.diff(key[order]) != 0, True)
        shown = np.concatenate(ids)[order] + self.offset[2 * side[order] + last]
        self.rendered.append(np.frombuffer(b"".join(map(self.shown.__getitem__, shown.tolist())), np.uint8))
        self.rendered_sizes.append(sums_by(self.shown_size[shown], sizes[0] + sizes[1]))
        n = len(pieces)
        groups = np.bincount(pieces_of[1][np.unique(labels[1])], minlength=n) if len(ids[1]) else np.zeros(n, np.int64)
        self.counts.append(np.stack([*sizes, groups, np.bincount(piece, times, n).astype(np.int64)], 1))
        self.good.append(good)
        self.link_sizes.append(np.bincount(piece, minlength=n))
        self.link_pairs.append(pair)
        self.link_times.append(times)

    def codes(self, some: list[str]) -> list[np.ndarray]:
        """Numbers of the pieces of each text."""
        odd = [not may_cut(" " + text) for text in some]
        words, indices, offsets = split_words([text for text, o in zip(some, odd) if text and not o])
        numbers, new = self.known.numbers(words)
        self.learn([words[i] for i in new.tolist()])
        numbers = numbers[indices]
        out, at = [], 0
        for text, o in zip(some, odd):
            if not text:
                out.append(numbers[:0])
            elif o:
                self._learn([text])
                out.append(self.known.added(1))
            else:
                out.append(numbers[offsets[at]:offsets[at + 1]])
                at += 1
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        held = (self.counts, self.link_sizes, self.link_pairs, self.link_times, self.good, self.rendered, self.rendered_sizes)
        for x in held:
            x[:] = [np.concatenate(x)]
        return tuple(x[0] for x in held)


def holders_of(codes: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray,
               n: int) -> np.ndarray:
    """For each of ``n`` pairs, the number of texts that hold it, from the pairs of the texts' pieces."""
    out = np.zeros(n, np.int64)
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        begin = int(ends[low] - counts[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + PAIRS_AT_ONCE // 16, "right")))
        some = codes[begin:ends[high - 1]]
        text = np.repeat(np.arange(high - low), counts[low:high])
        held = np.unique(text * len(sizes) + some)
        text, some = held // len(sizes), held % len(sizes)
        both = np.unique(np.repeat(text, sizes[some]) * n + gather(some, starts, sizes, pairs))
        out += np.bincount(both % n, minlength=n)
        low = high
    return out


def batches_of_pieces(rows: Iterator[dict], json: str, model: bytes, batch_chars: int) -> Iterator[tuple]:
    """Rows of ``BATCH``."""
    import zstandard

    lexicon = Lexicon(json, model)
    ids: list = []
    held: list[str] = []
    chars = 0

    def flush() -> tuple:
        codes = lexicon.codes(held)
        counts, link_sizes, link_pairs, link_times, good, rendered, rendered_sizes = lexicon.arrays()
        kept = [c if good[c].all() else c[:0] for c in codes]
        lengths = np.array([len(c) for c in kept], np.int64)
        used, local = np.unique(np.concatenate([np.zeros(0, np.int64), *kept]), return_inverse=True)
        starts = (np.cumsum(link_sizes) - link_sizes)
        sizes = link_sizes[used]
        pairs, place = np.unique(gather(used, starts, link_sizes, link_pairs), return_inverse=True)
        times = gather(used, starts, link_sizes, link_times)
        sums = [sums_by(counts[used, k][local], lengths).tolist() for k in range(4)]
        holders = holders_of(local, lengths, np.cumsum(sizes) - sizes, sizes, place, max(1, len(pairs)))[:len(pairs)]
        shown = gather(used, np.cumsum(rendered_sizes) - rendered_sizes, rendered_sizes, rendered).tobytes()
        out = ([uuid.uuid4().hex], [list(ids)], *([s] for s in sums), [pack(lengths)], [pack(local)],
               [zstandard.compress(shown, 1)], [pack(rendered_sizes[used])],
               [pack(sizes)], [pack(place)], [pack(times)], [pack(pairs)], [pack(holders)])
        ids.clear()
        held.clear()
        if lexicon.known.count > MOST_PIECES or lexicon.chars > MOST_CHARS:
            lexicon.clear()
        return out

    for batch in rows:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids.append(doc_id)
            held.append(text)
            chars += len(text) + 64
            if chars >= batch_chars:
                yield flush()
                chars = 0
    if ids:
        yield flush()


def align(docs: DataFrame, json_file: str, model_file: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """The stored batches of ``docs``, see ``BATCH``."""
    with open(json_file) as f, open(model_file, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    with small_batches(docs.sparkSession):
        return bucketed(map_columns(texts(docs), lambda rows: batches_of_pieces(rows, *shared.value, batch_chars), BATCH),
                        "aligned", "batch", "zstd")


def _range_of(pairs: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each pair, by a mix of its A id."""
    return (((pairs >> SHIFT) * 0x9E3779B1) % (1 << 32) >> 7) % ranges


def _split(pairs: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """The filled ranges and the places of their pairs, in order."""
    where = _range_of(pairs, ranges)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(ranges + 1))
    yield from ((k, order[i:j]) for k, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i)


def _added(pairs: list[np.ndarray], holders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([np.zeros(0), *holders]), len(keys)).astype(np.int64)


def pair_counts(batches: DataFrame, ranges: int) -> DataFrame:
    """``part, pairs, holders, best``: for each range all its pairs, how many documents hold each, and whether that is
    the highest count of the pair's A id."""

    def add(rows: Iterator[dict]) -> Iterator[tuple]:
        held: tuple[list, list] = ([], [])
        size = 0
        for b in rows:
            for pairs, holders in zip(b["pairs"], b["holders"]):
                for x, data in zip(held, (pairs, holders)):
                    x.append(unpack(data))
                size += len(held[0][-1])
            if size > 2 * PAIRS_AT_ONCE:
                yield from send(*_added(*held))
                held, size = ([], []), 0
        yield from send(*_added(*held))

    def send(pairs: np.ndarray, holders: np.ndarray) -> Iterator[tuple]:
        for k, at in _split(pairs, ranges):
            yield [k], [pack(pairs[at])], [pack(holders[at])]

    def close(rows: Iterator[dict]) -> Iterator[tuple]:
        now, held, size = None, ([], []), 0

        def flush() -> tuple:
            pairs, holders = _added(*held)
            first = np.flatnonzero(np.append(True, np.diff(pairs >> SHIFT) != 0))
            top = np.maximum.reduceat(holders, first)
            best = holders == np.repeat(top, np.diff(np.append(first, len(pairs))))
            return [now], [pack(pairs)], [pack(holders)], [pack(best)]

        for b in rows:
            for part, pairs, holders in zip(b["part"], b["pairs"], b["holders"]):
                if part != now:
                    if now is not None:
                        yield flush()
                    now, held, size = part, ([], []), 0
                held[0].append(unpack(pairs))
                held[1].append(unpack(holders))
                size += len(held[0][-1])
                if size > 4 * PAIRS_AT_ONCE:
                    held = tuple([x] for x in _added(*held))
                    size = 0
        if now is not None:
            yield flush()

    sent = map_columns(batches.select("pairs", "holders"), add, "part int, pairs binary, holders binary")
    return stored(map_columns(sent.repartition(ranges, "part").sortWithinPartitions("part"), close,
                              "part int, pairs binary, holders binary, best binary"), "pair-counts")


def alignments(docs: DataFrame, json_file: str, model_file: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``; ``groups`` lists the
    ids of every group as ``a1,a2|b1;...``."""
    spark = docs.sparkSession
    ranges = min(partitions(spark), MOST_RANGES)
    batches = align(docs, json_file, model_file, batch_chars)
    counts = pair_counts(batches, ranges)

    def ask(rows: Iterator[dict]) -> Iterator[tuple]:
        for b in rows:
            for batch, data in zip(b["batch"], b["pairs"]):
                pairs = unpack(data)
                for k, at in _split(pairs, ranges):
                    yield [k], [1], [batch], [pack(pairs[at])], [b""], [b""]

    def answer(rows: Iterator[dict]) -> Iterator[tuple]:
        known: tuple[np.ndarray, ...] = ()
        for b in rows:
            for part, kind, batch, pairs, holders, best in zip(
                    *[b[c] for c in ("part", "kind", "batch", "pairs", "holders", "best")]):
                if kind == 0:
                    known = (unpack(pairs), unpack(holders), unpack(best))
                    continue
                at = np.searchsorted(known[0], unpack(pairs))
                yield [batch], [part], [pack(known[1][at])], [pack(known[2][at])]

    def finish(rows: Iterator[dict]) -> Iterator[tuple]:
        import zstandard

        for b in rows:
            for row in zip(*[b[c] for c in names]):
                r = dict(zip(names, row))
                pairs = unpack(r["pairs"])
                holders, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                answers = {f["part"]: f for f in r["found"]}
                for k, at in _split(pairs, ranges):
                    holders[at], best[at] = unpack(answers[k]["holders"]), unpack(answers[k]["best"])
                sizes, place, times = unpack(r["link_sizes"]), unpack(r["link_pairs"]), unpack(r["link_times"])
                lengths, codes = unpack(r["counts"]), unpack(r["codes"])
                n_best = sums_by(sums_by(best[place] * times, sizes)[codes], lengths).tolist()
                count_sum = sums_by(sums_by(holders[place] * times, sizes)[codes], lengths).tolist()
                ends = np.cumsum(unpack(r["rendered_sizes"])).tolist()
                blob = zstandard.decompress(r["rendered"])
                rendered = [blob[i:j] for i, j in zip([0, *ends], ends)]
                stops = np.cumsum(lengths).tolist()
                begin, out, held = 0, [], 0
                for i, stop in enumerate(stops):
                    groups = b"".join(map(rendered.__getitem__, codes[begin:stop].tolist()))[:-1].decode()
                    begin = stop
                    out.append((r["doc_ids"][i], r["n_a"][i], r["n_b"][i], r["n_groups"][i], r["n_links"][i], n_best[i],
                                count_sum[i], groups))
                    held += len(groups)
                    if held > 4 << 20:
                        yield tuple(zip(*out))
                        out, held = [], 0
                if out:
                    yield tuple(zip(*out))

    asked = map_columns(batches.select("batch", "pairs"), ask,
                        "part int, kind int, batch string, pairs binary, holders binary, best binary")
    known = counts.select("part", F.lit(0).alias("kind"), F.lit("").alias("batch"), "pairs", "holders", "best")
    both = known.unionByName(asked).repartition(ranges, "part").sortWithinPartitions("part", "kind")
    answers = map_columns(both, answer, "batch string, part int, holders binary, best binary")
    found = stored(answers.groupBy("batch").agg(F.collect_list(F.struct("part", "holders", "best")).alias("found")), "answers")
    joined = batches.drop("holders").join(found, "batch", "left").withColumn("found", F.coalesce("found", F.array()))
    names = joined.columns
    return map_columns(joined, finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                       "count_sum long, groups string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignments(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                       tokenizer_file("piece_bpe_32k.model"))
    return found.select(*found.columns[:-1], F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias(
        "groups_sha256"))
