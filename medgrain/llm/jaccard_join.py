"""N-gram Jaccard join: links between documents by the word shingles they share, with size-aware heavy-light search.

Sets are reduced to classes of equal sets. A link of two sets means an overlap of at least ``needed(a, b)``.

*Small sets* (at most ``x`` shingles) are joined by fixed-size subsets: for every size a partner may have, a set lists its
subsets of exactly the needed overlap. Two small sets are linked if and only if they list the same subset, so these links
need no further check. ``x`` minimises the estimated cost over the histogram of set sizes.

*Large sets* are joined by inverted lists. Order shingles by hash; linked sets share at least ``l`` of their first
``slack + l`` shingles, with ``l`` an eighth of the size. These heads travel as packed arrays, one per block of documents
and hash range, to be counted: a very common shingle costs one entry per block. A set none of whose partners can exist
(too few shared shingles in its head) leaves. Of the others' heads the ``l - 1`` most frequent shingles are dropped, which
still leaves every linked pair a common one, and drops the shingles of wide-spread passages.

Candidates on the lists are checked on the whole sets. What is asked for is reachability, so a list whose sets are already
connected needs no further check: first each set is held against the one it shares most lists with, then the open lists
are worked off: short ones by the pairs that are still apart. The sets on long ones get new lists by the ``slack + 1``
rarest shingles of the whole sets; what stays open there, sets that consist of common shingles for three quarters, is
held together block by block: its sets outside the largest component against all of it. No list is cut short.

Null and empty texts, and texts without words, have no shingles and are linked with nothing; with fewer words than a
shingle has, the whole sequence is one. Rows with equal ids are rows of their own. A null id takes no part in the
smallest id; a component of null ids only has a null one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import Cuts, map_columns, partitions, release, small_batches, stored, table, texts

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS, NUM, DEN = 5, 75, 100
SMALL_MOST = 16
BLOCK_SHINGLES = 1 << 20
SHORT_LIST = 64
HUB_TURNS = 2
CELL_SETS, CELL_SHINGLES = 512, 1 << 17
BLOCK = "block string, doc_ids array<bigint>, sizes array<int>, d1 array<bigint>, d2 array<bigint>, sets binary"


def needed(a: int, b: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-NUM * (a + b) // (NUM + DEN))


def slack(n: int) -> int:
    """Most shingles a set may lack in a partner."""
    return n - -(-NUM * n // DEN)


def shared_least(n: int) -> int:
    """Least number of common head shingles over all partners of a set of this size."""
    return max(1, -(-NUM * n // DEN) // 8)


def head_size(n: int) -> int:
    return min(n, slack(n) + max(1, n // 8))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; words are hashed once while the table has room."""

    def __init__(self, most_words: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.most_words = most_words

    def hashes(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode().translate(LOWER).split()  # ASCII white space: the space and 9 to 13
        if not words:
            return np.zeros(0, np.uint64)
        codes = list(map(self.known.get, words))
        if None in codes:
            if len(self.known) > self.most_words:
                self.known.clear()
            for i, code in enumerate(codes):
                if code is None:
                    codes[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        codes = np.array(codes, np.uint64)
        width = min(WORDS, len(codes))
        out = np.full(len(codes) - width + 1, width, np.uint64)
        for j in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + len(out)])
        return np.unique(out)


def _blocks(rows: Iterator[dict]) -> Iterator[tuple]:
    shingler, held = Shingler(), []

    def flush() -> tuple:
        ids, sets = zip(*held)
        held.clear()
        marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return ([uuid.uuid4().hex], [list(ids)], [[len(s) for s in sets]],
                *[[[int.from_bytes(m[i:i + 8], "little", signed=True) for m in marks]] for i in (0, 8)],
                [np.concatenate(sets).tobytes()])

    count = 0
    for batch in rows:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            held.append((doc_id, shingler.hashes(text)))
            count += len(held[-1][1]) + 16
            if count >= BLOCK_SHINGLES:
                yield flush()
                count = 0
    if held:
        yield flush()


def _heads(sizes: list[int], sets: bytes, indexes: list[int]) -> list[np.ndarray]:
    values, ends = np.frombuffer(sets, np.uint64), np.cumsum(sizes)
    return [values[ends[i] - sizes[i]:][:head_size(sizes[i])] for i in indexes]


def _dealt(heads: list[np.ndarray], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``heads`` in order of hash range, their counts, the range bounds, and the sorting order."""
    distinct, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *heads]), return_counts=True)
    where = (_mix(distinct ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(ranges + 1))
    return distinct, counts, bounds, order


def _counted(joined: DataFrame, ranges: int) -> DataFrame:
    """``block, part, counts``: for each block and hash range, how many classes hold each of its head shingles."""
    def send(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for block, sizes, sets, reps in zip(*[batch[c] for c in ("block", "sizes", "sets", "reps")]):
                distinct, counts, bounds, order = _dealt(_heads(sizes, sets, [r["idx"] for r in reps]), ranges)
                filled = [k for k in range(ranges) if bounds[k] < bounds[k + 1]]
                cut = [order[bounds[k]:bounds[k + 1]] for k in filled]
                for at in range(0, len(filled), 64):
                    yield (filled[at:at + 64], [block] * len(filled[at:at + 64]),
                           [distinct[c].tobytes() for c in cut[at:at + 64]],
                           [zstandard.compress(counts[c].astype("<u4").tobytes(), 1) for c in cut[at:at + 64]])

    def add(rows: Iterator[dict]) -> Iterator[tuple]:
        held: list = []

        def flush() -> Iterator[tuple]:
            tokens = np.concatenate([np.frombuffer(t, np.uint64) for _, _, t, _ in held])
            counts = np.concatenate([np.frombuffer(zstandard.decompress(c), "<u4") for *_, c in held])
            _, inverse = np.unique(tokens, return_inverse=True)
            sums = np.bincount(inverse, weights=counts).astype("<u4")[inverse]
            at = 0
            for part, block, t, _ in held:
                n = len(t) // 8
                yield [block], [part], [zstandard.compress(sums[at:at + n].tobytes(), 1)]
                at += n
            held.clear()

        for batch in rows:
            for row in zip(*[batch[c] for c in ("part", "block", "tokens", "counts")]):
                if held and held[-1][0] != row[0]:
                    yield from flush()
                held.append(row)
        if held:
            yield from flush()

    sent = map_columns(joined, send, "part int, block string, tokens binary, counts binary")
    return map_columns(sent.repartition(ranges, "part").sortWithinPartitions("part"), add,
                       "block string, part int, counts binary")


def _open_heads(joined: DataFrame, ranges: int) -> DataFrame:
    """``cid, n, tokens, whole``: the classes that may have a partner, their list shingles and their whole sets."""
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for sizes, sets, reps, found in zip(*[batch[c] for c in ("sizes", "sets", "reps", "found")]):
                indexes = [r["idx"] for r in reps]
                heads = _heads(sizes, sets, indexes)
                distinct, _, bounds, order = _dealt(heads, ranges)
                sums = np.zeros(len(distinct), np.int64)
                for f in found:
                    k = f["part"]
                    sums[order[bounds[k]:bounds[k + 1]]] = np.frombuffer(zstandard.decompress(f["counts"]), "<u4")
                ends = np.cumsum(sizes)
                out: tuple[list, ...] = ([], [], [], [])
                held = 0
                for rep, i, head in zip(reps, indexes, heads):
                    frequency = sums[np.searchsorted(distinct, head)]
                    shared = np.flatnonzero(frequency > 1)
                    least = shared_least(sizes[i])
                    if len(shared) < least:
                        continue
                    by = shared[np.argsort(frequency[shared], kind="stable")]
                    out[0].append(rep["cid"])
                    out[1].append(sizes[i])
                    out[2].append(head[by[:len(by) - least + 1]].view(np.int64).tolist())
                    out[3].append(sets[8 * int(ends[i] - sizes[i]):8 * int(ends[i])])
                    held += sizes[i]
                    if held >= BLOCK_SHINGLES // 8:
                        yield out
                        out, held = ([], [], [], []), 0
                if out[0]:
                    yield out

    return map_columns(joined, run, "cid long, n int, tokens array<bigint>, whole binary")


def boundary(histogram: dict[int, int], list_cost: float = 8.0, most: int = SMALL_MOST) -> int:
    """The size up to which listing subsets costs less than list entries at ``list_cost`` subsets each."""

    def cost(x: int) -> float:
        subsets = sum(c * sum(1 for _ in _subset_sizes(n, x)) + c * sum(
            math.comb(n, t) for _, t in _subset_sizes(n, x)) for n, c in histogram.items() if n <= x)
        return subsets + list_cost * sum(c * head_size(n) for n, c in histogram.items() if n > slack_free(x))

    return min(range(most + 1), key=cost)


def slack_free(x: int) -> int:
    """Largest size all of whose partners have at most ``x`` shingles."""
    return NUM * (x + 1) // DEN - (NUM * (x + 1) % DEN == 0)


def _subset_sizes(n: int, x: int) -> Iterator[tuple[int, int]]:
    """Partner sizes up to ``x`` and the overlap they need; equal sizes that need equal sets are one class already."""
    for other in range(-(-NUM * n // DEN), min(x, DEN * n // NUM) + 1):
        size = needed(n, other)
        if size <= min(n, other) and not (other == n == size):
            yield other, size


def _small_links(small: DataFrame, x: int, cuts: Cuts) -> DataFrame:
    """Edges between classes of at most ``x`` shingles: those that list an equal subset for the same two sizes."""

    def enumerate_subsets(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for cid, whole in zip(batch["cid"], batch["whole"]):
                tokens, n = [whole[i:i + 8] for i in range(0, len(whole), 8)], len(whole) // 8
                for other, size in _subset_sizes(n, x):
                    mark = b"%d.%d." % (min(n, other), max(n, other))
                    keys = [hashlib.blake2b(mark + b"".join(s), digest_size=16).digest()
                            for s in itertools.combinations(tokens, size)]
                    yield keys, [cid] * len(keys), [n] * len(keys), [n == other] * len(keys)

    listed = cuts.keep(map_columns(small, enumerate_subsets, "key binary, cid long, n int, equal boolean"), "subsets")
    # Marked with two sizes, sets of one size alone are not linked; with a set of the other size, all are connected.
    groups = cuts.keep(listed.groupBy("key").agg(
        F.min("cid").alias("hub"), F.count("*").alias("m"), (F.first("equal") | (F.min("n") < F.max("n"))).alias("meet")
    ).where("m > 1 and meet").select("key", "hub"), "subset-groups")
    return listed.join(groups, "key").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()


def _wholes(joined: DataFrame) -> DataFrame:
    """``cid, whole`` of the listed classes of each block."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for sizes, sets, reps in zip(*[batch[c] for c in ("sizes", "sets", "reps")]):
                ends = np.cumsum(sizes)
                yield ([r["cid"] for r in reps],
                       [sets[8 * int(ends[r["idx"]] - sizes[r["idx"]]):8 * int(ends[r["idx"]])] for r in reps])

    return map_columns(joined, run, "cid long, whole binary")


def checked_pairs(pairs: DataFrame, wholes: DataFrame) -> DataFrame:
    """``a, b, common, total`` for each pair: overlap and sum of the sizes of the whole sets."""
    one = wholes.select(F.col("cid").alias("a"), F.col("whole").alias("set_a"))
    two = wholes.select(F.col("cid").alias("b"), F.col("whole").alias("set_b"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(batch["set_a"], batch["set_b"])]
            yield (batch["a"], batch["b"], [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets],
                   [len(x) + len(y) for x, y in sets])

    return map_columns(pairs.join(one, "a").join(two, "b"), run, "a long, b long, common long, total long")


LINKED = f"{NUM + DEN} * common >= {NUM} * total"


def feasible(a: str, b: str) -> str:
    """SQL condition that sets of these sizes can be linked."""
    return f"{DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b})"


def components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """``cid, comp``: the smallest id reachable over ``edges`` (a, b), for each id on an edge.

    Rounds of linking every neighbour of a node to the node's smallest neighbour, by joins and mergeable aggregates, until
    every edge leads to its component's smallest id.
    """
    now = cuts.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
                    "linked")
    state = None
    while True:
        cuts.drop("linked-least", "linked-large", "linked-small")
        cuts.drop("linked", but_last=True)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cuts.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "linked-least")
        # Larger neighbours go to the smallest one; then smaller neighbours do.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cuts.keep(large.where("a <> b").distinct(), "linked-large")
        small = cuts.keep(large.groupBy("a").agg(F.min("b").alias("m")), "linked-small")
        now = cuts.keep(large.join(small, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.*").where("a <> b").distinct(), "linked")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if found == state:
            return cuts.keep(now.select(F.col("a").alias("cid"), F.col("b").alias("comp")), "components")
        state = found


def _labelled(lists: DataFrame, comps: DataFrame) -> DataFrame:
    return lists.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _open_lists(lists: DataFrame, comps: DataFrame, cuts: Cuts) -> DataFrame:
    """The lists that hold more than one component, with their length ``m``."""
    rows = cuts.keep(_labelled(lists, comps), "labelled")
    marks = [F.sum(F.xxhash64("cid", F.lit(i)).cast("decimal(20,0)")).alias(f"mark{i}") for i in (1, 2)]
    state = rows.groupBy("token").agg(
        F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), *marks).where("low < high")
    # The shingles of one passage are on the same sets; one of such lists speaks for all.
    state = cuts.keep(state.groupBy("m", "mark1", "mark2").agg(F.min("token").alias("token")).select("token", "m"),
                      "open-tokens")
    found = cuts.keep(rows.join(state, "token"), "open-lists")
    cuts.drop("labelled", "open-tokens")
    return found


def _rare_lists(sets: DataFrame, cuts: Cuts) -> DataFrame:
    """``token, cid, n``: the shared ones of the ``slack + 1`` shingles of each set that the fewest of ``sets`` hold.

    Linked sets lack at most ``slack`` shingles of each other, so these hold a common one.
    """

    def unpack(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            for cid, whole in zip(batch["cid"], batch["whole"]):
                tokens = np.frombuffer(whole, np.int64)
                for at in range(0, len(tokens), BLOCK_SHINGLES // 8):
                    yield [cid], [len(tokens)], [tokens[at:at + BLOCK_SHINGLES // 8].tolist()]

    rows = map_columns(sets, unpack, "cid long, n int, tokens array<bigint>").select(
        "cid", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = rows.join(counts, "token").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
    least = F.ceil(F.col("n") * F.lit(NUM) / F.lit(DEN)).cast("int")  # n - slack
    room = F.greatest(F.size("s") - least + 1, F.lit(0))  # the unshared ones come first
    return shared.select("cid", "n", F.explode(F.slice("s", F.lit(1), room)).alias("e")).select("e.token", "cid", "n")


def _hub_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """For each set the hub of another component with which it shares most open lists; ``turn`` picks the hubs."""
    hubs = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "n", "comp")).alias("h"))
    votes = lists.join(hubs, "token").where("comp <> h.comp and " + feasible("n", "h.n")).groupBy(
        "cid", F.col("h.cid").alias("hub")).count()
    return votes.groupBy("cid").agg(F.max(F.struct("count", "hub")).alias("v")).select(
        F.least("cid", "v.hub").alias("a"), F.greatest("cid", "v.hub").alias("b")).distinct()


def _merged_lists(lists: DataFrame) -> DataFrame:
    """The lists, those with the same hub as one wherever that forms no more pairs: a group of near copies is on many lists.

    Every two sets that shared a list still do. A clash of the new names could only join two lists more.
    """
    hubs = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("cid", F.lit(HUB_TURNS)).alias("h"), "cid")).alias("hub"),
                                      F.count("*").alias("m")).select("token", F.col("hub.cid").alias("hub"), "m")
    apart = hubs.groupBy("hub").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    named = lists.join(hubs, "token")
    merge = named.select("hub", "cid").distinct().groupBy("hub").agg(F.count("*").alias("d")).join(apart, "hub").where("d * d <= apart")
    return named.join(merge.select("hub", F.lit(True).alias("one")), "hub", "left").select(
        F.when(F.col("one"), F.xxhash64("hub", F.lit("hub"))).otherwise(F.col("token")).alias("token"), "cid", "n", "comp").distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``: products of 0/1 tables of ``width`` shingles."""
    sides = [(np.repeat(np.arange(len(x), dtype=np.int32), [len(s) for s in x]), np.concatenate(x)) for x in (left, right)]
    both = np.intersect1d(np.unique(sides[0][1]), np.unique(sides[1][1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    placed = []
    for rows, values in sides:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = np.flatnonzero(both[at] == values)
        known = known[np.argsort(at[known], kind="stable")]
        placed.append((rows[known], at[known]))
    for low in range(0, len(both), width):
        tables = []
        for (rows, at), n in zip(placed, out.shape):
            part = slice(*np.searchsorted(at, (low, low + width)))
            tables.append(np.zeros((n, min(width, len(both) - low)), np.float32))
            tables[-1][rows[part], at[part] - low] = 1
        out += tables[0] @ tables[1].T
    return out


def _met(left: list[tuple], right: list[tuple]) -> tuple[list[int], list[int]]:
    """A link for each two components linked between sets ``n, comp, cid, shingles`` of both sides."""
    n_a, n_b = (np.array([x[0] for x in side], np.int64) for side in (left, right))
    comp_a, comp_b = (np.array([x[1] for x in side], np.int64) for side in (left, right))
    small, large = np.minimum(n_a[:, None], n_b), np.maximum(n_a[:, None], n_b)
    may = (comp_a[:, None] != comp_b) & (DEN * small >= NUM * large)
    rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return [], []
    common = _common([left[i][3] for i in rows], [right[j][3] for j in columns])
    linked = may[np.ix_(rows, columns)] & ((NUM + DEN) * common.astype(np.int64) >= NUM * (n_a[rows][:, None] + n_b[columns]))
    joined, out = set(), ([], [])
    for i, j in zip(*np.nonzero(linked)):
        a, b = left[rows[i]], right[columns[j]]
        pair = (min(a[1], b[1]), max(a[1], b[1]))
        if pair not in joined:
            joined.add(pair)
            out[0].append(max(a[2], b[2]))
            out[1].append(min(a[2], b[2]))
    return out


def _block_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between different components on open lists of any length.

    The sets outside a list's largest component are held against all of the list: both sides are dealt into blocks of at
    most ``CELL_SETS`` sets and ``CELL_SHINGLES`` shingles or so, by bands of sizes, and two blocks meet in one task, which
    counts what all their pairs share at once and gives out the links alone.
    """
    lists = _merged_lists(lists).withColumn("band", F.floor(F.log("n") / math.log(DEN / NUM)).cast("int"))
    tops = lists.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).select(
        "token", F.col("top.comp").alias("top"), (F.col("all") - F.col("top.c")).alias("outs"))
    room = F.greatest(F.lit(16), F.least(F.lit(CELL_SETS), F.floor(F.lit(CELL_SHINGLES) / F.pow(F.lit(DEN / NUM), "band"))))
    rooms = lists.groupBy("token", "band").agg(F.count("*").alias("c")).join(tops, "token").select(
        "token", "band", "top", F.ceil(F.col("outs") / room).cast("int").alias("outs"), F.ceil(F.col("c") / room).cast("int").alias("alls"))
    outside = lists.join(tops.select("token", "top"), "token").where("comp <> top").drop("top").withColumn(
        "band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    h = F.xxhash64("cid")
    left = outside.join(rooms, ["token", "band"]).select(
        "token", "cid", "n", "comp", F.lit(0).alias("side"), F.pmod(h, "outs").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), "band")
    right = lists.join(rooms, ["token", "band"]).select(
        "token", "cid", "n", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"),
        F.pmod(h, "alls").cast("int").alias("j"), "band")
    cells = left.unionByName(right).join(sets, "cid").select(
        "token", "i", "j", "band", "side", "n", "comp", "cid", "whole")
    names = cells.columns

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        cell, sides = None, ([], [])
        for batch in rows:
            for token, i, j, band, side, n, comp, cid, whole in zip(*[batch[c] for c in names]):
                if (token, i, j, band) != cell:
                    if all(sides):
                        yield _met(*sides)
                    cell, sides = (token, i, j, band), ([], [])
                sides[side].append((n, comp, cid, np.frombuffer(whole, np.uint64)))
        if all(sides):
            yield _met(*sides)

    placed = cells.repartition("token", "i", "j", "band").sortWithinPartitions("token", "i", "j", "band", "side")
    return map_columns(placed, run, "a long, b long").distinct()


def _long_links(ids: DataFrame, wholes: DataFrame, edges: DataFrame, comps: DataFrame, cuts: Cuts,
                report: dict | None) -> DataFrame:
    """Links among the sets ``ids`` of long lists, enough to connect what is reachable: new lists by the rarest shingles of
    the whole sets, turns of checks of each set against one hub, then the lists that are still open."""
    sets = cuts.keep(wholes.join(ids, "cid", "left_semi"), "long-sets")
    cuts.drop("open-heads")
    lists = cuts.keep(_rare_lists(sets, cuts), "rare-lists")
    release(cuts.spark)
    found = edges.limit(0)
    for turn in range(HUB_TURNS):
        pairs = _hub_pairs(_open_lists(lists, comps, cuts), turn)
        found = cuts.keep(found.unionByName(checked_pairs(pairs, sets).where(LINKED).select("a", "b")), "hub-links")
        comps = components(edges.unionByName(found), cuts)
        cuts.drop("open-lists", "hub-links", "components", but_last=True)
    open_ = _open_lists(lists, comps, cuts)
    cuts.drop("rare-lists")
    cuts.drop("open-lists", but_last=True)
    release(cuts.spark)
    if report is not None:
        report["long"] = (sets.count(), found.count(), *open_.agg(F.count("*"), F.countDistinct("token"), F.max("m")).first())
    return found.unionByName(_block_links(open_.select("token", "cid", "n", "comp"), sets))


def _short_pairs(short: DataFrame) -> DataFrame:
    """Feasible pairs of different components on lists of at most ``SHORT_LIST`` sets."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for batch in rows:
            found = set()
            for s in batch["s"]:
                s = sorted((x["cid"], x["n"], x["comp"]) for x in s)
                found.update((a, b) for i, (a, na, ca) in enumerate(s) for b, nb, cb in s[i + 1:]
                             if ca != cb and DEN * min(na, nb) >= NUM * max(na, nb))
            found = sorted(found)
            yield [p[0] for p in found], [p[1] for p in found]

    grouped = short.groupBy("token").agg(F.collect_list(F.struct("cid", "n", "comp")).alias("s"))
    return map_columns(grouped.select("s"), run, "a long, b long").distinct()


def class_components(classes: DataFrame, blocks: DataFrame, cuts: Cuts, report: dict | None = None) -> DataFrame:
    """``cid, comp`` for the classes that are linked with another one. ``blocks`` is dropped once it is read."""
    spark = cuts.spark

    def tell(**figures) -> None:
        """Counts for a caller who asks; each is a job of its own."""
        if report is not None:
            report.update({k: f() for k, f in figures.items()})

    histogram = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 4 * SMALL_MOST).groupBy("n").count().collect()}
    x = boundary(histogram)
    tell(boundary=lambda: x)

    def of_blocks(some: DataFrame) -> DataFrame:
        reps = some.groupBy("block").agg(F.collect_list(F.struct("idx", "cid")).alias("reps"))
        return blocks.select("block", "sizes", "sets").join(
            reps.select("block", F.sort_array("reps").alias("reps")), "block")

    edges = cuts.keep(_small_links(_wholes(of_blocks(classes.where(F.col("n") <= x))), x, cuts), "edges")
    cuts.drop("subsets", "subset-groups")
    ranges = partitions(spark)
    large = of_blocks(classes.where(F.col("n") > slack_free(x)))
    counts = _counted(large, ranges).groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("found"))
    heads = cuts.keep(_open_heads(large.join(counts, "block"), ranges), "open-heads")
    cuts.drop("sets")
    release(spark)
    wholes = heads.select("cid", "whole")
    entries = heads.select("cid", "n", F.explode("tokens").alias("token"))
    hubs = cuts.keep(entries.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("cid", "n")).alias("hub"))
                  .where("m > 1").select("token", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    lists = cuts.keep(entries.join(hubs, "token"), "lists")
    cuts.drop("hubs")
    votes = lists.where("cid <> hub and " + feasible("n", "hub_n")).groupBy("cid", "hub").count()
    first = votes.groupBy("cid").agg(F.max(F.struct("count", "hub")).alias("v")).select(
        F.least("cid", "v.hub").alias("a"), F.greatest("cid", "v.hub").alias("b")).distinct()
    done = cuts.keep(checked_pairs(first, wholes), "checked")
    edges = edges.unionByName(done.where(LINKED).select("a", "b"))
    comps = components(edges, cuts)
    lists = _open_lists(lists.select("token", "cid", "n"), comps, cuts)
    cuts.drop("lists")
    release(spark)
    short = lists.where(F.col("m") <= SHORT_LIST)
    tell(open=lists.agg(F.count("*"), F.countDistinct("token"), F.max("m"), F.sum((F.col("m") > SHORT_LIST).cast("int"))).first)
    pairs = _short_pairs(short.select("token", "cid", "n", "comp")).join(done.select("a", "b"), ["a", "b"], "left_anti")
    pairs = cuts.keep(pairs, "pairs")
    linked = [F.count("*"), F.sum(F.expr(LINKED).cast("int"))]
    tell(pairs=pairs.count, first=done.agg(*linked).first, heads=heads.agg(F.count("*"), F.sum(F.size("tokens")), F.sum("n")).first)
    done = cuts.keep(checked_pairs(pairs, wholes), "checked")
    tell(second=done.agg(*linked).first)
    edges = cuts.keep(edges.unionByName(done.where(LINKED).select("a", "b")), "edges")
    comps = components(edges, cuts)
    ids = cuts.keep(lists.where(F.col("m") > SHORT_LIST).select("cid").distinct(), "long-ids")
    cuts.drop("pairs", "checked", "open-lists")
    release(spark)
    cuts.drop("edges", "components", but_last=True)
    if ids.isEmpty():
        return comps
    edges = cuts.keep(edges.unionByName(_long_links(ids, wholes, edges, comps, cuts, report)), "edges")
    return components(edges, cuts)


def jaccard_components(docs: DataFrame, report: dict | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    spark = docs.sparkSession
    with small_batches(spark):
        return _jaccard_components(spark, docs, report)


def _jaccard_components(spark: SparkSession, docs: DataFrame, report: dict | None) -> DataFrame:
    cuts = Cuts(spark)
    blocks = cuts.bucketed(map_columns(texts(docs), _blocks, BLOCK), "sets", "block", "none")
    rows = cuts.keep(blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes", "d1", "d2")).alias("idx", "r")).select(
        "block", "idx", F.col("r.doc_ids").alias("doc_id"), F.col("r.sizes").alias("n"), "r.d1", "r.d2"), "rows")
    classes = cuts.keep(rows.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("block", "idx")).alias("rep")
    ).select("d1", "d2", "n", "first_id", "rep.*", F.monotonically_increasing_id().alias("cid")), "classes")
    comps = class_components(classes, blocks, cuts, report)
    labelled = classes.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = labelled.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    known = cuts.keep(labelled.join(least, "comp").select("d1", "d2", F.lit(1).alias("one"), "component_id"), "labels")
    found = stored(rows.join(known, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("one").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "near-groups")
    cuts.clear()
    return found


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps the one with the smallest ``doc_id``.

    Documents without words are linked with nothing and stay. Of linked rows with one id, one stays; rows with a null
    id stay only where their group has no numbered row.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), "rows")
    found = jaccard_components(rows.select(F.col("_at").alias("doc_id"), "_row.text"))
    ids = rows.select("_at", F.col("_row.doc_id").alias("id"))
    places = found.select(F.col("doc_id").alias("_at"), "component_id").join(ids, "_at")
    stay = places.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_at")).alias("s")).select("s._at")
    return rows.join(stay, "_at", "left_semi").select("_row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
