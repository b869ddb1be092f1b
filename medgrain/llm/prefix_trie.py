"""Prefix trie of rebuilt conversations: balanced parentheses per shard, spines merged by sums.

1. One range sort puts turns in order; a conversation may span partitions. Each turn gets its place and the polynomial
   fingerprint of its conversation up to it, modulo two primes. Fingerprints compose, so what a partition begins with is
   added afterwards, from a table of one row for each partition.
2. A conversation is rebuilt from at most five turns of another and its own later turns; the fingerprints of the new
   sequence follow from the old ones. Equal prefixes are one node, so members, smallest member and children are counts
   and minima that are made before the shuffle.
3. Conversations, cut into units of ``UNIT`` turns, are dealt by ranges of their first nodes, and ties by ``conv_id``, so
   that a very common beginning lies on many shards. A shard writes its units as balanced parentheses, at most
   ``TRIE_NODES`` nodes at a time. Blocks with the least excess and a tree of minima over them find the parenthesis that
   closes each node (``close_of``); leaf pairs up to there are counted by rank, savings by a cumulative array.
4. Only the smallest member's shard gives weight to a node, so the sums of nodes that several tries hold add up.
   What the later units of a long conversation hold is added to the last node of the earlier ones.
5. The members that end at a node are packed in order, then hashed as their packs stream by.

Null roles and texts are empty. Turns are ordered by turn (null first), role, text; repeated rows are turns of their own.
Rows without a ``conv_id`` take no part. ``%`` keeps the sign of its left side, as in SQL. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medgrain.llm.common import map_columns, small_batches, stored, table

PRIMES = ((1 << 61) - 1, (1 << 59) - 55)
BASE = 0x1F3D5B79A8642
MOST_HEAD, FAMILY = 6, 100
UNIT = 4096
TRIE_NODES = 1 << 17
EXCESS_BLOCK = 64
PACK_IDS = 20_000
TURN = "conv_id long, pos long, chars long, p1 long, p2 long, h1 long, h2 long"
NODE = ["depth", "h1", "h2"]


def _joined(before: tuple, after: tuple, places: int) -> tuple:
    """Fingerprint of a sequence of ``places`` turns with fingerprint ``before``, followed by one with ``after``."""
    return tuple((a + pow(BASE, places, p) * b) % p for a, b, p in zip(before, after, PRIMES))


def _without(whole: tuple, before: tuple, places: int) -> tuple:
    """Fingerprint of what follows the first ``places`` turns, whose fingerprint is ``before``."""
    return tuple((a - b) * pow(BASE, -places, p) % p for a, b, p in zip(whole, before, PRIMES))


def _prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, chars`` and the fingerprints before (``p1, p2``) and with (``h1, h2``) each turn."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))

    def chain(batches: Iterator[dict]) -> Iterator[tuple]:
        conv, pos, state, powers = None, 0, (0, 0), (1, 1)
        for b in batches:
            out = []
            for conv_id, role, text, part in zip(b["conv_id"], b["role"], b["text"], b["part"]):
                if conv_id != conv:
                    conv, pos, state, powers = conv_id, 0, (0, 0), (1, 1)
                digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                turn, before = (int.from_bytes(digest[:16]), int.from_bytes(digest[16:])), state
                state = tuple((s + w * t) % p for s, w, t, p in zip(state, powers, turn, PRIMES))
                powers = tuple(w * BASE % p for w, p in zip(powers, PRIMES))
                out.append((part, conv_id, pos, len(text), *before, *state))
                pos += 1
            if out:
                yield tuple(zip(*out))

    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "role", "text", F.spark_partition_id().alias("part"))
    turns = stored(map_columns(placed, chain, f"part int, {TURN}"), "trie-turns")
    # What each partition's first conversation holds on earlier partitions: one row for each partition.
    runs = turns.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by(
            F.struct("pos", "h1", "h2"), F.struct("conv_id", "pos")).alias("end")).orderBy("part").collect()
    carry, conv, places, state = {}, None, 0, (0, 0)
    for r in runs:
        if r["first"] == conv:
            carry[r["part"]] = (conv, places, state)
        end, n = (r["end"]["h1"], r["end"]["h2"]), r["end"]["pos"] + 1
        if r["first"] == r["last"] == conv:
            state, places = _joined(state, end, places), places + n
        else:
            conv, places, state = r["last"], n, end

    def shift(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            pos, p1, p2, h1, h2 = [b[c] for c in ("pos", "p1", "p2", "h1", "h2")]
            for i, (part, conv_id) in enumerate(zip(b["part"], b["conv_id"])):
                conv, places, state = carry.get(part, (None, 0, None))
                if conv_id == conv:
                    pos[i] += places
                    p1[i], p2[i] = _joined(state, (p1[i], p2[i]), places)
                    h1[i], h2[i] = _joined(state, (h1[i], h2[i]), places)
            yield b["conv_id"], pos, b["chars"], p1, p2, h1, h2

    return map_columns(turns, shift, TURN)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (``conv_id, depth, chars, p1, p2, h1, h2``, depth from 1), and for each
    conversation the node where it ends (``conv_id, depth, h1, h2``; zeros: without a turn)."""
    turns = stored(_prefixes(conversations), "trie-prefixes")
    turn = F.struct("pos", "chars", "p1", "p2", "h1", "h2")
    firsts = turns.where(F.col("pos") < MOST_HEAD - 1).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("firsts"))  # at most five turns
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    lenders = firsts.select(F.col("conv_id").alias("family"), F.col("firsts").alias("given"))
    plan = stored(
        firsts.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).cast("int"))
        .withColumn("family", family).join(lenders, "family", "left")
        .select("conv_id", "h", F.expr("coalesce(slice(given, 1, h), slice(firsts, 1, 0))").alias("given"),
                F.expr("case when h > 0 then get(firsts, h - 1) end").alias("cut")), "trie-plan")
    glue = plan.select("conv_id", "h", F.size("given").alias("places"),
                       F.expr("get(given, size(given) - 1)").alias("begun"), "cut")
    names = ["conv_id", "h", "places", "begun", "cut", "pos", "chars", "p1", "p2", "h1", "h2"]

    def move(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            out = []
            for conv_id, h, places, begun, cut, pos, chars, *state in zip(*[b[c] for c in names]):
                both = [tuple(state[:2]), tuple(state[2:])]
                if cut:
                    both = [_without(x, (cut["h1"], cut["h2"]), h) for x in both]
                if begun:
                    both = [_joined((begun["h1"], begun["h2"]), x, places) for x in both]
                out.append((conv_id, places + pos - h + 1, chars, *both[0], *both[1]))
            if out:
                yield tuple(zip(*out))

    own = map_columns(turns.join(glue, "conv_id").where("pos >= h").select(*names), move, TURN.replace("pos", "depth"))
    lent = plan.select("conv_id", F.explode("given").alias("g")).select("conv_id", "g.*").withColumn(
        "pos", F.col("pos") + 1).withColumnRenamed("pos", "depth")
    rows = stored(lent.unionByName(own), "trie-rows")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "h1", "h2")).alias("e"))
    ends = plan.select("conv_id").join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in NODE])
    return rows, ends


def close_of(bits: np.ndarray) -> np.ndarray:
    """For each opening parenthesis (1), in order, where it closes: the first later place with a smaller excess.

    The rest of its block is looked through first, then blocks, by a tree of their least excess, then the block found.
    """
    excess = np.cumsum(np.where(bits == 1, 1, -1))
    n, width = len(bits), EXCESS_BLOCK
    blocks = 1 << max(0, (-(-n // width) - 1).bit_length())
    padded = np.full(blocks * width, np.iinfo(np.int64).max)
    padded[:n] = excess
    levels = [padded.reshape(blocks, width).min(1)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(1))
    opens = np.flatnonzero(bits == 1)
    goal = excess[opens] - 1
    close = np.full(len(opens), -1)

    def look(which: np.ndarray, start: np.ndarray) -> np.ndarray:
        """First place from ``start`` on with the goal, inside its block; the ones not found are returned."""
        at = start.copy()
        last = (start // width + 1) * width
        while len(which):
            inside = at < last
            which, at, last = which[inside], at[inside], last[inside]
            hit = padded[at] <= goal[which]
            close[which[hit]] = at[hit]
            which, at, last = which[~hit], at[~hit] + 1, last[~hit]
        return np.flatnonzero(close < 0)

    away = (opens + 1) % width == 0
    rest = look(np.flatnonzero(~away), opens[~away] + 1)
    if len(rest):
        block, level, found = opens[rest] // width, np.zeros(len(rest), int), np.zeros(len(rest), bool)
        while not found.all():  # up, until a block or a run of blocks to the right reaches the goal
            for k in np.unique(level[~found]):
                some = np.flatnonzero(~found & (level == k))
                right = block[some] + 1
                left_child = block[some] % 2 == 0
                ok = left_child & (levels[k][np.minimum(right, len(levels[k]) - 1)] <= goal[rest[some]])
                found[some[ok]] = True
                block[some[ok]] = right[ok]
                block[some[~ok]] //= 2
                level[some[~ok]] += 1
        while level.any():  # down, to the first such block
            some = np.flatnonzero(level)
            level[some] -= 1
            for k in np.unique(level[some]):
                at = some[level[some] == k]
                left = levels[k][2 * block[at]] <= goal[rest[at]]
                block[at] = 2 * block[at] + ~left
        look(rest, block * width)
    return close


def _subtree_sums(units: DataFrame) -> DataFrame:
    """``depth, h1, h2, leaves, saved, above``: each trie's part of the sums over a node's subtree, and the smallest
    member of the node above it where the trie holds the node's own smallest member."""

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        path: list[tuple] = []  # open nodes
        where: list[int] = []  # and their places in the lists below
        bits: list[int] = []
        nodes, leaves, saved, above = [], [], [], []

        def flush() -> tuple:
            b = np.array(bits + [0] * len(path), np.int8)
            opens, close = np.flatnonzero(b == 1), close_of(b)
            leaf, value = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            leaf[opens], value[opens] = leaves, saved
            pairs = (b == 1) & (np.append(b[1:], 1) == 0)
            rank = np.cumsum(np.where(pairs, leaf, 0))  # of leaf pairs, each with what this trie owns of it
            total = np.cumsum(value)
            kept = [i for i, node in enumerate(nodes) if node]
            first, last = opens[kept], close[kept]
            out = (*(list(x) for x in zip(*[nodes[i] for i in kept])), rank[last] - rank[first] + np.where(
                pairs[first], leaf[first], 0), total[last] - total[first] + value[first], [above[i] for i in kept])
            for x in (path, where, bits, nodes, leaves, saved, above):
                x.clear()
            return out[:3] + (out[3].tolist(), out[4].tolist(), out[5])

        for b in batches:
            for seg, root, later_leaves, later_saved, entries in zip(
                    *[b[c] for c in ("seg", "root", "later_leaves", "later_saved", "entries")]):
                if seg:
                    top, *entries = entries
                else:
                    top = {"depth": 0, "h1": 0, "h2": 0, "owner": root}
                if not (later_leaves or later_saved or any(e["own"] for e in entries)):
                    continue
                if len(nodes) >= TRIE_NODES:
                    yield flush()
                keys = [(e["depth"], e["h1"], e["h2"]) for e in (top, *entries)]
                same = 0
                while same < min(len(path), len(keys)) and path[same] == keys[same]:
                    same += 1
                bits.extend([0] * (len(path) - same))
                del path[same:], where[same:]
                for i in range(same, len(keys)):
                    path.append(keys[i])
                    where.append(len(nodes))
                    bits.append(1)
                    # The top of a later unit has its sums in the unit before.
                    nodes.append(None if i == 0 and seg else keys[i])
                    leaves.append(0)
                    saved.append(0)
                    above.append(None)
                upper = top["owner"]
                for at, e in zip(where[1:], entries):
                    if e["own"]:
                        leaves[at], saved[at], above[at] = int(e["leaf"]), e["save"], upper
                    upper = e["owner"]
                leaves[where[-1]] += later_leaves
                saved[where[-1]] += later_saved
        if nodes:
            yield flush()

    return map_columns(units, run, "depth long, h1 long, h2 long, leaves long, saved long, above long")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends_sha256`` of the nodes where conversations end."""

    def pack(batches: Iterator[dict]) -> Iterator[tuple]:
        held: list = [None, []]

        def flush() -> tuple:
            row = (*([x] for x in held[0]), [held[1][0]], [",".join(map(str, held[1]))])
            held[1] = []
            return row

        for b in batches:
            out = []
            for *node, conv_id in zip(*[b[c] for c in (*NODE, "conv_id")]):
                if held[1] and (node != held[0] or len(held[1]) >= PACK_IDS):
                    out.append(flush())
                held[0] = node
                held[1].append(conv_id)
            if out:
                yield tuple([x for row in column for x in row] for column in zip(*out))
        if held[1]:
            yield flush()

    def digest(batches: Iterator[dict]) -> Iterator[tuple]:
        now, state = None, None
        for b in batches:
            out = []
            for *node, ids in zip(*[b[c] for c in (*NODE, "ids")]):
                if node != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield tuple(zip(*out))
        if now:
            yield tuple(zip((*now, state.hexdigest())))

    order = [*NODE, "conv_id"]
    packs = map_columns(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), pack,
                        "depth long, h1 long, h2 long, first long, ids string")
    return map_columns(packs.repartition(*NODE).sortWithinPartitions(*NODE, "first"), digest,
                       "depth long, h1 long, h2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations; see the module and ``op12_prefix_trie``."""
    rows, ends = rebuilt(conversations)
    ends = stored(ends, "trie-ends")
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], "n_convs", "owner", F.lit(0).cast("long").alias("chars"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = stored(rows.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2")).unionByName(root), "trie-parents")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").select(
        *NODE, "n_convs", "owner", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("save")), "trie-nodes")
    own = F.col("conv_id") == F.col("owner")
    placed = rows.select("conv_id", *NODE).join(nodes, NODE).select(
        "conv_id", *NODE, "owner", own.alias("own"), (own & (F.col("n_children") == 0)).cast("long").alias("leaf"),
        F.when(own, F.col("save")).otherwise(0).alias("save"))
    # A unit begins with the last node of the one before it, or the root.
    segs = F.expr(f"case when depth % {UNIT} = 0 then array((depth - 1) div {UNIT}, depth div {UNIT}) "
                  f"else array((depth - 1) div {UNIT}) end")
    units = stored(placed.withColumn("seg", F.explode(segs)).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct(*NODE, "owner", "own", "leaf", "save"))).alias("entries")), "trie-units")
    counted = F.col("entries.depth")[0] > F.col("seg") * UNIT
    sums = units.select("conv_id", "seg", *[
        (F.aggregate(f"entries.{c}", F.lit(0).cast("long"), lambda x, y: x + y)
         - F.when(counted, 0).otherwise(F.col(f"entries.{c}")[0])).alias(c) for c in ("leaf", "save")])
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    later_sums = sums.select("conv_id", "seg", F.sum("leaf").over(later).alias("later_leaves"),
                             F.sum("save").over(later).alias("later_saved")).where("later_leaves > 0 or later_saved > 0")
    keys = [F.col("seg"), *[F.expr(f"get(entries, {i}).h1").alias(f"k{i}") for i in range(4)], F.col("conv_id")]
    root_owner = F.lit(ends.agg(F.min("conv_id")).first()[0]).cast("long")
    full = units.join(later_sums, ["conv_id", "seg"], "left").select(
        *keys, root_owner.alias("root"), F.coalesce("later_leaves", F.lit(0)).alias("later_leaves"),
        F.coalesce("later_saved", F.lit(0)).alias("later_saved"), "entries")
    order = ["seg", "k0", "k1", "k2", "k3", "conv_id"]
    with small_batches(conversations.sparkSession):
        parts = stored(_subtree_sums(full.repartitionByRange(*order).sortWithinPartitions(*order)), "trie-sums")
    sums = parts.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                    F.max("above").alias("parent_conv_id"))
    return nodes.join(sums, NODE, "left").join(_end_hashes(ends), NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.coalesce("leaves", F.lit(0)))
        .cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"))


#: CRC-32 of a short text in SQL: one turn for each byte, eight for its bits.
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
  lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
ORACLE = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
    partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % {FAMILY} as family, {_CRC} % {MOST_HEAD} as h from (select distinct conv_id from t)),
lent as (select c.conv_id, t.pos + 1 as depth, role, text from c join t on t.conv_id = c.family where t.pos < c.h),
n as (select c.conv_id, c.h, count(lent.depth) as places from c left join lent using (conv_id) group by all),
r as (
  select * from lent
  union all
  select t.conv_id, n.places + t.pos - n.h + 1, role, text from t join n using (conv_id) where t.pos >= n.h),
p as (
  select conv_id, depth, length(text) as chars, string_agg(sha256(length(role) || ':' || role || text), '') over (
    partition by conv_id order by depth) as name
  from r
  union all
  select conv_id, 0, 0, '' from c),
k as (select name, depth, min(conv_id) as owner, count(*) as n_convs, max(chars) as chars from p group by name, depth),
kids as (select left(name, 64 * (depth - 1)) as name, count(*) as n from k where depth > 0 group by 1),
w as (select k.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * chars as save from k left join kids using (name)),
subtree as (
  select left(name, 64 * d) as name, sum(cast(n_children = 0 as bigint)) as leaves, sum(save) as saved
  from (select *, unnest(range(0, depth + 1)) as d from w) group by 1),
ends as (
  select name, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, max_by(name, depth) as name from p group by conv_id) group by name)
select w.owner as conv_id, w.depth, above.owner as parent_conv_id, w.n_convs, cast(w.n_children as bigint) as n_children,
       cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from w join subtree using (name) left join ends using (name)
left join k above on w.depth > 0 and above.name = left(w.name, 64 * (w.depth - 1))"""
