"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A node is a distinct sequence of turns from a conversation's start, named by a chained digest. Conversations sorted by
their digests put every subtree together; a node belongs to the first conversation that holds it, and nodes ordered by
(place of that conversation, depth) are in depth-first order. Each node carries

* ``start``: its first token in the depth-first stream, ``size``: its tokens (code points of the formatted turn),
* ``position``: the position id of its first token, which counts its ancestors' tokens only,
* ``stop``: where its subtree ends. A token of node ``u`` is visible to later tokens before ``u.stop`` and no others,
* ``attends``: the stream intervals of its ancestors, adjacent ones merged,
* ``loss_from`` and ``loss_to``: the part of an assistant turn under the loss mask, as offsets in ``body``.

Template: ``### role: text</turn>\\n``; ``\\``, ``###`` and ``</turn>`` inside a text, and ``:`` inside a role, get a
backslash, so a control string without one is a real one.

Null roles and texts are empty. Turns of a conversation are ordered by turn, role and text; repeated rows are turns of
their own. Rows with a null ``conv_id`` form one conversation. A conversation is hashed as its rows stream by; only its
digests, eight bytes a turn, are held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm.common import map_columns, ordered, stored, table

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>\n))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_head(role: str) -> str:
    return OPEN + escape(role).replace(":", "\\:") + ": "


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in ``formatted``; raises where it is not whole turns."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def _turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: its node, the node above it, its formatted text and its place."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def chain(batches: Iterator[dict]) -> Iterator[tuple]:
        conv, depth, node, position, begun = None, 0, b"", 0, False
        for batch in batches:
            out = []
            for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if not begun or conv_id != conv:
                    conv, depth, node, position, begun = conv_id, 0, b"", 0, True
                above, digest = node, hashlib.sha256(node)
                digest.update(f"{len(role)}:{role}{text}".encode())
                node = digest.digest()
                head, body = turn_head(role), escape(text)
                whole = head + body + CLOSE
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                out.append((conv_id, depth, node, above or None, int.from_bytes(node[:8], signed=True), role, whole,
                            len(whole), position, *loss))
                depth, position = depth + 1, position + len(whole)
            if out:
                yield tuple(zip(*out))

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_columns(
        placed, chain, "conv_id long, depth long, node binary, parent binary, key long, role string, body string, "
        "size long, position long, loss_from int, loss_to int")


def _intervals(placed: DataFrame) -> DataFrame:
    """Merged stream intervals of the ancestors of each node, from the turns of the conversation that owns it."""

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        conv, begun, merged = None, False, []
        for batch in batches:
            nodes, found = [], []
            for conv_id, own, node, start, size in zip(
                    *[batch[c] for c in ("conv_id", "own", "node", "start", "size")]):
                if not begun or conv_id != conv:
                    conv, begun, merged = conv_id, True, []
                if own:
                    nodes.append(node)
                    found.append([{"low": a, "high": b} for a, b in merged])
                if merged and merged[-1][1] == start:
                    merged[-1][1] = start + size
                else:
                    merged.append([start, start + size])
            if nodes:
                yield nodes, found

    sorted_rows = placed.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return map_columns(sorted_rows.select("conv_id", "own", "node", "start", "size"), run,
                       "node binary, attends array<struct<low: bigint, high: bigint>>")


def build_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree, one row for each node in depth-first order, and the index ``conv_id, depth, node``."""
    turns = stored(_turns(conversations), "turns")
    keys = F.transform(F.sort_array(F.collect_list(F.struct("depth", "key"))), lambda x: x["key"])
    places = ordered(turns.groupBy("conv_id").agg(keys.alias("keys")), ["keys", "conv_id"]).select(
        F.col("conv_id").alias("_conv"), F.col("_index").alias("place"))
    index = turns.select("conv_id", "depth", "node")
    members = stored(index.join(places, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), "members")
    owners = members.groupBy("node").agg(F.min(F.struct("place", "conv_id", "depth")).alias("o")).select(
        F.col("o.place").alias("place"), F.col("o.conv_id").alias("_conv"), F.col("o.depth").alias("_depth"))
    own = turns.join(owners, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("depth") == F.col("_depth")))
    nodes = stored(
        ordered(own.drop("_conv", "_depth", "key"), ["place", "depth"], ("size",))
        .withColumnRenamed("_before_size", "start").withColumnRenamed("_index", "order"), "nodes")
    ends = nodes.groupBy(F.col("conv_id").alias("_conv")).agg(F.max(F.col("start") + F.col("size")).alias("end"))
    stops = members.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").groupBy("node").agg(
        F.max("end").alias("stop"))
    # A first turn may stand in a third of all conversations: the engine splits this join, then deals by conversation.
    placed = members.join(
        nodes.select("node", F.col("place").alias("first"), "start", "size"), "node"
    ).withColumn("own", F.col("place") == F.col("first"))
    tree = nodes.join(stops, "node").join(_intervals(placed), "node").drop("place")
    tree = stored(tree.repartitionByRange("order").sortWithinPartitions("order"), "tree")
    return tree, stored(index, "tree-index")


def read_back(tree: DataFrame, index: DataFrame) -> DataFrame:
    """Digests of every conversation, put together again from the nodes of the tree."""
    rows = index.join(tree.select("node", "body", "loss_from", "loss_to"), "node")

    def fold(batches: Iterator[dict]) -> Iterator[tuple]:
        conv, state = None, None

        def close() -> tuple:
            n, chars, loss_chars, whole, loss = state
            return conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            out = []
            for conv_id, body, low, high in zip(*[batch[c] for c in ("conv_id", "body", "loss_from", "loss_to")]):
                if state is None or conv_id != conv:
                    if state is not None:
                        out.append(close())
                    conv, state = conv_id, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for role, text in parse(body):
                    state[3].update(f"{role}\n{text}\n".encode())
                    state[0] += 1
                masked = unescape(body[low:high])
                state[4].update(masked.encode())
                state[2] += len(masked)
                state[1] += len(body)
            if out:
                yield tuple(zip(*out))
        if state is not None:
            yield tuple(zip(close()))

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return map_columns(placed.select("conv_id", "body", "loss_from", "loss_to"), fold,
                       "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                       "formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(*build_tree(rows))
