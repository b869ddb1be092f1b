"""Shards by vector bin packing: bytes, words and rows are balanced together.

Groups of equal texts are dealt by hash into a fixed number of parcels, so a group stays together. A group that holds
more than one parcel's fair share of bytes, words or rows becomes a parcel of its own, counted by cells that a hash of
the id makes. There are at most seven times ``parcels`` cells, whatever the input, so their totals may be placed on the
driver: large groups in falling size, each whole where the dot product with the residual capacity is highest among the
shards with room for it in bytes, words and rows; then all other parcels and cells, each where the dot product is
highest. A group is cut into its cells only where no shard has room for it, be it that it holds more than a shard or
that larger groups left too little: to keep it whole would break the law, which is ``bytes``. Slots are ranks inside a cell after the rows of the shard's earlier cells; no window spans a shard or a large
group.

Null texts have no bytes but the row's one; repeated rows get slots of their own; an empty table has no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medgrain.llm.common import WORD, stored, table, texts

#: How much each of bytes, words and rows counts in the dot product; bytes lead, as their law is the one held.
WEIGHTS = np.array([4.0, 1.0, 1.0])
DIMENSIONS = ["size", "words", "rows"]


def place(parcels: list[np.ndarray], shards: int) -> list[list[int]]:
    """Shard of each cell of each parcel (cells: rows of three totals).

    Parcels of several cells come first, in falling size, each whole where a shard has room; then all other cells.
    """
    whole = np.array([p.sum(axis=0) for p in parcels]).reshape(-1, 3)
    total = np.maximum(whole.sum(axis=0), 1.0)
    room = np.tile(WEIGHTS / shards, (shards, 1))
    out = [[-1] * len(p) for p in parcels]
    single = []
    for i in np.lexsort((-whole[:, 2], -whole[:, 1], -whole[:, 0])).tolist():
        share = whole[i] / total * WEIGHTS
        fits = (room >= share - 1e-12).all(axis=1)
        if len(parcels[i]) > 1 and fits.any():
            best = int(np.argmax(np.where(fits, room @ share, -np.inf)))
            room[best] -= share
            out[i] = [best] * len(parcels[i])
        else:
            single += [(i, j) for j in range(len(parcels[i]))]
    cells = np.array([parcels[i][j] for i, j in single]).reshape(-1, 3)
    for at in np.lexsort((-cells[:, 2], -cells[:, 1], -cells[:, 0])).tolist():
        share = cells[at] / total * WEIGHTS
        best = int(np.argmax(room @ share))
        room[best] -= share
        out[single[at][0]][single[at][1]] = best
    return out


def pack(docs: DataFrame, shards: int = 8, parcels: int = 4096) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(texts(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(text).alias("gid"),
    ), "sizes")
    totals = rows.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")).first()
    share = [max(1.0, (totals[d] or 0) / parcels) for d in DIMENSIONS]
    sums = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    ratio = F.greatest(*[F.col(d) / F.lit(s) for d, s in zip(DIMENSIONS, share)])
    # At most three times ``parcels`` groups exceed a share, so this table may be broadcast.
    large = stored(
        rows.groupBy("gid").agg(*sums).where((ratio > 1) & (F.col("rows") > 1))
        .select("gid", F.ceil(ratio).cast("int").alias("cells")), "large-groups",
    )
    cell = F.coalesce(F.pmod(F.hash("doc_id"), F.col("cells")), F.lit(-1))
    dealt = rows.join(F.broadcast(large), "gid", "left").withColumn("cell", cell).withColumn(
        "parcel", F.when(F.col("cell") < 0, F.pmod("gid", F.lit(parcels))).otherwise(F.col("gid")))
    key = ["parcel", "cell"]
    units: dict = defaultdict(list)
    for r in dealt.groupBy(*key).agg(*sums).orderBy(*key).collect():
        units[r["parcel"], r["cell"] < 0].append(r)
    filled, cells = [0] * shards, []
    vectors = [np.array([[r[d] for d in DIMENSIONS] for r in u], float) for u in units.values()]
    for unit, shard_of in zip(units.values(), place(vectors, shards)):
        for r, shard in zip(unit, shard_of):
            cells.append((r["parcel"], r["cell"], shard, filled[shard]))
            filled[shard] += r["rows"]
    where = spark.createDataFrame(cells, "parcel long, cell int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("rank", rank).join(F.broadcast(where), key).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "words",
    )


def op7_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
