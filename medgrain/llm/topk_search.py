"""Exact top-k search by inner product: vectors in order of descending length, partial sums over rotated axes, and
Cauchy-Schwarz bounds on what is left.

1. Components become integers, ``floor(scale * x)``. One range sort puts all vectors in order of descending length.
2. The axes are the right singular vectors of all vectors' directions, from their sums of products (as large as the
   dimension squared, whatever the number of vectors), strongest first; so the first partial sums say most.
3. Every query meets the longest vectors, a head of at most ``HEAD_BYTES`` that is sent to all tasks, which gives its
   first threshold: the k-th best score so far.
4. The other vectors lie in groups of consecutive lengths. A block of queries goes to the groups whose longest vector can
   still reach one of its thresholds (length times length), which are the first so many; it skips the rest. In a cell
   (group, share of the query blocks) the group's blocks stand in memory, longest first, and query blocks stream past.
   For each pair of blocks the sums over the first axes plus the product of the two lengths left over rule pairs out;
   the others are scored exactly, in integers. Thresholds rise as blocks go by.
5. Each query's finds are ranked by score, then ``vec_id``.

Only whole blocks move, so a vector that a third of all rows repeat is dealt like any other. Bounds carry a margin above
all rounding, and they only leave out pairs that score below a threshold: the result is exact.

Vectors that are null or hold a null, NaN or infinite component take no part, nor do those with a component of 2**500 or
more after scaling. Shorter vectors count as filled up with zeros. Rows with equal ids are rows of their own; a null
``vec_id`` comes last among ties and is no query. Scores beyond 64 bits stand at the end of their range. Empty tables
and tables without a query give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medgrain.llm.common import map_columns, ordered, partitions, stored, table

K, SCALE, EVERY = 5, 256, 50
BLOCK, QUERIES = 2048, 256
HEAD_ROWS, HEAD_BYTES, GROUP_BYTES = 4096, 8 << 20, 64 << 20
CELL_PAIRS = 1 << 36
ENERGY = (0.5, 0.9)
EXACT, LAST = 2.0**52, 2**63 - 1
MOST = 2.0**500
FOUND = "own long, query_id long, vec_id long, score long"


def pack(values: np.ndarray) -> bytes:
    """Integer-valued doubles in the narrowest of three kinds, named by the first three bytes."""
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind.encode() + values.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(float)


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims))
    for row, p in zip(out, packed):
        v = unpack(p)
        row[:len(v)] = v
    return out


def _integers(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """``vec_id, query, shorter, size, vector``: the rows that take part; ``shorter`` is minus the length."""

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for vec_id, query, vector in zip(b["vec_id"], b["query"], b["vector"]):
                v = np.floor(scale * np.array(vector, float))  # a null becomes NaN
                if not (np.abs(v) < MOST).all():
                    continue
                for column, value in zip(out, (vec_id, bool(query), -float(np.sqrt(v @ v)), len(v), pack(v))):
                    column.append(value)
            yield out

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("query"),
                          F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    return map_columns(some, run, "vec_id long, query boolean, shorter double, size int, vector binary")


def rotation(rows: DataFrame, dims: int) -> tuple[np.ndarray, list[int]]:
    """Axes as columns, strongest first, and the numbers of axes that hold the shares ``ENERGY`` of all directions."""

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b["vector"], dims)
            length = -np.array(b["shorter"])
            m = m[length > 0] / length[length > 0, None]
            total += m.T @ m
        i, j = np.nonzero(np.triu(total))
        yield i.tolist(), j.tolist(), total[i, j]

    sums = np.zeros((dims, dims))
    for r in map_columns(rows.select("vector", "shorter"), run, "i int, j int, v double").groupBy("i", "j").agg(
            F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.v
    values, axes = np.linalg.eigh(sums)
    share = np.cumsum(np.maximum(values[::-1], 0)) / max(float(np.maximum(values, 0).sum()), 1e-300)
    widths = sorted({min(dims, int(np.searchsorted(share, e)) + 1) for e in ENERGY})
    return np.ascontiguousarray(axes[:, ::-1]), widths


class Side:
    """Vectors of one side with their rotated form and the lengths left after the first axes."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray, widths: list[int]):
        self.whole, self.turned = whole, whole @ axes
        self.length = np.sqrt((whole * whole).sum(1))
        self.rest = [np.sqrt((self.turned[:, w:] ** 2).sum(1)) for w in widths]


class Block(Side):
    """Candidates by (named, ``vec_id``), so that the first of equal scores is the one that ranks first."""

    def __init__(self, data: bytes, ids: bytes, unnamed: bytes, at: bytes, axes: np.ndarray, widths: list[int]):
        ids, unnamed, at = np.frombuffer(ids, np.int64), np.frombuffer(unnamed, bool), np.frombuffer(at, np.int64)
        order = np.lexsort((ids, unnamed))
        super().__init__(unpack(data).reshape(len(ids), -1)[order], axes, widths)
        self.ids, self.unnamed, self.at = ids[order], unnamed[order], at[order]
        self.by_at = np.argsort(self.at)
        self.longest = float(self.length.max())

    def column_of(self, own: np.ndarray) -> np.ndarray:
        """Column that holds each row ``own``, or -1."""
        found = self.by_at[np.minimum(np.searchsorted(self.at[self.by_at], own), len(self.at) - 1)]
        return np.where(self.at[found] == own, found, -1)


def exact_scores(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``; ``bound``: product of their lengths."""
    out = np.empty(len(a), np.int64)
    for low in range(0, len(a), 8192):
        some = slice(low, low + 8192)
        with np.errstate(invalid="ignore", over="ignore"):
            out[some] = np.einsum("ij,ij->i", a[some], b[some]).clip(-EXACT, EXACT)
    for i in np.flatnonzero(bound >= EXACT):
        score = sum(int(x) * int(y) for x, y in zip(a[i], b[i]))
        out[i] = max(-LAST, min(LAST, score))
    return out


class Best:
    """The k best finds of each query of a block, and the thresholds they give."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors.copy(), k
        self.found = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]  # query, score, id, unnamed

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        if not len(query):
            return
        both = [np.concatenate(x) for x in zip(self.found, (query, score, ids, unnamed))]
        order = np.lexsort((both[2], both[3], -both[1], both[0]))
        place = np.arange(len(order)) - np.searchsorted(both[0][order], both[0][order])
        self.found = [x[order][place < self.k] for x in both]
        last = place[place < self.k] == self.k - 1
        self.floors[self.found[0][last]] = np.maximum(self.floors[self.found[0][last]], self.found[1][last])


def scan(queries: Side, own: np.ndarray, blocks: list[Block], floors: np.ndarray, widths: list[int], k: int) -> Best:
    """Hold ``queries`` against ``blocks``, which stand longest first."""
    best = Best(floors, k)
    for block in blocks:
        reach = queries.length * block.longest
        rows = np.flatnonzero(reach * (1 + 1e-9) + 1 >= best.floors)
        if not len(rows):
            break  # no later block is longer
        least = best.floors[rows] - 1e-9 * reach[rows] - 1e-3
        total, low, alive = np.zeros((len(rows), len(block.ids))), 0, None
        for w, mine, theirs in zip(widths, queries.rest, block.rest):
            total += queries.turned[rows, low:w] @ block.turned[:, low:w].T
            alive = total + mine[rows, None] * theirs[None, :] >= least[:, None]
            low = w
            if 16 * alive.sum() < alive.size:
                break
        own_column = block.column_of(own[rows])
        here = np.flatnonzero(own_column >= 0)
        alive[here, own_column[here]] = False
        if 16 * alive.sum() >= alive.size and reach[rows].max() * len(block.ids) < EXACT:
            # Scored all at once; a key of score and place picks the k best of a row, ties to the first column.
            n = len(block.ids)
            key = np.where(alive, (queries.whole[rows] @ block.whole.T) * n + np.arange(n - 1, -1, -1), -2 * EXACT)
            some = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(rows), 1))
            i = np.repeat(np.arange(len(rows)), some.shape[1])
            j = some.ravel()
            kept = alive[i, j]
            i, j = i[kept], j[kept]
        else:
            i, j = np.nonzero(alive)
        bound = queries.length[rows[i]] * block.length[j]
        score = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = exact_scores(queries.whole[rows[i[part]]], block.whole[j[part]], bound[part])
        kept = score >= best.floors[rows[i]]
        best.add(rows[i[kept]], score[kept], block.ids[j[kept]], block.unnamed[j[kept]])
    return best


def _finds(best: Best, own: np.ndarray, query_ids: np.ndarray) -> tuple:
    query, score, ids, unnamed = best.found
    return (own[query].tolist(), query_ids[query].tolist(),
            [None if u else i for i, u in zip(ids.tolist(), unnamed.tolist())], score.tolist())


def _blocks(rows: DataFrame, dims: int, group: str, most: int) -> DataFrame:
    """``grp, longest, at, ids, unnamed, data``: rows of a group packed as they stream by, at most ``most`` together."""

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple] = []

        def flush() -> tuple:
            _, at, ids, vectors, shorter = zip(*held)
            row = ([held[0][0]], [-min(shorter)], [np.array(at, np.int64).tobytes()],
                   [np.array([i or 0 for i in ids], np.int64).tobytes()],
                   [np.array([i is None for i in ids]).tobytes()], [pack(_matrix(vectors, dims))])
            held.clear()
            return row

        for b in batches:
            for row in zip(*[b[c] for c in ("grp", "_index", "vec_id", "vector", "shorter")]):
                if held and (row[0] != held[0][0] or len(held) >= most):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return map_columns(rows.select(F.expr(group).cast("int").alias("grp"), "_index", "vec_id", "vector", "shorter"), run,
                       "grp int, longest double, at binary, ids binary, unnamed binary, data binary")


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows other than its own with the highest inner products, for each row
    of ``vectors`` (``vec_id``, ``embedding``) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = ordered(_integers(vectors, is_query, scale), ["shorter", "vec_id"])
    n, dims, n_queries = rows.agg(F.count("*"), F.max("size"), F.sum(F.col("query").cast("long"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    axes, widths = rotation(rows, dims)
    head = min(HEAD_ROWS, max(k + 1, HEAD_BYTES // (8 * dims)))
    size = max(1, min(GROUP_BYTES // (8 * dims), -(-(n - head) // partitions(spark))))
    blocks = stored(_blocks(rows.where(F.col("_index") >= head), dims, f"(_index - {head}) div {size}", BLOCK), "blocks")
    limits = np.zeros(max(0, -(-(n - head) // size)))  # one number for each group of vectors
    for r in blocks.groupBy("grp").agg(F.max("longest").alias("longest")).collect():
        limits[r.grp] = r.longest
    longest = [tuple(map(bytes, r)) for r in _blocks(rows.where(F.col("_index") < head), dims, "0", BLOCK).orderBy(
        F.desc("longest")).select("data", "ids", "unnamed", "at").collect()]  # at most HEAD_BYTES
    shared = spark.sparkContext.broadcast((longest, limits, axes))

    def first(batches: Iterator[dict]) -> Iterator[tuple]:
        longest, limits, axes = shared.value
        blocks = [Block(*b, axes, widths) for b in longest]
        for b in batches:
            for at, ids, data in zip(b["at"], b["ids"], b["data"]):
                own, query_ids = np.frombuffer(at, np.int64), np.frombuffer(ids, np.int64)
                queries = Side(unpack(data).reshape(len(own), -1), axes, widths)
                best = scan(queries, own, blocks, np.full(len(own), -LAST), widths, k)
                reach = np.outer(limits, queries.length) * (1 + 1e-9) + 1 >= best.floors[None, :]
                last = int(np.flatnonzero(reach.any(1)).max(initial=-1))
                yield ([at], [ids], [data], [best.floors.tobytes()], [last],
                       [[dict(zip(("own", "query_id", "vec_id", "score"), f)) for f in zip(*_finds(best, own, query_ids))]])

    asked = stored(map_columns(
        _blocks(rows.where("query"), dims, "0", QUERIES), first, "at binary, ids binary, data binary, floors binary, "
        f"last int, found array<struct<{', '.join(c.replace(' ', ': ') for c in FOUND.split(', '))}>>"), "asked")
    shares = max(1, -(-n_queries * size // CELL_PAIRS))
    none = F.lit(b"")
    held = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
        (F.col("grp") * shares + F.col("share")).alias("cell"), F.lit(0).alias("kind"), (-F.col("longest")).alias("place"),
        "at", "ids", F.col("unnamed").alias("more"), "data")
    passing = asked.where("last >= 0").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        (F.col("grp") * shares + F.pmod(F.xxhash64("at"), F.lit(shares)).cast("int")).alias("cell"), F.lit(1).alias("kind"),
        F.lit(0.0).alias("place"), "at", "ids", F.coalesce("floors", none).alias("more"), "data")

    def cell(batches: Iterator[dict]) -> Iterator[tuple]:
        axes = shared.value[2]
        now, blocks = None, []
        for b in batches:
            for key, kind, at, ids, more, data in zip(*[b[c] for c in ("cell", "kind", "at", "ids", "more", "data")]):
                if key != now:
                    now, blocks = key, []
                if kind == 0:
                    blocks.append(Block(data, ids, more, at, axes, widths))
                    continue
                own, query_ids = np.frombuffer(at, np.int64), np.frombuffer(ids, np.int64)
                queries = Side(unpack(data).reshape(len(own), -1), axes, widths)
                yield _finds(scan(queries, own, blocks, np.frombuffer(more, np.int64), widths, k), own, query_ids)

    cells = held.unionByName(passing).repartitionById(max(1, len(limits)) * shares, "cell")
    found = map_columns(cells.sortWithinPartitions("cell", "kind", "place"), cell, FOUND).unionByName(
        asked.select(F.explode("found").alias("f")).select("f.*"))
    by = Window.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
with v as (
  select vec_id, row_number() over () as own,
         list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as e
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (
  select q.own, q.vec_id as query_id, p.vec_id, cast(list_inner_product(q.e, p.e) as bigint) as score
  from v q join v p on q.own <> p.own
  where q.vec_id % {EVERY} = 0)
select query_id, cast(row_number() over (partition by own order by score desc, vec_id nulls last) as integer) as rank,
       vec_id, score
from s qualify rank <= {K}"""
