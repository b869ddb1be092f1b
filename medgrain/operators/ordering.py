"""Orders, pages, ranks, splits and stable ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain.operators.skew import _sort_columns, join_null_safe, ranked, ranked_together


def ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Order with nulls last; ``-name`` is descending."""
    return df.orderBy(*_sort_columns(order))


def page(df: DataFrame, filters: dict[str, object], order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a filtered listing, each row with the total number of matches.

    The total is attached to the at most ``limit`` rows of the page; a page past the end is one row with the total only.
    """
    matched = df
    for name, value in filters.items():
        if value is not None:
            matched = matched.where(F.col(name) == value)
    total = matched.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("_one", F.lit(1))
    rows = ordered(matched, order).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    paged = F.broadcast(rows).join(total, "_one", "right").drop("_one")  # at most ``limit`` rows
    return ordered(paged, order)


def top_frequencies(df: DataFrame, column: str, k: int, out: str = "n") -> DataFrame:
    """The ``k`` most frequent values (ties: alphabetical)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.desc(out), F.asc(column)).limit(k)


def first_subjects(df: DataFrame, subject: str, n: int) -> DataFrame:
    """Rows of the ``n`` lowest subject ids; the id list has at most ``n`` rows."""
    ids = df.select(subject).distinct().orderBy(subject).limit(n)
    return df.join(F.broadcast(ids), subject, "left_semi")


def top_up(df: DataFrame, selected: Column, eligible: Column, order: Sequence[str], minimum: int,
           flag: str = "fallback_flag") -> DataFrame:
    """Flag the best eligible rows needed to bring the selection up to ``minimum``.

    At most ``minimum`` fallback rows can be needed, so the candidates are a top-k.
    """
    rows = df.withColumn("_selected", selected)
    have = rows.agg(F.coalesce(F.sum(F.col("_selected").cast("int")), F.lit(0)).alias("_have"))
    have = have.withColumn("_one", F.lit(1))
    best = ordered(rows.where(eligible & ~F.col("_selected")), order).limit(minimum)
    best = ranked(best, [], order, "_nth").withColumn("_one", F.lit(1))
    need = best.join(F.broadcast(have), "_one").where(F.col("_nth") <= minimum - F.col("_have"))
    extra = need.select(*df.columns, F.lit(1).alias(flag))
    return rows.where("_selected").select(*df.columns, F.lit(0).alias(flag)).unionByName(extra)


def event_ids(df: DataFrame, prefix: str, scope: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Stable ids: prefix, scope keys and the row's ordinal within the scope."""
    numbered = ranked(df, scope, order, "_ordinal")
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("na")) for k in scope]
    text = F.concat_ws("-", F.lit(prefix), *parts, (F.col("_ordinal") - 1).cast("string"))
    return numbered.select(*df.columns, text.alias(out))


def interleaved(df: DataFrame, level: str, group: str, order: Sequence[str], levels: Sequence[str], ids: Sequence[str],
                out: str = "position") -> DataFrame:
    """Rotate levels, and within a level prefer groups seen less often so far.

    A row's turn in its (level, group) comes first, then ``order``; rows then take rounds
    by level. ``ids`` name a row.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(level))
    placed = df.withColumn("_place", place).where("_place > 0")
    found = ranked_together(placed, ids, [
        ("_turn", [level, group], order), ("_round", [level], ["_turn", *order]), (out, [], ["_round", "_place", *order])])
    return found.select(*df.columns, out)


def split_subjects(subjects: DataFrame, subject: str, stratum: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """Assign whole subjects to parts, stratum by stratum, with largest-remainder counts.

    Subjects are ordered by a seeded hash, so the split does not depend on row order.
    """
    hashed = subjects.withColumn(
        "_hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(subject).cast("string")), 256)
    )
    placed = ranked(hashed, [stratum], ["_hash", subject], "_nth")
    sizes = subjects.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    names = list(fractions)
    raw = [F.col("_size") * F.lit(float(fractions[n])) for n in names]
    whole = [F.floor(r) for r in raw]
    left = F.col("_size") - sum(whole[1:], whole[0])
    by_remainder = F.array_sort(
        F.array(*[F.struct((-(r - w)).alias("f"), (-r).alias("r"), F.lit(i).alias("i"))
                  for i, (r, w) in enumerate(zip(raw, whole))])
    )
    extra = F.transform(F.slice(by_remainder, 1, F.greatest(left, F.lit(0)).cast("int")), lambda x: x["i"])
    counts = [w + F.array_contains(extra, i).cast("int") for i, w in enumerate(whole)]
    cuts = sizes.select(stratum, *[sum(counts[1:i + 1], counts[0]).alias(f"_cut{i}") for i in range(len(names))])
    joined = join_null_safe(placed, cuts, [stratum])
    part = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        part = F.when(F.col("_nth") <= F.col(f"_cut{i}"), F.lit(names[i])).otherwise(part)
    return joined.select(*subjects.columns, part.alias("split_partition"))


def subject_overlap(splits: DataFrame, subject: str, part: str) -> DataFrame:
    """Subjects found in more than one part."""
    span = splits.groupBy(subject).agg(F.min(part).alias("first_part"), F.max(part).alias("last_part"))
    return span.where(F.col("first_part") != F.col("last_part"))


def union_sources(frames: Sequence[DataFrame], schema: dict[str, str]) -> DataFrame:
    """Union of differing sources on one canonical, typed column list."""
    shaped = [
        f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
        for f in frames
    ]
    out = shaped[0]
    for f in shaped[1:]:
        out = out.unionByName(f)
    return out


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys lost from the left and extra on the right, each once."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    lost = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only"))
    extra = b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    return lost.unionByName(extra)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()
