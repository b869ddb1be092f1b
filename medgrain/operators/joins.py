"""Linkage, lookup and enrichment joins. Join sizes are left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain.operators.skew import first_per_key, left_join_known


def equi(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def semi_to(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def anti_to(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                 validate: str = "many_to_one") -> DataFrame:
    """Equi-join whose right side (and left side for one_to_one) must be unique on the keys.

    The check is part of the plan: the right side is grouped on its keys and a group with
    more than one row raises, so no separate job is run. The group's guard is read above the
    join, so the optimizer cannot drop the check along with unused columns.
    """
    keys = list(keys)
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown cardinality: {validate}")
    right = unique_rows(right, keys, guard="_right_guard")
    if validate == "one_to_one":
        left = unique_rows(left, keys)
    checked = left.join(right, keys, how)
    return checked.where(F.coalesce("_right_guard", F.lit(0)) == 0).drop("_right_guard")


def unique_rows(df: DataFrame, keys: Sequence[str], guard: str | None = None) -> DataFrame:
    """The same rows, failing at run time when a key repeats; ``guard`` names the check's column, to be kept (0)."""
    rest = [c for c in df.columns if c not in keys]
    message = F.concat(F.lit("duplicate key on " + ",".join(keys) + ": "), F.concat_ws("|", *keys))
    check = F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("int")).otherwise(F.lit(0))
    # any_value of a struct keeps one row; the guard has already refused groups with more.
    grouped = df.groupBy(*keys).agg(F.any_value(F.struct(F.lit(1).alias("_one"), *rest)).alias("_row"),
                                    check.alias("_guard"))
    kept = grouped if guard else grouped.where(F.col("_guard") == 0)
    rows = kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "_guard")
    return rows.select(*df.columns, *[F.col("_guard").alias(g) for g in (guard,) if g])


def alignment_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``(both, left_only, right_only)`` of the key sets of two frames."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return sides.agg(
        one((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
        one((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        one((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
    )


def require_aligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one join of two frames; an unmatched key on either side is a run-time error."""
    keys = list(keys)
    l = unique_rows(left, keys).withColumn("_l", F.lit(1))
    r = unique_rows(right, keys).withColumn("_r", F.lit(1))
    joined = l.join(r, keys, "full_outer")
    lost = F.col("_l").isNull() | F.col("_r").isNull()
    guard = F.when(lost, F.raise_error(F.lit("unaligned key")).cast("int")).otherwise(F.lit(1))
    return joined.where(guard == 1).drop("_l", "_r")


def first_lookup(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of lookup tables, the earlier table winning per key."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(union, keys, ["_source", *order]).drop("_source")


def enrich_best_match(left: DataFrame, right: DataFrame, on: Sequence[str], row_key: str, residual: Column,
                      fill: dict[str, str], tie: Sequence[str]) -> DataFrame:
    """Left join to the most complete matching right row, filling only blank left fields.

    ``residual`` sits in the join condition (columns are prefixed ``l.`` and ``r.``), so a
    left row without an acceptable match is kept as it is. ``fill`` maps left column to
    right column; completeness is the number of non-null fill fields.
    """
    l, r = left.alias("l"), right.alias("r")
    complete = reduce(lambda a, b: a + b, [F.col(f"r.{c}").isNotNull().cast("int") for c in fill.values()])
    pairs = l.join(r, equi(on) & residual, "inner").select(
        F.col(f"l.{row_key}").alias(row_key),
        complete.alias("_complete"),
        *[F.col(f"r.{c}").alias(f"_f_{a}") for a, c in fill.items()],
        *[F.col(f"r.{t}").alias(f"_t_{i}") for i, t in enumerate(tie)],
    )
    best = first_per_key(pairs, [row_key], ["-_complete", *[f"_t_{i}" for i in range(len(tie))]])
    joined = left.join(best, row_key, "left")
    filled = {
        a: F.coalesce(F.nullif(F.col(a), F.lit("")) if dict(left.dtypes)[a] == "string" else F.col(a), F.col(f"_f_{a}"))
        for a in fill
    }
    applied = F.when(F.coalesce(F.col("_complete"), F.lit(0)) > 0, 1).otherwise(0)
    return joined.select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in left.columns],
        applied.alias("order_enrichment_applied_flag"),
    )


def attach_detail(admin: DataFrame, detail: DataFrame, on: Sequence[str], fields: Sequence[str], event_id: str,
                  order: Sequence[str]) -> DataFrame:
    """Detail fan-out cut back to one row per event in an explicit order, with a match flag."""
    joined = admin.join(detail, list(on), "left")
    any_field = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fields])
    flagged = joined.withColumn("detail_match_flag", any_field.cast("int"))
    return first_per_key(flagged, [event_id], order).select(*admin.columns, *fields, "detail_match_flag")


def apply_mapping(events: DataFrame, mapping: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to a mapping that is unique on ``key``; unresolved columns take defaults.

    A default that names a column of the events (``"col:name"``) falls back to it.
    """
    joined = events.join(mapping, key, "left")

    def fallback(value: object) -> Column:
        return F.col(value[4:]) if isinstance(value, str) and value.startswith("col:") else F.lit(value)

    return joined.select(
        *events.columns,
        *[F.coalesce(F.col(c), fallback(defaults[c])).alias(c) if c in defaults else F.col(c)
          for c in mapping.columns if c != key],
    )


def reenrich(state: DataFrame, mapping: DataFrame, key: str, fields: Sequence[str], enriched: Column,
             resolved: str) -> DataFrame:
    """Replace fields from a new mapping unless that would downgrade an enriched row."""
    renamed = mapping.select(key, resolved, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = state.join(renamed, key, "left")
    use = F.coalesce(F.col(resolved) == 1, F.lit(False)) | ~enriched
    use = use & F.col(resolved).isNotNull()
    return joined.select(
        *[F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
          for c in state.columns],
        use.cast("int").alias("mapping_used_flag"),
    )


def exists_either(df: DataFrame, first: DataFrame, second: DataFrame, first_keys: Sequence[str],
                  second_keys: Sequence[str]) -> DataFrame:
    """Add 0/1 ``in_first`` and ``in_second`` from two distinct key sets; rows with null keys meet in no one task."""
    a = first.select(*first_keys).dropna().distinct().withColumn("in_first", F.lit(1))
    b = second.select(*second_keys).dropna().distinct().withColumn("in_second", F.lit(1))
    joined = left_join_known(left_join_known(df, a, first_keys), b, second_keys)
    return joined.fillna(0, ["in_first", "in_second"])


def fallback_match(left: DataFrame, right: DataFrame, row_key: str, passes: Sequence[tuple[Sequence[str], Sequence[str]]],
                   order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Match on the first pass that hits; within a pass the best right row in ``order``.

    Each pass first reduces the right side to its best row per pass key, so a pass joins
    many left rows to one right row and never lists all candidates.
    """
    found = left
    picked: list[str] = []
    for i, (left_keys, right_keys) in enumerate(passes):
        best = first_per_key(right.dropna(subset=list(right_keys)), list(right_keys), order, payload)
        best = best.select(
            *[F.col(k).alias(f"_k{i}_{j}") for j, k in enumerate(right_keys)],
            F.struct(F.lit(i + 1).alias("match_pass"), *payload).alias(f"_hit{i}"),
        )
        on = [F.col(k) == F.col(f"_k{i}_{j}") for j, k in enumerate(left_keys)]
        found = found.join(best, reduce(lambda a, b: a & b, on), "left").drop(*[f"_k{i}_{j}" for j in range(len(on))])
        picked.append(f"_hit{i}")
    hit = F.coalesce(*picked)
    return found.withColumn("_hit", hit).select(
        *left.columns, F.col("_hit.match_pass").alias("match_pass"), *[F.col(f"_hit.{p}").alias(p) for p in payload]
    )


def resolve_unique(rows: DataFrame, universe: DataFrame, row_key: str, scope: Sequence[str], grain: str,
                   methods: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Trace a display row to exactly one grain key, trying methods in order.

    ``methods`` holds ``(method name, row column, universe column)``. A method counts only
    when all its hits share one grain key; several grains make the row unresolved.
    Distinctness per match value is a min/max pair, so nothing is gathered.
    """
    out = rows
    picks, blocked = [], F.lit(False)
    for i, (method, row_column, universe_column) in enumerate(methods):
        keys = universe.select(*scope, F.col(universe_column).alias(f"_u{i}"), grain).dropna(subset=[f"_u{i}"])
        span = keys.groupBy(*scope, f"_u{i}").agg(F.min(grain).alias(f"_lo{i}"), F.max(grain).alias(f"_hi{i}"))
        right = span.select(*[F.col(s).alias(f"_s{i}_{s}") for s in scope], f"_u{i}", f"_lo{i}", f"_hi{i}")
        on = reduce(lambda a, b: a & b, [F.col(s) == F.col(f"_s{i}_{s}") for s in scope]) & (
            F.col(row_column) == F.col(f"_u{i}")
        )
        out = out.join(right, on, "left").drop(f"_u{i}", *[f"_s{i}_{s}" for s in scope])
        unique = (F.col(f"_lo{i}") == F.col(f"_hi{i}")) & ~blocked
        picks.append(F.when(unique, F.struct(F.col(f"_lo{i}").alias("key"), F.lit(method).alias("method"))))
        blocked = blocked | F.coalesce(F.col(f"_lo{i}") != F.col(f"_hi{i}"), F.lit(False))
    chosen = F.coalesce(*picks)
    return out.withColumn("_pick", chosen).select(
        *rows.columns,
        F.col("_pick.key").alias("resolved_key"),
        F.coalesce(F.col("_pick.method"), F.lit("unresolved")).alias("resolution_method"),
    )


def overlay(queue: DataFrame, latest: DataFrame, keys: Sequence[str], fields: Sequence[str], flag: str) -> DataFrame:
    """Refresh review fields of a frozen queue; membership and rank stay as they are."""
    kept = [c for c in queue.columns if c not in fields and c != flag]
    joined = queue.select(*kept).join(
        latest.select(*keys, *fields, F.lit(1).alias("_hit")), list(keys), "left"
    )
    return joined.select(*kept, *fields, F.coalesce("_hit", F.lit(0)).alias(flag))


def assemble(base: DataFrame, required: dict[str, DataFrame], optional: dict[str, DataFrame],
             keys: Sequence[str]) -> DataFrame:
    """One-to-one assembly on the grain; a required frame must match every base row."""
    keys = list(keys)
    out = unique_rows(base, keys)
    for name, frame in required.items():
        tag = f"_m_{name}"
        joined = out.join(unique_rows(frame, keys).withColumn(tag, F.lit(1)), keys, "left")
        message = F.lit(f"missing row in {name}")
        guard = F.when(F.col(tag).isNull(), F.raise_error(message).cast("int")).otherwise(F.lit(1))
        out = joined.where(guard == 1).drop(tag)
    for name, frame in optional.items():
        marked = unique_rows(frame, keys).withColumn(f"{name}_available_flag", F.lit(1))
        out = out.join(marked, keys, "left").fillna(0, [f"{name}_available_flag"])
    return out
