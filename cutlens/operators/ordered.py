"""Ordered-data building blocks that stay parallel inside one very large entity.

A plain ``Window.partitionBy(entity)`` puts a whole entity into one task. When a single video
or project holds a large share of all rows that task never finishes, so every operator here
partitions by ``(entity, slice)`` instead, where a slice is a bounded range of positions or
times, and carries the little that must cross a slice edge explicitly:

* bounded frames (``lag``/``lead``/rolling means) copy the few edge rows into both slices;
* running sums, ranks and as-of lookups add one pre-aggregated carry row per slice.

The only per-entity windows left run over those carry rows, thousands of times fewer.

Slices cost shuffles. Where a caller knows by ``crowded`` that no entity has more rows than a slice, ``whole``
takes each entity as one: its rows are shuffled once, by the entity, and all that follows happens in place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cutlens.session import cut_lineage

SLICE_ROWS = 4096
#: Intervals of an entity up to which an instant may meet all of them.
FEW_INTERVALS = 64

Keys = Sequence[str]


def crowded(keys: Keys, *tables: tuple[DataFrame, int]) -> DataFrame | None:
    """Entities with more rows in one of ``tables`` than the number beside it, or None if there are none."""
    over = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*keys) for t, most in tables]
    found = cut_lineage(reduce(DataFrame.unionByName, over).distinct())
    return None if found.isEmpty() else found


def _known(*columns: str | Column) -> Column:
    """Holds where none is null: rows that the join of the sliced form would drop otherwise."""
    return reduce(Column.__and__, [(F.col(c) if isinstance(c, str) else c).isNotNull() for c in columns])


def positions(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "pos",
    whole: bool = False,
) -> DataFrame:
    """Zero-based rank of every row inside its entity.

    ``bucket`` must be a non-decreasing function of the sort order (a day of the timestamp, a
    leading digit of the key): rows are ranked inside ``(entity, bucket)`` and shifted by the
    row count of the entity's earlier buckets.
    """
    if whole:
        # rows without a bucket are left out, but count as the first ones, here as below
        every = Window.partitionBy(*keys).orderBy(bucket.isNotNull(), *order)
        ranked = df.filter(_known(*keys)).withColumn(out, (F.row_number().over(every) - 1).cast("bigint"))
        return ranked.filter(_known(bucket))
    tagged = df.withColumn("_in_bucket", bucket)
    counts = tagged.groupBy(*keys, "_in_bucket").agg(F.count(F.lit(1)).alias("_in_n"))
    before = Window.partitionBy(*keys).orderBy("_in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_in_bucket", F.coalesce(F.sum("_in_n").over(before), F.lit(0)).alias("_in_offset")
    )
    inside = Window.partitionBy(*keys, "_in_bucket").orderBy(*order)
    ranked = tagged.withColumn("_in_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*keys, "_in_bucket"])
        .withColumn(out, (F.col("_in_offset") + F.col("_in_rank")).cast("bigint"))
        .drop("_in_bucket", "_in_offset", "_in_rank")
    )


def with_neighbours(
    df: DataFrame,
    keys: Keys,
    pos: str,
    before: int,
    after: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    rows: int = SLICE_ROWS,
    whole: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` rows away.

    ``pos`` must be the dense rank of the row in its entity. Rows next to a slice edge are
    copied into the neighbouring slice, the windows run per slice, the copies are dropped.
    """
    if whole:
        return df.filter(_known(pos)).select("*", *[c.alias(n) for n, c in columns(Window.partitionBy(*keys).orderBy(pos)).items()])
    first = F.expr(f"greatest(0, {pos} - {after}) div {rows}")
    last = F.expr(f"({pos} + {before}) div {rows}")
    spread = df.withColumn("_slice", F.explode(F.sequence(first, last)))
    spec = Window.partitionBy(*keys, "_slice").orderBy(pos)
    added = [column.alias(name) for name, column in columns(spec).items()]
    return (
        spread.select("*", *added)
        .filter(F.col("_slice") == F.expr(f"{pos} div {rows}"))
        .drop("_slice")
    )


def running_sum(
    df: DataFrame,
    keys: Keys,
    pos: str,
    sums: Mapping[str, Column],
    inclusive: bool = True,
    rows: int = SLICE_ROWS,
    whole: bool = False,
) -> DataFrame:
    """Prefix sums in ``pos`` order (exclusive of the row itself if not ``inclusive``)."""
    names = list(sums)
    if whole:
        upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.filter(_known(*keys, pos)).select("*", *[F.coalesce(F.sum(sums[n]).over(upto), F.lit(0)).alias(n) for n in names])
    sliced = df.select("*", F.expr(f"{pos} div {rows}").alias("_slice"), *[sums[n].alias(f"_v_{n}") for n in names])
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_slice").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = sliced.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in names])
    joined = local.join(carry, [*keys, "_slice"])
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_c_{n}"), zero) + F.coalesce(F.col(f"_s_{n}"), zero)).alias(n) for n in names],
    )


def running_max(
    df: DataFrame, keys: Keys, pos: str, value: Column, out: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """Prefix maximum in ``pos`` order, the row itself included. Works for any orderable type."""
    sliced = df.select("*", F.expr(f"{pos} div {rows}").alias("_slice"), value.alias("_v"))
    tops = sliced.groupBy(*keys, "_slice").agg(F.max("_v").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_slice", F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_m", F.max("_v").over(inside))
    return local.join(carry, [*keys, "_slice"]).select(
        *df.columns, F.greatest("_carry", "_m").alias(out)
    )


def islands(df: DataFrame, keys: Keys, pos: str, member: Column, out: str = "run", rows: int = SLICE_ROWS) -> DataFrame:
    """Keep the rows where ``member`` holds and number each unbroken run of them (gaps and
    islands). The run number is the count of non-members before it, so it is unique per entity."""
    flagged = df.withColumn("_member", F.coalesce(member, F.lit(False)))
    numbered = running_sum(
        flagged, keys, pos, {out: F.when(F.col("_member"), 0).otherwise(1).cast("bigint")}, rows=rows
    )
    return numbered.filter("_member").drop("_member")


def with_entity(df: DataFrame, keys: Keys, *aggregates: Column) -> DataFrame:
    """Attach per-entity aggregates: a partial aggregate and a join, never a whole-entity window."""
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    at: str,
    values: Sequence[str],
    width: float,
    right_at: str | None = None,
    forward: bool = False,
) -> DataFrame:
    """Latest row of ``right`` at or before ``left.at`` (as ``prev_*``); with ``forward`` also the
    earliest at or after it (as ``next_*``).

    Both sides are cut into time cells of ``width``; a cell learns the last (first) right row of
    the cells before (after) it from one carry row per cell, so no pair of rows is ever emitted.
    """
    right_at = right_at or at
    payload = F.struct(F.col(right_at).cast("double").alias("t"), *[F.col(v).alias(v) for v in values])
    l = left.select(*keys, F.col(at).cast("double").alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    r = right.select(*keys, F.col(right_at).cast("double").alias("_t"), F.lit(None).alias("_l"), payload.alias("_r"))
    both = l.unionByName(r).withColumn("_cell", F.floor(F.col("_t") / width))
    cells = both.groupBy(*keys, "_cell").agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))
    over = Window.partitionBy(*keys).orderBy("_cell")
    carried = [F.last("_hi", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")]
    if forward:
        # looked at backwards: a growing frame costs one step a row, a shrinking one starts anew at each
        later = Window.partitionBy(*keys).orderBy(F.desc("_cell"))
        carried.append(F.last("_lo", True).over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    carry = cells.select(*keys, "_cell", *carried)
    # at equal times the right row sorts first, so "at or before" includes it
    back = Window.partitionBy(*keys, "_cell").orderBy("_t", F.col("_r").isNull(), "_r")
    found = [F.last("_r", True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev")]
    if forward:
        # min over this and the later rows, again backwards: right rows only, all at or after this one
        ahead = Window.partitionBy(*keys, "_cell").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)
        found.append(F.min("_r").over(ahead).alias("_next"))
    matched = both.select(*keys, "_cell", "_l", "_r", *found).filter("_l IS NOT NULL").join(carry, [*keys, "_cell"], "left")
    prev = F.coalesce("_prev", "_before")
    out = [F.col(f"_l.{c}").alias(c) for c in left.columns]
    out += [prev["t"].alias("prev_t"), *[prev[v].alias(f"prev_{v}") for v in values]]
    if forward:
        nxt = F.coalesce("_next", "_after")
        out += [nxt["t"].alias("next_t"), *[nxt[v].alias(f"next_{v}") for v in values]]
    return matched.select(*out)


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    at: str,
    values: Sequence[str] = (),
    tolerance: float | None = None,
    width: float = 60.0,
    right_at: str | None = None,
) -> DataFrame:
    """Nearest row of ``right`` in either direction; ties go to the earlier one.

    Adds ``near_t``, ``near_gap`` and ``near_<value>``, all null when nothing lies within
    ``tolerance``.
    """
    found = asof(left, right, keys, at, values, width, right_at, forward=True)
    back = F.col(at) - F.col("prev_t")
    ahead = F.col("next_t") - F.col(at)
    use_back = F.col("prev_t").isNotNull() & (F.col("next_t").isNull() | (back <= ahead))
    gap = F.when(use_back, back).otherwise(ahead)
    within = F.lit(True) if tolerance is None else gap <= tolerance
    picked = [F.when(within, F.when(use_back, F.col("prev_t")).otherwise(F.col("next_t"))).alias("near_t"),
              F.when(within, gap).alias("near_gap")]
    picked += [F.when(within, F.when(use_back, F.col(f"prev_{v}")).otherwise(F.col(f"next_{v}"))).alias(f"near_{v}") for v in values]
    return found.select(*left.columns, *picked)


def active_at(
    points: DataFrame,
    intervals: DataFrame,
    keys: Keys,
    at: str,
    start: str,
    end: str,
    width: float = 1.0,
    whole: bool = False,
) -> DataFrame:
    """Every interval with ``start <= at < end``.

    An interval is stored in cells of the size that fits its length, ``width`` times a power of two, so in two or
    three of them however long it is. An instant looks into one cell of each size that occurs (one row of at most
    some sixty numbers tells which), so it meets only intervals near it. Empty intervals hold no instant.
    With ``whole`` an instant meets all intervals of its entity, which must be few (``FEW_INTERVALS``).
    """
    length = F.col(end) - F.col(start)
    if whole:
        held = intervals.filter(length > 0).withColumnsRenamed({c: f"_of_{c}" for c in keys})
        match = [F.col(c) == F.col(f"_of_{c}") for c in keys]
        return points.join(held, [*match, F.col(at) >= F.col(start), F.col(at) < F.col(end)]).drop(*[f"_of_{c}" for c in keys])
    size = lambda level: width * F.pow(F.lit(2.0), level)
    level = F.when(length > width, F.ceil(F.log2(length / width))).otherwise(F.lit(0)).cast("int")
    sized = intervals.filter(length > 0).withColumn("_level", level)
    used = F.broadcast(sized.agg(F.array_sort(F.collect_set("_level")).alias("_levels"), F.lit(0).alias("_all")))
    cell = lambda t: F.floor(F.col(t) / size(F.col("_level")))
    spread = sized.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    probed = points.withColumn("_all", F.lit(0)).join(used, "_all").withColumn("_level", F.explode("_levels")).drop("_levels", "_all")
    probed = probed.withColumn("_cell", cell(at))
    held = spread.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, "_level", "_cell")})
    match = [F.col(c) == F.col(f"_of_{c}") for c in (*keys, "_level", "_cell")]
    joined = probed.join(held, match + [F.col(at) >= F.col(start), F.col(at) < F.col(end)])
    return joined.drop("_cell", "_level", *[f"_of_{c}" for c in (*keys, "_level", "_cell")])


def chain_members(links: DataFrame, heads: DataFrame, keys: Keys, max_rounds: int = 64) -> DataFrame:
    """Nodes reachable from ``heads`` when every node has at most one successor.

    ``links(keys, node, next)``, ``heads(keys, node)``. Pointer doubling: each round the known
    set also takes its ``2^r``-th successors, so a chain of n nodes needs log2(n) rounds, each a
    hash join on ``(keys, node)``.
    """
    names = [*keys, "node"]
    reached = cut_lineage(heads.select(*names).distinct())
    jump = cut_lineage(links.select(*names, "next").filter("next IS NOT NULL"))
    known = reached.count()
    for _ in range(max_rounds):
        step = reached.join(jump, names).select(*keys, F.col("next").alias("node"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        total = reached.count()
        if total == known:
            return reached
        known = total
        hop = jump.select(*keys, F.col("node").alias("next"), F.col("next").alias("_far"))
        jump = cut_lineage(jump.join(hop, [*keys, "next"]).select(*names, F.col("_far").alias("next")))
    raise RuntimeError(f"chain longer than 2^{max_rounds}")


def chain_roots(links: DataFrame, keys: Keys, max_rounds: int = 64) -> DataFrame:
    """Root of every node in a forest given ``links(keys, node, parent)`` with null at roots."""
    names = [*keys, "node"]
    state = cut_lineage(links.select(*names, F.coalesce("parent", "node").alias("root"), F.col("parent").isNull().alias("_done")))
    for _ in range(max_rounds):
        if state.filter("NOT _done").isEmpty():
            return state.drop("_done")
        up = state.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"), F.col("_done").alias("_top"))
        state = cut_lineage(
            state.join(up, [*keys, "root"]).select(
                *names, F.col("_up").alias("root"), (F.col("_done") | F.col("_top")).alias("_done")
            )
        )
    raise RuntimeError(f"chain longer than 2^{max_rounds}")


def walk_in_order(
    rows: DataFrame,
    keys: Keys,
    pos: str,
    walk: Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]],
    schema: str,
    rows_per_call: int = 20_000,
) -> DataFrame:
    """Run ``walk(rows, state)`` over each entity in ``pos`` order, for decisions that depend on
    every earlier one. Entities run in parallel; ``state`` is a small JSON-able dict.

    A call never sees more than ``rows_per_call`` rows of an entity: a longer one continues in the
    next round from the state the last round wrote. Short entities share a task group of about ``SLICE_ROWS``
    rows, so a group costs what its rows cost, however many entities there are. ``schema`` describes the rows
    ``walk`` returns, the keys included.
    """
    parted = cut_lineage(rows.withColumn("_part", F.expr(f"{pos} div {rows_per_call}")))
    last, held = parted.agg(F.max("_part"), F.count(F.lit(1))).first()
    last = last or 0
    names = list(keys)
    columns = [c.split()[0] for c in _fields(schema)]
    bundle = ["_bundle", "_nulls"]

    def bundled(df: DataFrame) -> DataFrame:
        # keys with nulls stay apart, so that pandas keeps the others' integers
        nulls = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in names])
        return df.withColumn("_bundle", F.pmod(F.xxhash64(*names), F.lit(held // SLICE_ROWS + 1))).withColumn("_nulls", nulls).groupBy(*bundle)

    def named(frame: pd.DataFrame) -> list[tuple]:
        return [tuple(None if pd.isna(v) else v for v in key) for key in frame[names].itertuples(index=False, name=None)]

    def bundle_call(more: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def call(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            states = dict(zip(named(right), right["_state"])) if len(right) else {}
            found, sizes, entities = [], [], []
            if len(left):
                codes = left.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
                order = np.lexsort((left[pos].to_numpy(), codes))
                left, codes = left.iloc[order].reset_index(drop=True), codes[order]
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                entities = named(left.iloc[starts])
                left = left.drop(columns=["_part", *bundle])
                for key, start, end in zip(entities, starts, [*starts[1:], len(left)]):
                    state = json.loads(states[key]) if key in states else None
                    out, state = walk(left.iloc[start:end], state)
                    found.append(out)
                    sizes.append(len(out))
                    if more:
                        states[key] = json.dumps(state)
            done = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns)
            for i, c in enumerate(names):
                done[c] = pd.Series([key[i] for key, n in zip(entities, sizes) for _ in range(n)], dtype=object)
            done["_state"] = None
            if more:  # also of entities without rows in this round
                closing = pd.DataFrame([dict(zip(names, key)) | {"_state": state} for key, state in states.items()])
                done = pd.concat([done.astype(object), closing.astype(object).reindex(columns=done.columns, fill_value=None)], ignore_index=True)
            return done[[*columns, "_state"]]

        return call

    kinds = dict(rows.dtypes)
    state = rows.sparkSession.createDataFrame([], ", ".join(f"{k} {kinds[k]}" for k in names) + ", _state string")
    found = None
    for part in range(last + 1):
        step = bundle_call(part < last)
        done = bundled(parted.filter(F.col("_part") == part)).cogroup(bundled(state)).applyInPandas(step, f"{schema}, _state string")
        if last:
            done = cut_lineage(done)
        state = done.filter("_state IS NOT NULL").select(*[F.col(c).cast(kinds[c]) for c in names], "_state")
        part_rows = done.filter("_state IS NULL").drop("_state")
        found = part_rows if found is None else found.unionByName(part_rows)
    return found


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, field = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(field.strip())
            field = ""
        else:
            field += ch
    return [*out, field.strip()]
