"""Cheapest assignment of options to slots for many projects at once: small ones each by shortest paths, others by bids on offers.

``costs(project_id, slot_id, option, cost)`` is sparse: a slot can only take the options listed for it. Slots
make offers (the price table), options bid for them. A round is a few joins and aggregates over all projects, so a
project of any size is spread over tasks by its slots and options.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.session import cut_lineage

SLOT = ["project_id", "slot_id"]
#: Slots of a project up to which it is solved as one row of at most this number squared pairs.
SMALL_SLOTS = 64
#: First step, as a part of a project's spread of costs, and how many times smaller the next phase's is.
FIRST_STEP, SHRINK = 0.005, 8
#: Offers (about 100 bytes each) up to which they are broadcast; beyond, they are joined by key.
BROADCAST_SLOTS = 100_000


def cheapest_options(costs: DataFrame, precision: float = 1e-4, max_rounds: int = 100_000) -> DataFrame:
    """``(project_id, slot_id, option, cost, rounds, gap)``: a different option for each slot at least total cost.

    Projects of at most ``SMALL_SLOTS`` slots are solved apart, as many at once as there are tasks (``rounds`` is 1). The
    others meet in an auction. An idle option bids for the slot where it gains most, down to its gain at the second best (or to nothing) less
    a step; a slot takes its lowest bid, and who held it is idle again. Offers only fall, so a phase ends; if a slot
    found no option then, all offers of its project rise and the phase goes on. The next phase has a smaller step,
    offers a little higher, and keeps who still is at a best slot. ``gap`` is the distance of a project's total to the
    dual value of its offers: no assignment is cheaper by more. All projects go on until the largest is at most
    ``precision``; ``rounds`` is how many it took.

    A slot of a project with n slots can always do with one of its n cheapest options, so only those bid. Every slot
    must be able to get an option of its own; a project where that is impossible gets no rows. ``costs`` has a
    pair of slot and option once; null costs do not count. Without rows the result is empty.
    """
    known = costs.filter("cost IS NOT NULL").select(*SLOT, "option", F.col("cost").cast("double").alias("cost"))
    sizes = cut_lineage(known.groupBy("project_id").agg(F.count_distinct("slot_id").alias("_slots")))
    most = sizes.agg(F.max("_slots")).first()[0] or 0
    near = Window.partitionBy(*SLOT).orderBy("cost", "option")
    # the literal bound lets Spark cut the ranking before it is shuffled
    ranked = known.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= most).join(sizes, "project_id").filter("_rn <= _slots")
    # inside, an option goes by its text, which is plain to compare and to send
    named = cut_lineage(ranked.select(*SLOT, F.to_json(F.struct("option")).alias("option"), F.col("option").alias("_of"), "cost", "_slots"))
    small = _solved_apart(named.filter(F.col("_slots") <= SMALL_SLOTS))
    if most <= SMALL_SLOTS:
        return small
    return small.unionByName(_auction(named.filter(F.col("_slots") > SMALL_SLOTS), precision, max_rounds))


def _solved_apart(named: DataFrame) -> DataFrame:
    """Each project a row with its pairs in order, and the places of the pairs it takes."""
    cells = named.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("slot_id", "option", "cost", "_of"))).alias("_cells"))
    solve = F.pandas_udf(_solve, "picks array<int>, gap double")
    solved = cells.withColumn("_won", solve("_cells.slot_id", "_cells.option", "_cells.cost"))
    taken = F.explode(F.transform("_won.picks", lambda i: F.get("_cells", i)))
    return solved.select("project_id", taken.alias("c"), F.col("_won.gap").alias("gap")).select(
        "project_id", "c.slot_id", F.col("c._of").alias("option"), "c.cost", F.lit(1).alias("rounds"), "gap")


def _solve(slots: pd.Series, options: pd.Series, costs: pd.Series) -> pd.DataFrame:
    found = []
    for s, o, c in zip(slots, options, costs):
        at, options_of = (np.unique(np.asarray(side, dtype=object), return_inverse=True)[1] for side in (s, o))
        table = np.full((at.max() + 1, options_of.max() + 1), np.inf)
        table[at, options_of] = c
        won, gap = cheapest_columns(table)
        picks = [] if won is None else np.flatnonzero(won[at] == options_of)
        found.append((list(picks), gap))
    return pd.DataFrame(found, columns=["picks", "gap"])


def cheapest_columns(cost: np.ndarray) -> tuple[np.ndarray | None, float]:
    """A column of its own for each row at least total cost (infinite: not allowed), row by row along shortest
    augmenting paths, and how far the total is from its dual value. None if there is no such assignment."""
    n, m = cost.shape
    if n > m:
        return None, 0.0
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        far, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, reach, last = start, 0.0, -1
        while row >= 0:
            length = reach + cost[row] - u[row] - v
            nearer = ~done & (length < far)
            far[nearer], back[nearer] = length[nearer], last
            last = int(np.argmin(np.where(done, np.inf, far)))
            reach = far[last]
            if done[last] or not np.isfinite(reach):
                return None, 0.0
            done[last] = True
            row = owner[last]
        passed = done.copy()
        passed[last] = False
        u[owner[passed]] += reach - far[passed]
        u[start] += reach
        v[passed] -= reach - far[passed]
        while last >= 0:
            owner[last] = owner[back[last]] if back[last] >= 0 else start
            last = back[last]
    won = np.empty(n, dtype=int)
    won[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return won, max(0.0, float(cost[np.arange(n), won].sum() - u.sum() - v.sum()))


def _auction(named: DataFrame, precision: float, max_rounds: int) -> DataFrame:
    pairs = named.drop("_of")
    spans = pairs.groupBy("project_id").agg(F.greatest(F.max("cost") - F.min("cost"), F.lit(1e-3)).alias("_span"))
    possible = pairs.groupBy("project_id").agg(F.count_distinct("option").alias("_options"), F.first("_slots").alias("_n")).filter("_options >= _n").select("project_id")
    none = F.lit(None).cast("string")
    first = pairs.groupBy(*SLOT).agg(F.max("cost").alias("_top")).join(spans, "project_id").join(possible, "project_id", "left_semi")
    step, rounds = FIRST_STEP, 0
    state = cut_lineage(first.select(*SLOT, "_span", (F.col("_top") + step * F.col("_span")).alias("offer"), none.alias("option"), (step * F.col("_span")).alias("_lift")))
    few = state.count() <= BROADCAST_SLOTS
    settle = _held_by_driver if few else cut_lineage
    if state.isEmpty():
        return named.limit(0).select(*SLOT, F.col("_of").alias("option"), "cost", F.lit(0).alias("rounds"), F.lit(0.0).alias("gap"))
    while True:
        while True:
            state, rounds = settle(_round(pairs, state, step, few)), rounds + 1
            if rounds > max_rounds:
                raise RuntimeError(f"no rest after {rounds} rounds")
            if not state.filter("taken").isEmpty():
                continue
            empty = state.filter("option IS NULL").select("project_id").distinct()
            if empty.isEmpty():
                break
            lifted = state.join(empty.withColumn("_up", F.lit(True)), "project_id", "left")
            lift = F.when(F.col("_up"), 2 * F.col("_lift")).otherwise(F.col("_lift"))
            state = settle(lifted.select(*SLOT, "_span", F.when(F.col("_up"), F.col("offer") + lift).otherwise(F.col("offer")).alias("offer"), "option", lift.alias("_lift")))
        held = cut_lineage(state.join(pairs, [*SLOT, "option"]).select(*SLOT, "option", "cost"))
        gaps = cut_lineage(_gaps(pairs, state, held))
        if (gaps.agg(F.max("gap")).first()[0] or 0.0) <= precision:
            return held.join(named.select(*SLOT, "option", "_of"), [*SLOT, "option"]).join(gaps, "project_id").select(
                *SLOT, F.col("_of").alias("option"), "cost", F.lit(rounds).alias("rounds"), "gap")
        state, step = settle(_next_phase(pairs, state, step, step / SHRINK)), step / SHRINK


def _held_by_driver(state: DataFrame) -> DataFrame:
    """A price table of at most ``BROADCAST_SLOTS`` rows, which every task is sent anyway: cheaper than a checkpoint a round."""
    return state.sparkSession.createDataFrame(state.toArrow())


def _gaps(pairs: DataFrame, state: DataFrame, held: DataFrame) -> DataFrame:
    """Total less dual value: the offers, without what options could gain at them."""
    gains = pairs.join(state.select(*SLOT, "offer"), SLOT).groupBy("project_id", "option").agg(F.max(F.col("offer") - F.col("cost")).alias("_gain"))
    gained = gains.groupBy("project_id").agg(F.sum(F.greatest(F.col("_gain"), F.lit(0.0))).alias("_gains"))
    offers, totals = state.groupBy("project_id").agg(F.sum("offer").alias("_offers")), held.groupBy("project_id").agg(F.sum("cost").alias("_total"))
    gap = F.greatest(F.lit(0.0), F.col("_total") - F.col("_offers") + F.col("_gains"))
    return totals.join(offers, "project_id").join(gained, "project_id").select("project_id", gap.alias("gap"))


def _next_phase(pairs: DataFrame, state: DataFrame, step: float, smaller: float) -> DataFrame:
    """Offers raised by the last step; an option that is no longer within the smaller one of its best slot lets go."""
    gains = pairs.join(state.select(*SLOT, "offer"), SLOT).withColumn("_gain", F.col("offer") - F.col("cost"))
    best = gains.groupBy("project_id", "option").agg(F.max("_gain").alias("_best"))
    stays = state.select(*SLOT, "option", "_span").join(gains.select(*SLOT, "option", "_gain"), [*SLOT, "option"]).join(best, ["project_id", "option"])
    stays = stays.filter(F.col("_gain") >= F.col("_best") - smaller * F.col("_span")).select(*SLOT, F.col("option").alias("_kept"))
    lift = step * F.col("_span")
    return state.join(stays, SLOT, "left").select(*SLOT, "_span", (F.col("offer") + lift).alias("offer"), F.col("_kept").alias("option"), lift.alias("_lift"))


#: A round as one statement: it is planned some dozens of times.
_ROUND = """
SELECT project_id, slot_id, _span, coalesce(won.bid, offer) AS offer, coalesce(won.option, option) AS option, _lift, won IS NOT NULL AS taken FROM (
  SELECT project_id, slot_id, first(_span, true) AS _span, first(offer, true) AS offer, first(option, true) AS option, first(_lift, true) AS _lift, min(bid) AS won FROM (
    SELECT project_id, slot_id, _span, offer, option, _lift, NULL AS bid FROM {state}
    UNION ALL
    SELECT project_id, slot_id, NULL, NULL, NULL, NULL, named_struct('bid', bid, 'option', option) FROM (
      SELECT project_id, option, max(CASE WHEN rn = 1 THEN slot_id END) AS slot_id, max(CASE WHEN rn = 1 THEN cost END) + coalesce(max(CASE WHEN rn = 2 THEN gain END), 0) - %r * first(_span) AS bid FROM (
        SELECT /*+ %s(s) */ p.project_id, p.option, p.slot_id, p.cost, s._span, s.offer - p.cost AS gain,
          row_number() OVER (PARTITION BY p.project_id, p.option ORDER BY s.offer - p.cost DESC, p.slot_id) AS rn,
          max(coalesce(s.option = p.option, false)) OVER (PARTITION BY p.project_id, p.option) AS busy
        FROM {pairs} p JOIN {state} s ON p.project_id = s.project_id AND p.slot_id = s.slot_id)
      WHERE rn <= 2 AND gain > 0 AND NOT busy GROUP BY project_id, option))
  GROUP BY project_id, slot_id)"""


def _round(pairs: DataFrame, state: DataFrame, step: float, few: bool) -> DataFrame:
    """Offers and holders after all idle options have bid once; ``taken`` marks slots that took a bid."""
    return pairs.sparkSession.sql(_ROUND % (step, "BROADCAST" if few else "MERGE"), pairs=pairs, state=state)
