"""Matching assets to template slots.

``slots(project_id, slot_id, scene_idx, role, framing, framing_confidence, subject,
subject_confidence, source_kind, seconds, canvas_aspect)``, one row per scene;
``assets(project_id, asset_id, kind, aspect, asset_seconds, created_at, arrival)``;
``features(project_id, asset_id, framing, aesthetic, is_utility, sharpness, region, aspect,
faces, print)``. ``region`` and ``subject`` are rectangles; every feature may be null.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions.geometry import center_x, center_y, clamp, framing_index
from cutlens.functions.labels import feature_distance
from cutlens.operators.auction import cheapest_options
from cutlens.operators.ordered import positions, running_max, with_neighbours
from cutlens.operators.prints import close_prints
from cutlens.session import cut_lineage

PROJECT = ["project_id"]
SLOT = ["project_id", "slot_id"]
W = K.WEIGHTS
#: Prints of a cell from which it is dealt to blocks.
CELL_PRINTS = 1024


def visuals(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("kind").isin("image", "video"))


def of_kind(assets: DataFrame, kind: str) -> DataFrame:
    return assets.filter(F.col("kind") == kind)


def add_assets(pool: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append assets whose origin the pool does not hold yet; the first of several wins."""
    new = incoming.join(pool.select("project_id", "origin"), ["project_id", "origin"], "left_anti")
    firsts = new.groupBy("project_id", "origin").agg(F.min_by(F.struct(*new.columns), "arrival").alias("a")).select("a.*")
    return pool.unionByName(firsts.select(*pool.columns))


def missing_features(assets: DataFrame, features: DataFrame) -> DataFrame:
    return visuals(assets).join(features, ["project_id", "asset_id"], "left_anti")


def shortfall(slots: DataFrame, assets: DataFrame) -> DataFrame:
    """Slots a project cannot fill with a visual of its own."""
    need = slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("slots"))
    have = visuals(assets).groupBy("project_id").agg(F.count(F.lit(1)).alias("visuals"))
    both = need.join(have, "project_id", "left").withColumn("visuals", F.coalesce("visuals", F.lit(0)))
    return both.withColumn("shortfall", F.greatest(F.lit(0), F.col("slots") - F.col("visuals")))


def chrono_rank(assets: DataFrame) -> DataFrame:
    """Rank by creation date on 0..1, .5 for a lone asset; undated assets keep arrival order after
    the dated ones."""
    pool = visuals(assets)
    day = F.coalesce(F.unix_timestamp("created_at"), F.lit(253402300799)).cast("bigint")
    order = [F.col("created_at").asc_nulls_last(), "arrival"]
    ranked = positions(pool, PROJECT, order, F.floor(day / 86400 * 24), out="_rank")
    counts = pool.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(counts, "project_id").withColumn(
        "chrono", F.when(F.col("_n") > 1, F.try_divide(F.col("_rank").cast("double"), F.col("_n") - 1)).otherwise(F.lit(0.5))
    ).drop("_rank", "_n")


def pair_cost(s: str = "s", a: str = "a", f: str = "f") -> Column:
    """Cost of showing asset ``a`` (features ``f``) in slot ``s``; every term is non-negative."""
    col = lambda side, name: F.col(f"{side}.{name}")
    zero = F.lit(0.0)
    off = F.abs(framing_index(col(s, "framing")) - framing_index(col(f, "framing")))
    framing = F.when(col(f, "framing").isNull(), 0.3 * W["framing"]).otherwise(off * W["framing"] * col(s, "framing_confidence"))
    hero = col(s, "role") == "hero"
    by_role = F.when(hero, 2.2).when(col(s, "role").isin("opening", "closing"), 1.5).when(col(s, "seconds") < 0.5, 0.5).otherwise(1.0)
    looks = (1 - clamp((col(f, "aesthetic") + 1) / 2, 0.0, 1.0)) * W["aesthetics"] * by_role
    soft = (1 - col(f, "sharpness")) * W["softness"] * F.when(hero, 1.8).otherwise(1.0)
    dx = center_x(col(f, "region")) - center_x(col(s, "subject"))
    dy = center_y(col(f, "region")) - center_y(col(s, "subject"))
    subject = F.when(col(s, "subject_confidence") >= 0.4, F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy)) * W["subject"])
    have, want = F.coalesce(col(f, "aspect"), col(a, "aspect")), col(s, "canvas_aspect")
    crop = (1 - F.least(have, want) / F.greatest(have, want)) * W["aspect"]
    video = col(a, "kind") == "video"
    # a decimal product: one in doubles is off in its last bit, which would rank assets of equal cost
    still = float(Decimal(str(W["kind"])) * Decimal("0.4"))
    kind = F.when((col(s, "source_kind") == "video") & ~video, W["kind"]).when((col(s, "source_kind") == "image") & video, still).otherwise(0.0)
    short = video & (col(a, "asset_seconds") > 0) & (col(a, "asset_seconds") < col(s, "seconds"))
    footage = F.when(short, (col(s, "seconds") - col(a, "asset_seconds")) / F.greatest(col(s, "seconds"), F.lit(0.001)) * W["duration"]).otherwise(0.0)
    return (
        framing + F.coalesce(looks, zero) + F.when(col(f, "is_utility"), W["utility"]).otherwise(0.0) + F.coalesce(soft, zero)
        + F.coalesce(subject, zero) + crop + kind + footage
    )


def reason(s: str = "s", a: str = "a", f: str = "f", reused: Column | None = None) -> Column:
    """Why an asset sits in a slot, in words."""
    col = lambda side, name: F.col(f"{side}.{name}")
    name = F.when(col(f, "framing") == "closeUp", "close-up").otherwise(F.lower(col(f, "framing")))
    faces = col(f, "faces")
    parts = F.array_compact(F.array(
        F.when(col(f, "framing") == col(s, "framing"), F.concat(name, F.lit(" matches slot"))).otherwise(name),
        F.when(col(f, "aesthetic") > 0.35, "high quality"),
        F.when(col(f, "sharpness") < 0.35, "a little soft"),
        F.when(faces == 1, "face").when(faces > 1, F.concat(faces.cast("string"), F.lit(" faces"))),
        F.when(col(s, "role") == "hero", "best available for hero"),
        F.when(col(a, "kind") == "video", "video"),
        F.when(col(f, "is_utility"), "looks like a screenshot — swap it if you have a real photo"),
        F.when(reused if reused is not None else F.lit(False), "reused — add more photos to avoid"),
    ))
    return F.when(F.size(parts) == 0, "best remaining fit").otherwise(F.concat_ws(" · ", parts))


def slot_asset_costs(slots: DataFrame, assets: DataFrame, features: DataFrame) -> DataFrame:
    """Base cost of each slot with each of its project's visuals: one row per pair, the reference's
    cost matrix. The slots of a project are few, so this grows with the assets."""
    a = visuals(assets).alias("a")
    f = features.alias("f")
    left = a.join(f, (F.col("a.project_id") == F.col("f.project_id")) & (F.col("a.asset_id") == F.col("f.asset_id")), "left")
    return left.join(slots.alias("s"), F.col("a.project_id") == F.col("s.project_id")).select(
        F.col("s.project_id").alias("project_id"), F.col("s.slot_id").alias("slot_id"), F.col("s.scene_idx").alias("scene_idx"),
        F.col("a.asset_id").alias("asset_id"), pair_cost().alias("cost"), reason().alias("reason"),
    )


def rank_assets_for_slot(slots: DataFrame, assets: DataFrame, features: DataFrame, top: int | None = None) -> DataFrame:
    """Assets of every slot from best to worst. With ``top`` the ranking is cut map-side."""
    costs = slot_asset_costs(slots, assets, features)
    order = Window.partitionBy(*SLOT).orderBy("cost", "asset_id")
    if top is not None:
        return costs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    milli = F.floor(F.col("cost") * 64)
    return positions(costs, SLOT, ["cost", "asset_id"], milli, out="_pos").withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")


def near_duplicates(features: DataFrame, threshold: float = W["duplicate"]) -> DataFrame:
    """Pairs of a project's assets whose prints lie closer than ``threshold``.

    Close prints have close projections, so assets meet only inside cells of width ``threshold``
    along two fixed directions of the print, and the exact distance decides. Every pair within
    the threshold lies in one cell or in two adjacent ones, so nothing is missed; each two adjacent cells meet once.
    A cell of more than ``CELL_PRINTS`` prints is dealt to blocks, and each pair of blocks is a key of its own: no key
    meets more than about that many prints on either side, however many share a cell. Two blocks meet as matrix products.
    """
    def along(step: int) -> Column:
        # unit direction: alternate signs with period `step`
        signed = F.transform("print", lambda x, i: F.when((F.floor(i / step) % 2) == 0, x).otherwise(-x).cast("double"))
        return F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(F.size("print").cast("double"))

    # a print with a null has no distance
    whole = features.filter("project_id IS NOT NULL AND asset_id IS NOT NULL AND size(print) > 0 AND NOT exists(print, x -> x IS NULL)")
    cells = whole.select("project_id", "asset_id", "print", F.floor(along(1) / threshold).alias("_u"), F.floor(along(2) / threshold).alias("_v"))
    at = ["project_id", "_u", "_v"]
    sizes = cells.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / CELL_PRINTS).cast("int").alias("_parts"))
    ahead = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    other = sizes.select("project_id", F.col("_u").alias("_ou"), F.col("_v").alias("_ov"), F.col("_parts").alias("_others"))
    blocks = lambda last: F.explode(F.sequence(F.lit(0), last - 1))
    meets = sizes.withColumn("_to", F.explode(ahead)).select("*", (F.col("_u") + F.col("_to.u")).alias("_ou"), (F.col("_v") + F.col("_to.v")).alias("_ov")).drop("_to")
    meets = meets.join(other, ["project_id", "_ou", "_ov"]).withColumn("_a", blocks(F.col("_parts"))).withColumn("_b", blocks(F.col("_others")))
    meets = meets.withColumn("_own", (F.col("_u") == F.col("_ou")) & (F.col("_v") == F.col("_ov"))).filter("NOT _own OR _a <= _b")
    key = [*at, "_ou", "_ov", "_a", "_b"]

    dealt = cells.join(sizes, at).withColumn("_block", F.pmod(F.xxhash64("asset_id"), F.col("_parts")).cast("int")).drop("_parts")
    place = [*at, "_block"]
    first = meets.select(*key, F.col("_a").alias("_block"), F.lit(True).alias("_left"), (F.col("_own") & (F.col("_a") == F.col("_b"))).alias("_same"))
    second = meets.filter("NOT _own OR _a < _b").select(*key, F.col("_b").alias("_block"), F.lit(False).alias("_left"), F.lit(False).alias("_same"))
    left = dealt.join(first, place)
    right = dealt.withColumnsRenamed({"_u": "_ou", "_v": "_ov"}).join(second, ["project_id", "_ou", "_ov", "_block"])
    columns = [*key, "asset_id", "print", "_left", "_same"]
    kinds = dict(features.dtypes)
    found = left.select(*columns).unionByName(right.select(*columns)).groupBy(*key).applyInArrow(
        close_prints(threshold), f"project_id {kinds['project_id']}, a {kinds['asset_id']}, b {kinds['asset_id']}, distance double")
    return found.filter(F.col("distance") < threshold).select(
        "project_id", F.least("a", "b").alias("asset_id"), F.greatest("a", "b").alias("other_id"), "distance").filter("asset_id < other_id")


def _plan(slots: DataFrame, assets: DataFrame, locks: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pinned slots, open slots, and how often each project may use an asset."""
    if locks is None:
        locks = slots.select(*SLOT).withColumn("asset_id", F.lit(None)).limit(0).join(assets.select("project_id").limit(0), "project_id", "left_semi")
        locks = locks.withColumn("asset_id", F.col("asset_id").cast(dict(assets.dtypes)["asset_id"]))
    pinned = locks.join(slots.select(*SLOT, "scene_idx"), SLOT).join(assets.select("project_id", "asset_id"), ["project_id", "asset_id"], "left_semi")
    pinned = pinned.join(visuals(assets).select("project_id").distinct(), "project_id", "left_semi")  # without visuals nothing is assigned
    sizes = slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("_all"))
    open_slots = slots.join(pinned.select(*SLOT), SLOT, "left_anti")
    needs = open_slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("_open"))
    have = visuals(assets).groupBy("project_id").agg(F.count(F.lit(1)).alias("_have"))
    locked = pinned.groupBy("project_id").agg(F.lit(1).alias("_locked"))
    plan = needs.join(sizes, "project_id").join(have, "project_id").join(locked, "project_id", "left").withColumn(
        "_repeats", F.greatest(F.lit(1), F.ceil(F.col("_open") / F.col("_have")) + F.coalesce("_locked", F.lit(0))).cast("int"))
    return pinned, open_slots, cut_lineage(plan)


def option_costs(slots: DataFrame, assets: DataFrame, features: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Cost of every open slot with every use of its project's visuals: ``(project_id, slot_id, scene_idx, option,
    cost)``, an option being ``(reuse, arrival, asset_id)``. An asset may be used again for a price when a project has fewer
    assets than slots, or pins; one that is pinned starts as used."""
    pinned, open_slots, plan = _plan(slots, assets, locks)
    return _uses(open_slots, assets, features, pinned, plan, chrono_rank(assets).select("project_id", "asset_id", "chrono", "arrival"))


def _uses(open_slots, assets, features, pinned, plan, ranks) -> DataFrame:
    used = pinned.groupBy("project_id", "asset_id").agg(F.count(F.lit(1)).alias("_used"))
    place = F.col("scene_idx") / F.greatest(F.lit(1), F.col("_all") - 1)
    base = (
        slot_asset_costs(open_slots, assets, features).select(*SLOT, "scene_idx", "asset_id", "cost")
        .join(plan, "project_id").join(ranks, ["project_id", "asset_id"]).join(used, ["project_id", "asset_id"], "left")
        .withColumn("_base", F.col("cost") + F.abs(F.col("chrono") - place) * W["chronology"])
    )
    reuse = (F.col("_r") + F.coalesce("_used", F.lit(0))).cast("int")
    return base.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_repeats") - 1))).select(
        *SLOT, "scene_idx", F.struct(reuse.alias("reuse"), "arrival", "asset_id").alias("option"), (F.col("_base") + reuse * W["reuse"]).alias("cost"))


def likeness(a: Column, b: Column) -> Column:
    """Penalty for two picks side by side: the same asset, or prints closer than the duplicate distance."""
    apart = feature_distance(a["print"], b["print"])
    near = F.when(apart < W["duplicate"], (1 - apart / W["duplicate"]) * W["adjacent"])
    return F.when(a["asset_id"] == b["asset_id"], 2 * W["adjacent"]).otherwise(F.coalesce(near, F.lit(0.0)))


def vary(picks: DataFrame) -> DataFrame:
    """Exchange what two slots of a project show while that lowers cost plus the likeness of neighbours.

    ``picks(project_id, seed, k, pick, costs)``: ``k`` counts the slots in order, ``costs`` is what each pick of the
    project costs there, by the ``at`` of a pick ``(at, asset_id, print)``. A round takes one exchange a project and seed:
    for seed 0 the best one, for others the first in an order that follows from the seed, so that seeds end in
    different arrangements. Projects of two slots or fewer stay. Every exchange lowers the total, so rounds end: when no
    exchange is left that would.
    """
    keys = ["project_id", "seed"]
    # what has come to rest is set aside, so a round touches only what still moves
    state, rest = cut_lineage(picks.withColumn("moving", F.lit(True))), []
    while not state.isEmpty():
        sided = with_neighbours(state, keys, "k", 1, 1, lambda w: {"before": F.lag("pick").over(w), "after": F.lead("pick").over(w), "last": F.lead("k").over(w).isNull()})
        row = F.struct("k", "pick", "costs", "before", "after")
        x = sided.select(*keys, row.alias("x"))
        y = sided.select(*keys, row.alias("y"))
        X, Y = F.col("x"), F.col("y")
        cost = lambda slot, pick: F.element_at(slot["costs"], pick["at"] + 1)
        moved = cost(X, Y["pick"]) + cost(Y, X["pick"]) - cost(X, X["pick"]) - cost(Y, Y["pick"])
        outer = lambda a, b: likeness(X["before"], a) + likeness(b, Y["after"])
        inner = lambda a, b: likeness(a, X["after"]) + likeness(Y["before"], b)
        sides = outer(Y["pick"], X["pick"]) - outer(X["pick"], Y["pick"]) + F.when(
            Y["k"] - X["k"] > 1, inner(Y["pick"], X["pick"]) - inner(X["pick"], Y["pick"])).otherwise(F.lit(0.0))
        pairs = x.join(y, keys).filter((X["k"] < Y["k"]) & ~((X["k"] == 0) & (Y["k"] == 1) & Y["after"].isNull()))
        better = pairs.select(*keys, (moved + sides).alias("change"), X["k"].alias("kx"), Y["k"].alias("ky"), X["pick"].alias("px"), Y["pick"].alias("py")).filter("change < -1e-9")
        turn = F.when(F.col("seed") == 0, F.col("change")).otherwise(F.xxhash64("seed", "kx", "ky").cast("double"))
        chosen = better.groupBy(*keys).agg(F.min_by(F.struct("kx", "ky", "px", "py"), F.struct(turn, "kx", "ky")).alias("s"))
        pick = F.when(F.col("k") == F.col("s.kx"), F.col("s.py")).when(F.col("k") == F.col("s.ky"), F.col("s.px")).otherwise(F.col("pick"))
        turned = cut_lineage(state.join(chosen, keys, "left").select(*keys, "k", pick.alias("pick"), "costs", F.col("s").isNotNull().alias("moving"), *[c for c in picks.columns if c not in (*keys, "k", "pick", "costs")]))
        rest.append(turned.filter("NOT moving"))
        state = turned.filter("moving")
    return reduce(DataFrame.unionByName, rest or [state]).drop("moving")


def assign_assets(slots: DataFrame, assets: DataFrame, features: DataFrame, locks: DataFrame | None = None,
                  seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Cheapest assignment per project, then neighbour variety: one row per seed and slot.

    ``locks(project_id, slot_id, asset_id)`` pins slots. The assignment is an auction over all projects at once
    (``rounds``, and ``gap``: no assignment of the project is cheaper by more); the exchanges for variety start from it.
    """
    pinned, open_slots, plan = _plan(slots, assets, locks)
    ranks = cut_lineage(chrono_rank(assets).select("project_id", "asset_id", "chrono", "arrival"))
    solved = cut_lineage(cheapest_options(_uses(open_slots, assets, features, pinned, plan, ranks)))

    # variety is a question about the chosen options only, one per slot
    scenes = open_slots.select(*SLOT, "scene_idx")
    placed = cut_lineage(positions(solved.join(scenes, SLOT), PROJECT, ["scene_idx", "slot_id"], F.expr("scene_idx div 4096"), out="k"))
    prints = features.select("project_id", F.col("asset_id").alias("_asset"), F.transform("print", lambda v: v.cast("double")).alias("print"))
    named = placed.join(prints, (placed["project_id"] == prints["project_id"]) & (F.col("option.asset_id") == F.col("_asset")), "left").select(
        placed["project_id"], "option", F.struct(F.col("k").cast("int").alias("at"), F.col("option.reuse").alias("reuse"), F.col("option.asset_id").alias("asset_id"), "print").alias("pick"), "k")
    taken = placed.select("project_id", F.col("option.asset_id").alias("asset_id")).distinct()
    uses = _uses(open_slots, assets.join(taken, ["project_id", "asset_id"], "left_semi"), features, pinned, plan, ranks)
    table = uses.join(named.select("project_id", "option", F.col("k").alias("_at")), ["project_id", "option"]).groupBy(*SLOT).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "cost"))), lambda c: c["cost"]).alias("costs"))
    picks = placed.select(*SLOT, "k", "rounds", "gap").join(table, SLOT).join(named.drop("option"), ["project_id", "k"])
    varied = vary(picks.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds]))))
    refined = varied.select("project_id", "seed", "slot_id", F.col("pick.asset_id").alias("asset_id"), F.col("pick.reuse").alias("reuse"), F.element_at("costs", F.col("pick.at") + 1).alias("total"), "rounds", "gap")

    a, f, s = assets.alias("a"), features.alias("f"), slots.alias("s")
    r = refined.alias("r")
    same = lambda other: [F.col(f"r.project_id") == F.col(f"{other}.project_id"), F.col("r.asset_id") == F.col(f"{other}.asset_id")]
    out = (
        r.join(a, same("a")).join(f, same("f"), "left")
        .join(s, [F.col("r.project_id") == F.col("s.project_id"), F.col("r.slot_id") == F.col("s.slot_id")])
        .select("r.project_id", "r.seed", "r.slot_id", "s.scene_idx", "r.asset_id", "r.total",
                reason(reused=F.col("r.reuse") > 0).alias("reason"), F.lit(False).alias("locked"), "r.rounds", "r.gap")
    )
    pins = pinned.select(
        "project_id", F.explode(F.array(*[F.lit(x) for x in seeds])).alias("seed"), "slot_id", "scene_idx", "asset_id",
        F.lit(0.0).alias("total"), F.lit("pinned by you").alias("reason"), F.lit(True).alias("locked"), F.lit(0).alias("rounds"), F.lit(0.0).alias("gap"))
    return out.unionByName(pins)


def best_of_seeds(scored: DataFrame) -> DataFrame:
    """Pick a seed per project: later seeds count only while the best so far has repeat issues.

    ``scored(project_id, seed, total, repeats)`` with one row per seed. Each best so far is a strict
    running maximum, so the pick is the first of those without repeats, or else the last of them.
    """
    ordered = positions(scored.select("project_id", "seed", "total", "repeats"), PROJECT, ["seed"], F.expr("seed div 4096"))
    highest = running_max(ordered, PROJECT, "pos", F.struct(F.col("total"), (-F.col("pos")).alias("back")), "_top")
    record = F.col("_top")["back"] == -F.col("pos")
    settled = record & F.coalesce(F.col("repeats") <= 0, F.lit(True))
    run = F.struct("seed", "total", "repeats")
    best = highest.groupBy("project_id").agg(
        F.min_by(run, F.when(settled, F.col("pos"))).alias("first"), F.max_by(run, F.when(record, F.col("pos"))).alias("last"))
    return best.select("project_id", F.coalesce("first", "last").alias("b")).select("project_id", "b.*")
