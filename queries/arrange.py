"""Assets, slots and their assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.operators import assign
from cutlens.operators.auction import cheapest_options
from cutlens.operators.ordered import positions
from cutlens.plans.arrange_and_bind import REPEAT_SEEDS
from cutlens.sources import adapters as A
from queries.common import r6, registry, s6

JOBS, SQL, register = registry()

POOL = """slots AS (SELECT CAST(n_regionkey AS BIGINT) AS project_id, 'slot_' || n_nationkey AS slot_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS scene_idx, count(*) OVER (PARTITION BY n_regionkey) AS n_slots,
  ['opening','body','detail','hero','closing','wide'][n_nationkey % 6 + 1] AS role, n_nationkey % 3 AS fi, 0.3 + (n_nationkey % 4) * 0.2 AS fc, (n_nationkey % 5) / 10.0 + 0.15 AS sx, (n_nationkey % 7) / 10.0 + 0.15 AS sy, 0.2e0 + (n_nationkey % 3) * 0.2e0 AS sc,
  n_nationkey % 3 AS sk, 0.3e0 + (n_nationkey % 6) * 0.4e0 AS seconds FROM nation),
pool AS (SELECT CAST(n_regionkey AS BIGINT) AS project_id, s_suppkey AS asset_id, CASE WHEN s_suppkey % 9 = 8 THEN 'audio' WHEN s_suppkey % 3 = 0 THEN 'video' ELSE 'image' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 4000 / 3000 ELSE 3000 / 4000 END AS aspect,
  CASE WHEN s_suppkey % 9 <> 8 AND s_suppkey % 3 <> 0 THEN 0 ELSE (s_suppkey % 8) * 0.5e0 END AS secs, CASE WHEN s_suppkey % 10 <> 7 THEN (s_suppkey * 37) % 365 END AS dated, 'lib/' || (s_suppkey % 80) AS origin, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
visuals AS (SELECT * FROM pool WHERE kind <> 'audio'),
feats AS (SELECT project_id, asset_id, CASE WHEN asset_id % 5 <> 0 THEN CASE WHEN (asset_id % 7) / 10.0 >= 0.45 THEN 0 WHEN (asset_id % 7) / 10.0 >= 0.18 THEN 1 ELSE 2 END END AS fi, CASE WHEN asset_id % 4 <> 1 THEN (CAST(floor(s_acctbal) AS BIGINT) % 200) / 100.0 - 1 END AS aes,
  asset_id % 11 = 0 AS util, CASE WHEN asset_id % 6 <> 2 THEN (asset_id % 20) / 20.0 END AS sharp, CASE WHEN asset_id % 5 <> 0 THEN (asset_id % 4) / 10.0 + 0.2 END AS rx, CASE WHEN asset_id % 5 <> 0 THEN (asset_id % 3) / 10.0 + 0.25 END AS ry, asset_id % 3 AS faces FROM pool WHERE asset_id % 13 <> 5)"""
COSTS = POOL + """,
pairs AS (SELECT s.project_id, s.slot_id, s.scene_idx, s.role, s.fi AS want, v.asset_id, v.kind, f.fi AS have, f.aes, f.sharp, f.util, f.faces,
  CASE WHEN f.fi IS NULL THEN 0.3 ELSE abs(s.fi - f.fi) * s.fc END
  + coalesce((1 - least(1, greatest(0, (f.aes + 1) / 2))) * 0.8 * CASE WHEN s.role = 'hero' THEN 2.2 WHEN s.role IN ('opening', 'closing') THEN 1.5 WHEN s.seconds < 0.5 THEN 0.5 ELSE 1 END, 0)
  + CASE WHEN f.util THEN 4.5 ELSE 0 END + coalesce((1 - f.sharp) * 0.45 * CASE WHEN s.role = 'hero' THEN 1.8 ELSE 1 END, 0)
  + coalesce(CASE WHEN s.sc >= 0.4 THEN least(1, sqrt(power(f.rx - s.sx, 2) + power(f.ry - s.sy, 2))) * 0.2 END, 0)
  + CASE WHEN v.aspect > 0.5625 THEN 1 - 0.5625 / v.aspect ELSE 1 - v.aspect / 0.5625 END * 0.5
  + CASE WHEN s.sk = 1 AND v.kind <> 'video' THEN 0.35 WHEN s.sk = 0 AND v.kind = 'video' THEN 0.35 * 0.4 ELSE 0 END
  + CASE WHEN v.kind = 'video' AND v.secs > 0 AND v.secs < s.seconds THEN (s.seconds - v.secs) / greatest(s.seconds, 0.001) * 1.2 ELSE 0 END AS cost
  FROM slots s JOIN visuals v USING (project_id) LEFT JOIN feats f ON f.project_id = v.project_id AND f.asset_id = v.asset_id)"""


def _tables(spark, sf):
    return A.slots(spark, sf), A.assets(spark, sf), A.features(spark, sf)


@register("pair_cost", f"WITH {COSTS} SELECT project_id, slot_id, asset_id, {s6('cost', 'cost')} FROM pairs")
def _(spark, sf):
    return assign.slot_asset_costs(*_tables(spark, sf)).select("project_id", "slot_id", "asset_id", r6("cost").alias("cost"))


@register("rank_assets_for_slot", f"WITH {COSTS} SELECT project_id, slot_id, asset_id, CAST(row_number() OVER (PARTITION BY project_id, slot_id ORDER BY cost, asset_id) AS INT) AS rank FROM pairs")
def _(spark, sf):
    return assign.rank_assets_for_slot(*_tables(spark, sf)).select("project_id", "slot_id", "asset_id", "rank")


@register("assignment_reason", f"""WITH {COSTS} SELECT project_id, slot_id, asset_id, coalesce(nullif(concat_ws(' · ', CASE WHEN have IS NOT NULL THEN ['close-up', 'medium', 'wide'][have + 1] || CASE WHEN have = want THEN ' matches slot' ELSE '' END END,
  CASE WHEN aes > 0.35 THEN 'high quality' END, CASE WHEN sharp < 0.35 THEN 'a little soft' END, CASE WHEN faces = 1 THEN 'face' WHEN faces > 1 THEN faces || ' faces' END, CASE WHEN role = 'hero' THEN 'best available for hero' END,
  CASE WHEN kind = 'video' THEN 'video' END, CASE WHEN util THEN 'looks like a screenshot — swap it if you have a real photo' END), ''), 'best remaining fit') AS reason FROM pairs""")
def _(spark, sf):
    return assign.slot_asset_costs(*_tables(spark, sf)).select("project_id", "slot_id", "asset_id", "reason")


@register("asset_kinds", f"WITH {POOL} SELECT project_id, kind, count(*) AS assets FROM pool GROUP BY 1, 2")
def _(spark, sf):
    a = A.assets(spark, sf)
    kinds = [assign.of_kind(a, k) for k in ("image", "video", "audio")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("assets"))


@register("add_assets", f"""WITH {POOL}, old AS (SELECT * FROM pool WHERE asset_id % 2 = 0), new AS (SELECT * FROM pool WHERE asset_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.project_id = pool.project_id AND old.origin = pool.origin))
SELECT project_id, asset_id FROM old UNION ALL SELECT project_id, min(asset_id) FROM new GROUP BY project_id, origin""")
def _(spark, sf):
    a = A.assets(spark, sf)
    return assign.add_assets(a.filter("asset_id % 2 = 0"), a.filter("asset_id % 2 = 1")).select("project_id", "asset_id")


@register("missing_features", f"WITH {POOL} SELECT v.project_id, v.asset_id FROM visuals v LEFT JOIN feats f ON f.asset_id = v.asset_id WHERE f.asset_id IS NULL")
def _(spark, sf):
    _, a, f = _tables(spark, sf)
    return assign.missing_features(a, f).select("project_id", "asset_id")


@register("shortfall", """WITH s AS (SELECT c_nationkey AS project_id, count(*) AS slots FROM customer GROUP BY 1), a AS (SELECT s_nationkey AS project_id, count(*) AS visuals FROM supplier WHERE s_suppkey % 9 <> 8 GROUP BY 1)
SELECT CAST(s.project_id AS BIGINT) AS project_id, slots, coalesce(visuals, 0) AS visuals, greatest(0, slots - coalesce(visuals, 0)) AS shortfall FROM s LEFT JOIN a USING (project_id)""")
def _(spark, sf):
    s = A.table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("project_id"))
    a = A.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("project_id"), F.when(F.col("s_suppkey") % 9 == 8, "audio").otherwise("image").alias("kind"))
    return assign.shortfall(s, a).select("project_id", "slots", "visuals", "shortfall")


@register("chrono_rank", f"""WITH {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY dated NULLS LAST, asset_id) - 1 AS rk, count(*) OVER (PARTITION BY project_id) AS n FROM visuals)
SELECT project_id, asset_id, {s6('CASE WHEN n > 1 THEN rk / (n - 1) ELSE 0.5 END', 'chrono')} FROM r""")
def _(spark, sf):
    return assign.chrono_rank(A.assets(spark, sf)).select("project_id", "asset_id", r6("chrono").alias("chrono"))


@register("near_duplicates", f"""WITH e AS (SELECT label AS project_id, vec_id AS asset_id, embedding FROM embeddings), p AS (SELECT a.project_id, a.asset_id, b.asset_id AS other_id,
  sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(CAST(z[1] - z[2] AS DOUBLE), 2)))) AS d FROM e a JOIN e b ON b.project_id = a.project_id AND a.asset_id < b.asset_id)
SELECT CAST(project_id AS BIGINT) AS project_id, asset_id, other_id, {s6('d', 'distance')} FROM p WHERE d < 1.1""")
def _(spark, sf):
    f = A.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("project_id"), F.col("vec_id").alias("asset_id"), F.col("embedding").alias("print"))
    return assign.near_duplicates(f, 1.1).select("project_id", "asset_id", "other_id", r6("distance").alias("distance"))


def _assigned(spark, sf, seeds=(0,)):
    slots, assets, features = _tables(spark, sf)
    locks = slots.filter("scene_idx = 1").join(assets.groupBy("project_id").agg(F.min("asset_id").alias("asset_id")), "project_id").select("project_id", "slot_id", "asset_id")
    return assign.assign_assets(slots, assets, features, locks, seeds)


# every way to fill the open slots of a project from each slot's cheapest options, one slot after the other
CHEAPEST = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, slot_id ORDER BY cost, opt) AS rn FROM options) WHERE rn <= n),
fill AS (SELECT project_id, n, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS opts, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT project_id, n FROM near)
  UNION ALL SELECT f.project_id, f.n, f.k + 1, list_append(f.opts, o.opt), f.total + o.cost FROM fill f JOIN near o ON o.project_id = f.project_id AND o.k = f.k AND NOT list_contains(f.opts, o.opt)),
least AS (SELECT project_id, n, arg_min(opts, total) AS opts, min(total) AS total FROM fill WHERE k = n GROUP BY 1, 2)"""


@register("assign_assets", f"""WITH RECURSIVE {COSTS},
ranks AS (SELECT project_id, asset_id, CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER (PARTITION BY project_id ORDER BY dated NULLS LAST, asset_id) - 1) / (count(*) OVER p - 1) ELSE 0.5 END AS chrono FROM visuals WINDOW p AS (PARTITION BY project_id)),
pins AS (SELECT s.project_id, s.slot_id, m.asset_id FROM slots s JOIN (SELECT project_id, min(asset_id) AS asset_id FROM pool GROUP BY 1) m USING (project_id) WHERE s.scene_idx = 1),
opens AS (SELECT s.project_id, s.slot_id, row_number() OVER (PARTITION BY s.project_id ORDER BY scene_idx) - 1 AS k, count(*) OVER (PARTITION BY s.project_id) AS n, s.scene_idx / greatest(1, n_slots - 1) AS place FROM slots s WHERE scene_idx <> 1),
options AS (SELECT o.project_id, o.slot_id, o.k, o.n, p.asset_id || '/' || r.reuse AS opt, p.cost + abs(c.chrono - o.place) * 0.3 + (r.reuse + CASE WHEN p.asset_id = x.asset_id THEN 1 ELSE 0 END) * 2.5 AS cost
  FROM opens o JOIN pairs p ON p.project_id = o.project_id AND p.slot_id = o.slot_id JOIN ranks c ON c.project_id = p.project_id AND c.asset_id = p.asset_id JOIN pins x ON x.project_id = o.project_id, (SELECT unnest([0, 1]) AS reuse) r),
{CHEAPEST},
won AS (SELECT o.* FROM least l JOIN options o ON o.project_id = l.project_id AND o.opt = l.opts[o.k + 1])
SELECT project_id, slot_id, asset_id, {s6('cost', 'total')}, coalesce(nullif(concat_ws(' · ', CASE WHEN have IS NOT NULL THEN ['close-up', 'medium', 'wide'][have + 1] || CASE WHEN have = want THEN ' matches slot' ELSE '' END END,
  CASE WHEN aes > 0.35 THEN 'high quality' END, CASE WHEN sharp < 0.35 THEN 'a little soft' END, CASE WHEN faces = 1 THEN 'face' WHEN faces > 1 THEN faces || ' faces' END, CASE WHEN role = 'hero' THEN 'best available for hero' END,
  CASE WHEN kind = 'video' THEN 'video' END, CASE WHEN util THEN 'looks like a screenshot — swap it if you have a real photo' END, CASE WHEN again THEN 'reused — add more photos to avoid' END), ''), 'best remaining fit') AS reason, false AS locked, true AS proven FROM
  (SELECT project_id, slot_id, asset_id, have, want, aes, sharp, faces, role, kind, util, again, cost FROM (SELECT w.project_id, w.slot_id, w.cost, p.asset_id, p.have, p.want, p.aes, p.sharp, p.faces, p.role, p.kind, p.util, CAST(split_part(w.opt, '/', 2) AS INT) + CASE WHEN p.asset_id = x.asset_id THEN 1 ELSE 0 END > 0 AS again
   FROM won w JOIN pairs p ON p.project_id = w.project_id AND p.slot_id = w.slot_id AND p.asset_id = CAST(split_part(w.opt, '/', 1) AS BIGINT) JOIN pins x ON x.project_id = w.project_id))
UNION ALL SELECT project_id, slot_id, asset_id, 0, 'pinned by you', true, true FROM pins""")
def assign_assets(spark, sf):
    """No two prints of the table are near, and no asset is worth its price twice: the exchanges leave this assignment."""
    return _assigned(spark, sf).select("project_id", "slot_id", "asset_id", r6("total").alias("total"), "reason", "locked", (F.col("gap") <= 1e-4).alias("proven"))


def _reused(spark, sf):
    """Customers of a nation are slots, its few suppliers the assets, so assets repeat."""
    c = A.table(spark, sf, "customer")
    k = F.col("c_custkey")
    pick = lambda names, e: F.get(F.array(*[F.lit(v) for v in names]), (e % len(names)).cast("int"))
    base = c.select((F.expr("c_custkey div 12") * 100 + F.col("c_nationkey") % 4).cast("bigint").alias("project_id"), k.alias("k"))
    slots = positions(base, ["project_id"], ["k"], F.expr("k div 64"), out="scene_idx").select(
        "project_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("slot_id"), "scene_idx", pick(["opening", "body", "hero"], F.col("k")).alias("role"), pick(["closeUp", "medium", "wide"], F.col("k")).alias("framing"),
        F.lit(0.8).alias("framing_confidence"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("subject"), F.lit(0.0).alias("subject_confidence"), F.lit("unknown").alias("source_kind"), F.lit(1.0).alias("seconds"), F.lit(0.5625).alias("canvas_aspect"))
    projects = slots.select("project_id").distinct()
    assets = projects.withColumn("asset_id", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>"))).select(
        "project_id", "asset_id", F.lit("image").alias("kind"), (0.5 + F.col("asset_id") * 0.2).alias("aspect"), F.lit(0.0).alias("asset_seconds"), F.lit(None).cast("timestamp").alias("created_at"), F.col("asset_id").alias("arrival"))
    features = assets.select("project_id", "asset_id", pick(["closeUp", "medium", "wide"], F.col("asset_id") + F.col("project_id")).alias("framing"), F.lit(0.2).alias("aesthetic"), F.lit(False).alias("is_utility"), (F.col("asset_id") / 4.0).alias("sharpness"),
                             F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("region"), (0.5 + F.col("asset_id") * 0.2).alias("aspect"), F.lit(0).alias("faces"), F.lit(None).cast("array<float>").alias("print"))
    return slots, assets, features


@register("assign_with_reuse", f"""WITH RECURSIVE sl AS (SELECT CAST(c_custkey // 12 * 100 + c_nationkey % 4 AS BIGINT) AS project_id, c_custkey AS ck FROM customer),
opens AS (SELECT *, 's' || ck AS slot_id, row_number() OVER p - 1 AS k, count(*) OVER (PARTITION BY project_id) AS n FROM sl WINDOW p AS (PARTITION BY project_id ORDER BY ck)),
options AS (SELECT project_id, slot_id, k, n, a || '/' || r AS opt, abs(ck % 3 - (a + project_id) % 3) * 0.8 + 0.4 * 0.8 * [1.5, 1, 2.2][ck % 3 + 1] + (1 - a / 4) * 0.45 * CASE WHEN ck % 3 = 2 THEN 1.8 ELSE 1 END
    + CASE WHEN 0.5 + a * 0.2 > 0.5625 THEN 1 - 0.5625 / (0.5 + a * 0.2) ELSE 1 - (0.5 + a * 0.2) / 0.5625 END * 0.5 + abs((a - 1) / 2 - k / greatest(1, n - 1)) * 0.3 + r * 2.5 AS cost
  FROM opens, (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest(range(20)) AS r) WHERE r < (n + 2) // 3),
{CHEAPEST}
SELECT project_id, n AS slots, {s6('total', 'total')}, true AS proven FROM least""")
def _(spark, sf):
    """The cheapest total of each project, which several assignments may reach."""
    found = cheapest_options(assign.option_costs(*_reused(spark, sf)))
    return found.groupBy("project_id").agg(F.count(F.lit(1)).alias("slots"), r6(F.sum("cost")).alias("total"), (F.max("gap") <= 1e-4).alias("proven"))


def _printed(spark, sf, features):
    """Features with prints of the vector table, so that neighbours are compared by what they show."""
    vectors = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    total = vectors.agg(F.count(F.lit(1))).scalar()
    own = F.pmod(F.col("project_id") * 3 + F.col("asset_id"), F.greatest(total, F.lit(1)))
    return features.withColumn("_vec", own).join(vectors, F.col("_vec") == F.col("vec_id"), "left").withColumn("print", F.col("embedding")).select(*features.columns)


@register("arranged_variety")
def _(spark, sf):
    """The same projects, with prints, after the exchanges for variety, for every seed that an arrangement is the best of:
    tested by its invariants."""
    slots, assets, features = _reused(spark, sf)
    found = assign.assign_assets(slots, assets, _printed(spark, sf, features), seeds=REPEAT_SEEDS)
    return found.select("project_id", "seed", "slot_id", "scene_idx", "asset_id", r6("total").alias("total"), "reason")


@register("best_of_seeds", f"""WITH RECURSIVE r AS (SELECT user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seed, value / 500 AS total, event_id % 3 AS repeats FROM events),
w AS (SELECT project_id, CAST(0 AS BIGINT) AS stp, seed, total, repeats FROM r WHERE seed = 0 UNION ALL
  SELECT w.project_id, r.seed, CASE WHEN w.repeats > 0 AND r.total > w.total THEN r.seed ELSE w.seed END, CASE WHEN w.repeats > 0 AND r.total > w.total THEN r.total ELSE w.total END, CASE WHEN w.repeats > 0 AND r.total > w.total THEN r.repeats ELSE w.repeats END
  FROM w JOIN r ON r.project_id = w.project_id AND r.seed = w.stp + 1)
SELECT project_id, seed, {s6('total', 'total')} FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY stp DESC) AS rn FROM w) WHERE rn = 1""")
def _(spark, sf):
    e = positions(A.table(spark, sf, "events").select(F.col("user_id").alias("project_id"), "event_id", "value"), ["project_id"], ["event_id"], F.expr("event_id div 8192"), out="seed")
    return assign.best_of_seeds(e.select("project_id", "seed", (F.col("value") / 500).alias("total"), (F.col("event_id") % 3).alias("repeats"))).select("project_id", "seed", r6("total").alias("total"))
