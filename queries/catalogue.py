"""Template library, projects, media files, ingest and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.operators.ordered import positions
from cutlens.sources import adapters as A
from cutlens.sources import catalog, templates
from queries.common import r6, registry, s6

JOBS, SQL, register = registry()

TPL = r"""tpl AS (SELECT 'tpl-' || (doc_id % 900) AS id, array_to_string(list_filter(string_split(regexp_replace(text, '[\n\t]', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS title, lang, source, doc_id % 3 = 0 AS built_in, n_chars / 100.0 AS duration, doc_id FROM documents)"""


@register("source_info", f"""WITH m AS (SELECT doc_id AS source_id, n_chars / 40e0 AS seconds, (doc_id % 4) * 15e0 AS fps, 640 + doc_id % 1300 AS w, 480 + doc_id % 900 AS h, (doc_id % 4) * 90 AS rot, doc_id % 3 <> 0 AS has_audio, text FROM documents)
SELECT source_id, {s6('seconds', 'seconds')}, {s6('CASE WHEN fps > 0 THEN fps ELSE 30 END', 'fps')}, CASE WHEN rot % 180 = 90 THEN h ELSE w END AS width, CASE WHEN rot % 180 = 90 THEN w ELSE h END AS height, seconds > 120 AS too_long, has_audio,
  CASE WHEN (CASE WHEN rot % 180 = 90 THEN h / w ELSE w / h END) < 0.6 THEN 'portrait9x16' WHEN (CASE WHEN rot % 180 = 90 THEN h / w ELSE w / h END) < 0.9 THEN 'portrait4x5' WHEN (CASE WHEN rot % 180 = 90 THEN h / w ELSE w / h END) < 1.15 THEN 'square1x1' WHEN (CASE WHEN rot % 180 = 90 THEN h / w ELSE w / h END) < 2.1 THEN 'landscape16x9' ELSE 'other' END AS aspect,
  'sha256:' || sha256(CAST((source_id % 50) AS VARCHAR) || '.5|' || CAST(CASE WHEN rot % 180 = 90 THEN h ELSE w END AS VARCHAR) || 'x' || CAST(CASE WHEN rot % 180 = 90 THEN w ELSE h END AS VARCHAR) || text || CAST(strlen(text) AS VARCHAR)) AS fingerprint FROM m WHERE seconds > 0""")
def _(spark, sf):
    d = F.col("doc_id")
    raw = F.encode("text", "utf-8")
    media = A.table(spark, sf, "documents").select(
        d.alias("source_id"), (d % 50 + 0.5).cast("double").alias("seconds"), ((d % 4) * 15.0).alias("fps"), (640 + d % 1300).alias("width"), (480 + d % 900).alias("height"), ((d % 4) * 90).alias("rotation"),
        (d % 3 != 0).alias("has_audio"), F.octet_length("text").alias("length"), F.substring(raw, 1, catalog.HEAD_BYTES).alias("head"), (F.col("n_chars") / 40.0).alias("true_seconds"))
    prints = catalog.source_info(media).select("source_id", "fingerprint")
    info = catalog.source_info(media.withColumn("seconds", F.col("true_seconds"))).drop("fingerprint").join(prints, "source_id")
    return info.select("source_id", r6("seconds").alias("seconds"), r6("fps").alias("fps"), "width", "height", "aspect", "has_audio", "fingerprint", "too_long")


@register("read_templates", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'broken' WHEN doc_id % 10 = 7 THEN 'newer' ELSE 'ok' END AS state, doc_id % 5 AS scenes FROM documents)
SELECT doc_id, state AS outcome, CASE WHEN state = 'ok' THEN CAST(scenes AS INT) END AS scenes FROM d""")
def _(spark, sf):
    d = F.col("doc_id")
    scenes = F.transform(F.when(d % 5 > 0, F.sequence(F.lit(1).cast("bigint"), d % 5)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(F.format_string("scene_%02d", i).alias("id"), (i - 1).cast("int").alias("index"), (i * 1.0).alias("start"), (i * 1.0 + 1).alias("end")))
    body = F.struct(F.when(d % 10 == 7, 2).otherwise(1).alias("schemaVersion"), F.concat(F.lit("tpl-"), d.cast("string")).alias("id"), F.lit("t").alias("title"), scenes.alias("scenes"))
    texts = A.table(spark, sf, "documents").select("doc_id", F.when(d % 10 == 3, F.lit("{not json")).otherwise(F.to_json(body)).alias("value"))
    good, bad = templates.parse_templates(texts)
    return good.select("doc_id", F.lit("ok").alias("outcome"), F.size("scenes").alias("scenes")).unionByName(
        bad.select("doc_id", F.when(F.col("reason") == "unreadable", "broken").otherwise("newer").alias("outcome"), F.lit(None).cast("int").alias("scenes")))


@register("template_round_trip", f"WITH {TPL} SELECT id, md5(title) AS title, lang || ',' || source AS tags, {s6('duration', 'duration')}, doc_id FROM tpl")
def _(spark, sf):
    t = A.templates(spark, sf)
    docs = templates.to_document(t.withColumn("schemaVersion", F.lit(1)).withColumn("createdAt", F.lit("2024-01-01T00:00:00Z").cast("timestamp")).withColumn("canvas", F.struct(F.lit(1080).alias("width"), F.lit(1920).alias("height"), F.col("doc_id").cast("int").alias("fps"))).drop("doc_id"))
    good, _bad = templates.parse_templates(docs)
    return good.select("id", F.md5(F.encode("title", "utf-8")).alias("title"), F.array_join("tags", ",").alias("tags"), r6("duration").alias("duration"), F.col("canvas.fps").cast("bigint").alias("doc_id"))


@register("import_templates", f"""WITH {TPL}, old AS (SELECT DISTINCT id FROM tpl WHERE doc_id % 4 = 0), new AS (SELECT id, count(*) AS n FROM tpl WHERE doc_id % 4 <> 0 GROUP BY 1)
SELECT CASE WHEN o.id IS NULL THEN 'kept' ELSE 'renamed' END AS outcome, CAST(sum(CASE WHEN o.id IS NULL THEN 1 ELSE n END) AS BIGINT) AS templates FROM new LEFT JOIN old o USING (id) GROUP BY 1
UNION ALL SELECT 'renamed again', CAST(sum(n - 1) AS BIGINT) FROM new LEFT JOIN old o USING (id) WHERE o.id IS NULL""")
def _(spark, sf):
    t = A.templates(spark, sf)
    old, new = t.filter("doc_id % 4 = 0"), t.filter("doc_id % 4 <> 0").withColumn("title", F.concat_ws(" ", F.col("doc_id").cast("string"), "title"))
    got = templates.import_templates(new, old)
    origin = new.select("doc_id", F.col("id").alias("was")).join(old.select(F.col("id").alias("was"), F.lit(True).alias("taken")).distinct(), "was", "left")
    rows = got.join(origin, "doc_id")
    fresh = F.col("id") != F.col("was")
    outcome = F.when(~fresh, "kept").when(F.col("taken"), "renamed").otherwise("renamed again")
    return rows.filter("NOT isBuiltIn").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("templates"))


@register("project_catalog", f"""SELECT o_orderkey AS project_id, o_orderpriority || ' ' || o_custkey AS title, coalesce(n, 0) AS scenes, {s6('coalesce(e, 0)', 'seconds')}, {s6('1080 / CASE WHEN o_orderkey % 2 = 0 THEN 1920 ELSE 1350 END', 'aspect')}
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_discount * 10 + l_quantity * 37e-3) AS e FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey""")
def _(spark, sf):
    clips = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), (F.col("l_discount") * 10).alias("start"), (F.col("l_quantity") * 0.037).alias("duration"))
    c = catalog.project_catalog(A.projects(spark, sf), clips)
    return c.select("project_id", "title", "scenes", r6("seconds").alias("seconds"), r6("canvas_aspect").alias("aspect"))


@register("search_projects", "SELECT o_orderkey AS project_id FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_custkey), 'high 1')")
def _(spark, sf):
    return catalog.search_projects(A.projects(spark, sf), " High 1 ", "favorites").select("project_id")


@register("diag_report", f"""WITH l AS (SELECT user_id AS source_id, event_type AS category, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'timing' WHEN 2 THEN 'warning' ELSE 'failure' END AS level, value AS seconds, (event_id % 500) * 1e0 AS mb FROM events),
k AS (SELECT * FROM l)
SELECT source_id, category, count(*) AS entries, count(*) FILTER (level IN ('warning', 'failure')) AS problems, {s6("sum(seconds) FILTER (level = 'timing')", 'timed_seconds')}, {s6('max(mb)', 'category_peak_mb')}, any_value(pk) AS peak_mb, any_value(n) AS kept
FROM k JOIN (SELECT source_id, max(mb) AS pk, count(*) AS n FROM k GROUP BY 1) p USING (source_id) GROUP BY 1, 2""")
def _(spark, sf):
    e = F.col("event_id")
    log = A.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), e.alias("seq"), F.get(F.array(*[F.lit(v) for v in ("info", "timing", "warning", "failure")]), (e % 4).cast("int")).alias("level"),
                                              F.col("event_type").alias("category"), F.col("value").alias("seconds"), ((e % 500) * 1.0).alias("memory_mb"))
    r = catalog.diag_report(log)
    return r.select("source_id", "category", "entries", "problems", r6("timed_seconds").alias("timed_seconds"), r6("category_peak_mb").alias("category_peak_mb"), "peak_mb", "kept")


@register("ingest_audit", """WITH i AS (SELECT o_custkey % 100 AS project_id, o_orderkey % 7 AS batch_id, o_orderkey AS item_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'lib/' || (o_orderkey % 90) END AS origin, CASE WHEN o_orderkey % 15 <> 0 THEN 'p' END AS path FROM orders),
a AS (SELECT DISTINCT c_custkey % 100 AS project_id, 'lib/' || (c_custkey % 13) AS origin FROM customer), f AS (SELECT project_id, origin, min(item_id) AS fst FROM i WHERE origin IS NOT NULL GROUP BY 1, 2),
o AS (SELECT i.*, CASE WHEN i.origin IS NOT NULL THEN CASE WHEN a.origin IS NOT NULL OR i.item_id <> fst THEN 'known' ELSE 'referenced' END WHEN path IS NOT NULL THEN 'copied' ELSE 'failed' END AS outcome FROM i LEFT JOIN a ON a.project_id = i.project_id AND a.origin = i.origin LEFT JOIN f ON f.project_id = i.project_id AND f.origin = i.origin)
SELECT project_id, batch_id, outcome, count(*) AS items FROM o GROUP BY 1, 2, 3""")
def _(spark, sf):
    o = F.col("o_orderkey")
    items = A.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("project_id"), (o % 7).alias("batch_id"), o.alias("item_id"), F.when(o % 5 != 0, F.concat(F.lit("lib/"), (o % 90).cast("string"))).alias("origin"), F.when(o % 15 != 0, "p").alias("copied_path"))
    pool = A.table(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("project_id"), F.concat(F.lit("lib/"), (F.col("c_custkey") % 13).cast("string")).alias("origin"))
    return catalog.ingest_audit(items, pool)


_STARTER_TAGS = ", ".join(f"('{s['title']}', '{t}')" for s in templates.STARTERS for t in s["tags"])
_STARTERS = ", ".join(f"('{s['key']}', '{s['title']}')" for s in templates.STARTERS)


@register("search_templates", f"""WITH {TPL} SELECT doc_id FROM tpl WHERE NOT built_in AND (contains(lower(title), 'en') OR contains(lower(lang || ' ' || source), 'en'))""")
def _(spark, sf):
    return templates.search_templates(A.templates(spark, sf), "Yours", " EN ").select("doc_id")


@register("search_templates_by_tag", f"WITH {TPL} SELECT doc_id FROM tpl WHERE lang = 'de' OR source = 'de'")
def _(spark, sf):
    return templates.search_templates(A.templates(spark, sf), "de").select("doc_id")


@register("distinct_tags", f"WITH {TPL}, st(title, tag) AS (VALUES {_STARTER_TAGS}) SELECT DISTINCT tag, 2 AS shelf FROM (SELECT lang AS tag FROM tpl UNION SELECT source FROM tpl UNION SELECT tag FROM st) UNION ALL VALUES ('All', 0), ('Yours', 1)")
def _(spark, sf):
    both = A.templates(spark, sf).select("tags").unionByName(templates.seed_templates(spark).select("tags"))
    return templates.distinct_tags(both).select("tag", "shelf")


@register("library", f"WITH {TPL}, st(id, title) AS (VALUES {_STARTERS}) SELECT id, md5(title) AS title, 0 AS shelf FROM tpl UNION ALL SELECT id, md5(title), 1 FROM st")
def _(spark, sf):
    lib = templates.library(A.templates(spark, sf).select("id", "title", "tags", "isBuiltIn"), templates.seed_templates(spark).select("id", "title", "tags", "isBuiltIn"))
    return lib.select("id", F.md5(F.encode("title", "utf-8")).alias("title"), "shelf")


@register("find_template", f"""WITH st(id, title) AS (VALUES {_STARTERS}), p AS (SELECT o_orderkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'part-' || (o_orderkey % 4000) WHEN 1 THEN 'travel' ELSE 'quote' END AS template_id FROM orders), s AS (SELECT 'part-' || p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'quote', 'My quote')
SELECT project_id, template_id, coalesce(s.title, st.title) AS title, CASE WHEN s.id IS NOT NULL THEN 'saved' WHEN st.id IS NOT NULL THEN 'starter' END AS found_in FROM p LEFT JOIN s ON s.id = template_id LEFT JOIN st ON st.id = template_id""")
def _(spark, sf):
    o = F.col("o_orderkey")
    projects = A.table(spark, sf, "orders").select(o.alias("project_id"), F.when(o % 3 == 0, F.concat(F.lit("part-"), (o % 4000).cast("string"))).when(o % 3 == 1, "travel").otherwise("quote").alias("template_id"))
    saved = A.table(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title")).unionByName(spark.sql("SELECT 'quote' AS id, 'My quote' AS title"))
    return templates.find_template(projects, saved, templates.seed_templates(spark))


@register("starter_usage", """WITH t AS (SELECT doc_id % 10 AS n, count(*) AS projects FROM documents GROUP BY 1) SELECT n, projects FROM t""")
def _(spark, sf):
    """Projects per starter template: documents pick one of the ten starters by id."""
    seeds = templates.seed_templates(spark).select("id")
    numbered = positions(seeds.withColumn("one", F.lit(1)), ["one"], ["id"], F.lit(0), out="n").select("n", "id")
    docs = A.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("n"))
    return docs.join(numbered, "n").groupBy("n").agg(F.count(F.lit(1)).alias("projects"))
