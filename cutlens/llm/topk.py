"""Exact top-k search over feature prints with a paged M-tree."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.llm.similarity import _arrow_key

#: Prints of a page, of a shard (one tree), queries of a block, and blocks that one task takes to a shard.
PAGE, SHARD, QUERIES, BATCH = 256, 8192, 256, 64
SCALE = 64


def top_prints(
    asset_features: DataFrame, queries: DataFrame, asset_id: str = "asset_id", feature_print: str = "feature_print", k: int = 20, scale: int = SCALE
) -> DataFrame:
    """The ``k`` assets of highest score for every row of ``queries``, its own id left out.

    Components become ``floor(scale * x)``, the score is their integer inner product; equal scores go to the
    smaller id. Returns ``query_id``, ``rank`` (int, from 1), ``asset_id``, ``score`` (bigint). Prints that are
    null or hold null or non-finite components take no part, nor do rows with a null id; prints of different
    lengths do not meet. Rows that share an id and print count once per print. With fewer than ``k``
    candidates, all are returned; an empty table gives an empty result. Scores are exact while they stay
    below 2^53.

    Appending ``sqrt(M^2 - |x|^2)``, with M the largest length, turns the inner product into a distance, the
    metric of the tree. Equal prints are one entry with its ``k + 1`` smallest ids, which decides every
    tie. Prints are dealt to shards, each shard builds its tree in one task, and blocks of queries are
    sent to every shard: the query set against all rows, in blocks. A task holds one shard and at most ``BATCH`` blocks, and
    answers at most ``k`` rows a query.
    """
    key = asset_features.schema[asset_id].dataType.simpleString()
    usable = (F.col("v").isNotNull()) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def prints(df: DataFrame) -> DataFrame:
        plain = df.select(F.col(asset_id).alias("id"), F.col(feature_print).cast("array<double>").alias("v")).filter(usable)
        return plain.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("dim"))

    # equal prints may be a third of all: bounded lists of ids, merged before the shuffle by a salted rank
    salted = prints(asset_features).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).distinct()
    by_salt = Window.partitionBy("v", "dim", "salt").orderBy("id")
    by_print = Window.partitionBy("v", "dim").orderBy("id")
    first = salted.withColumn("r", F.row_number().over(by_salt)).filter(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(by_print)).filter(F.col("r") <= k + 1)
    entries = first.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    size = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"))
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    sized = size.select("dim", "longest", shards.alias("shards"))
    dealt = entries.join(F.broadcast(sized), "dim").select("dim", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int").alias("shard"), "longest", "v", "ids")

    asked = prints(queries).distinct()
    n_blocks = max(1, -(-queries.count() // QUERIES))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)))
    sent = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    sent = sent.join(F.broadcast(sized), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.expr(f"block div {BATCH}").alias("batch"), "asked")
    dealt = dealt.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n_blocks - 1) // BATCH).cast("bigint"))))
    answers = dealt.groupBy("dim", "shard", "batch").cogroup(sent.groupBy("dim", "shard", "batch")).applyInArrow(
        _search(k, _arrow_key(asset_features.select(F.col(asset_id).alias("layer_id")))), f"query_id {key}, asset_id {key}, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "asset_id")
    ranked = answers.distinct().withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "asset_id", "score")


class Node:
    """A page: rows of points (or routing objects) with their distance to the page's own routing object."""

    __slots__ = ("points", "to_parent", "radii", "children", "rows")

    def __init__(self, points, to_parent, radii, children, rows):
        self.points, self.to_parent, self.radii, self.children, self.rows = points, to_parent, radii, children, rows


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray, page: int = PAGE) -> Node:
    """M-tree over ``points`` below a routing object ``centre``: nearest-pivot splits down to leaf pages."""
    to_parent = np.sqrt(np.maximum(((points - centre) ** 2).sum(1), 0))
    if len(rows) <= page:
        return Node(points, to_parent, None, None, rows)
    pivots = [int(np.argmax(to_parent))]
    nearest = ((points - points[pivots[0]]) ** 2).sum(1)
    owner = np.zeros(len(rows), np.int64)
    while len(pivots) < min(page, -(-len(rows) // page) + 1):
        far = int(np.argmax(nearest))
        if nearest[far] <= 0:
            break
        distance = ((points - points[far]) ** 2).sum(1)
        closer = distance < nearest
        owner[closer], nearest = len(pivots), np.minimum(nearest, distance)
        pivots.append(far)
    if len(pivots) == 1:  # one point only: nothing to split
        return Node(points, to_parent, None, None, rows)
    kept, radii, children = [], [], []
    for p, at in enumerate(pivots):
        mine = np.flatnonzero(owner == p)
        if len(mine):
            child = build(points[mine], rows[mine], points[at], page)
            kept.append(at), children.append(child)
            radii.append(float(np.sqrt(nearest[mine].max())))
    kept = np.array(kept)
    return Node(points[kept], to_parent[kept], np.array(radii), children, None)


def search_block(root: Node, queries: np.ndarray, offer, limits, to_centre: np.ndarray) -> int:
    """Best-first for many queries at once: pages by smallest possible distance, each only with the queries that it can
    still serve. ``offer(who, rows, points)`` takes the points of a leaf for the queries ``who``; ``limits()`` tells how far
    each query still looks. Returns the number of distances that were needed."""
    slack = 1e-6 * (1 + to_centre)
    waiting, tick, computed = [(0.0, 0, root, np.arange(len(queries)), to_centre, np.zeros(len(queries)))], 0, 0
    while waiting:
        _, _, node, who, distance, low = heapq.heappop(waiting)
        limit = limits()[who] + slack[who]
        near = low <= limit
        if not near.any():
            continue
        who, distance, limit = who[near], distance[near], limit[near]
        # stored distances to the routing object bound each entry before its own distance is computed
        floor = np.abs(distance[:, None] - node.to_parent) - (node.radii if node.children else 0)
        open_ = np.flatnonzero((floor <= limit[:, None]).any(axis=0))
        if not len(open_):
            continue
        computed += len(who) * len(open_)
        if node.children is None:
            offer(who, node.rows[open_], node.points[open_])
            continue
        apart = np.sqrt(((queries[who][:, None] - node.points[open_]) ** 2).sum(2))
        lows = np.maximum(0.0, apart - node.radii[open_])
        for n, j in enumerate(open_.tolist()):
            mine = lows[:, n] <= limit
            if mine.any():
                tick += 1
                heapq.heappush(waiting, (float(lows[mine, n].min()), tick, node.children[j], who[mine], apart[mine, n], lows[mine, n]))
    return computed


def search(root: Node, query: np.ndarray, offer, bound, root_distance: float) -> int:
    """``search_block`` for one query: ``offer(rows, distances)``, ``bound()``."""
    one = lambda who, rows, points: offer(rows, np.sqrt(((points - query) ** 2).sum(1)))
    return search_block(root, query[None], one, lambda: np.array([bound()]), np.array([root_distance]))


def _search(k: int, key: pa.DataType):
    def answer(entries: pa.Table, blocks: pa.Table) -> pa.Table:
        out_q, out_a, out_s = [], [], []
        if entries.num_rows and blocks.num_rows:
            v = np.array(entries.column("v").to_pylist(), np.float64).reshape(entries.num_rows, -1)
            ids = entries.column("ids").to_pylist()
            longest = entries.column("longest")[0].as_py()
            lift = np.sqrt(np.maximum(longest - (v * v).sum(1), 0))
            points = np.c_[v, lift]
            centre = points.mean(0)
            root = build(points, np.arange(len(v)), centre)
            for asked in blocks.column("asked").to_pylist():
                q = np.array([one["v"] for one in asked], np.float64).reshape(len(asked), -1)
                for one, found in zip(asked, _best(root, v, longest, centre, q, k)):
                    pairs = [(-s, a) for s, r in found for a in ids[r] if a != one["id"]]
                    for s, a in heapq.nsmallest(k, pairs):
                        out_q.append(one["id"]), out_a.append(a), out_s.append(-s)
        return pa.table({"query_id": pa.array(out_q, key), "asset_id": pa.array(out_a, key), "score": pa.array(out_s, pa.int64())})

    return answer


def _best(root: Node, v: np.ndarray, longest: float, centre: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Score and row of every entry that can be among the ``k`` best of a query: a page meets a block of queries as one
    matrix product. One more than ``k`` entries are held, as one may be the query's own; equal scores stay, for ties
    by id."""
    lifted, norm = np.c_[q, np.zeros(len(q))], (q * q).sum(1)
    top = np.full((len(q), k + 1), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def limits() -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norm + longest - 2.0 * top.min(1)))  # distance of the worst score held

    def offer(who: np.ndarray, rows: np.ndarray, _: np.ndarray) -> None:
        scores = q[who] @ v[rows].T
        top[who] = np.partition(np.concatenate([top[who], scores], axis=1), -k - 1, axis=1)[:, -k - 1 :]
        n, m = np.nonzero(scores >= top[who].min(1)[:, None])
        found.append((who[n], rows[m], scores[n, m]))

    search_block(root, lifted, offer, limits, np.sqrt(((lifted - centre) ** 2).sum(1)))
    out: list[list[tuple[int, int]]] = [[] for _ in q]
    worst = top.min(1)
    for who, rows, scores in found:
        keep = scores >= worst[who]
        for n, r, s in zip(who[keep].tolist(), rows[keep].tolist(), scores[keep].tolist()):
            out[n].append((int(s), r))
    return out
