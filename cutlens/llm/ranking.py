"""Exact ranked search over text layers by two trees whose nodes hold coordinate maxima.

A layer is a sparse vector of term saturations, a search a sparse vector of term weights, and a score their
inner product. Layers are dealt to shards by the term that tells most about them; a shard keeps pages of
layers under pages of pages, a block of searches likewise, and every node holds the largest value of each
coordinate below it. The inner product of two nodes' maxima bounds every score between them, so a pair of
nodes whose bound is below the weakest k-th score of its searches is dropped with all it holds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.llm.similarity import _arrow_key
from cutlens.llm.textops import WordHashes
from cutlens.session import cut_lineage

#: Slots of the term filter (fixed, so it may be broadcast); postings of a shard; searches of a block.
SLOT_BITS, SHARD_POSTINGS, BLOCK_SEARCHES = 20, 2_000_000, 256
#: Layers of a leaf page, searches of a leaf page, children of an inner page.
LEAF, SEARCH_LEAF, FAN = 64, 8, 8
#: Letters and digits stay (A-Z lower-cased), all of U+0080 and on too; everything else separates terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` as UTF-8, with only A-Z lower-cased."""
    return text.encode().translate(_TERM).split() if text else []


def rank_layers(
    text_layers: DataFrame, searches: DataFrame, layer_id: str = "layer_id", text: str = "text", search_id: str = "search_id",
    search_text: str = "text", k: int = 10,
) -> DataFrame:
    """The ``k`` layers of highest score above 0 for every search: ``search_id``, ``rank`` (int, from 1),
    ``layer_id``, ``score`` (bigint); equal scores go to the smaller id.

    With N layers that have a term, L terms in all of them, n terms in a layer, df layers that hold a term and
    tf its occurrences in a layer, a term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and a layer scores
    ``sum of w * (10^9 tf div (1000 tf + 8 m))`` over the distinct terms of the search, with
    ``m = 10 + 90 n N div L``.

    Null texts have no terms. Layers with a null id count in N, L and df but are not returned; searches with a
    null id are left out, those that share an id are one search. Repeated layer rows count and rank one by one.
    A search without a known term, an empty table of layers or of searches gives no rows; other columns are
    not read. Terms are told apart by 64-bit hashes.

    A fixed bitmap of the searches' terms thins the postings, which are written once. An eighth of the shards is
    searched first; the k-th scores found there are the thresholds that all others start with.
    """
    spark = text_layers.sparkSession
    key, search_key = (df.select(F.col(c).alias("layer_id")) for df, c in ((text_layers, layer_id), (searches, search_id)))
    kind, search_kind = (d.schema["layer_id"].dataType.simpleString() for d in (key, search_key))
    asked = searches.select(F.col(search_id).alias("search_id"), F.col(search_text).alias("_text")).filter("search_id IS NOT NULL")
    wanted = cut_lineage(asked.mapInArrow(_search_terms(_arrow_key(search_key)), f"search_id {search_kind}, term long").distinct())
    slot = F.shiftrightunsigned("term", 64 - SLOT_BITS).cast("int")
    bitmap = np.zeros(1 << SLOT_BITS, bool)
    bitmap[wanted.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True  # 2^20 rows at most
    layers = text_layers.select(F.col(layer_id).alias("layer_id"), F.col(text).alias("_text"))
    fields = f"layer_id {kind}, n long, terms binary, tfs binary"
    counted = cut_lineage(layers.mapInArrow(_postings(spark.sparkContext.broadcast(bitmap), _arrow_key(key)), fields))

    n_layers, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select("terms").mapInArrow(_holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_layers + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weights = df.join(wanted.select("term").distinct(), "term").select("term", weight.alias("w")).filter("w > 0")
    weighed = cut_lineage(wanted.join(weights, "term"))
    tops = weighed.groupBy(slot.alias("slot")).agg(F.max("w").alias("w")).toArrow()  # 2^20 rows at most
    top = np.zeros(1 << SLOT_BITS, np.int64)
    top[tops.column("slot").to_numpy()] = tops.column("w").to_numpy()

    fields = f"layer_id {kind}, head long, next long, size long, terms binary, values binary"
    headed = counted.filter("n > 0 AND layer_id IS NOT NULL").mapInArrow(_headed(spark.sparkContext.broadcast(top), n_layers, n_terms, _arrow_key(key)), fields)
    heads = cut_lineage(headed.groupBy("head").agg(F.sum("size").alias("size")))
    shards = max(1, -(-(heads.agg(F.sum("size")).first()[0] or 0) // SHARD_POSTINGS))
    crowded = heads.select("head", F.ceil(F.col("size") / SHARD_POSTINGS).alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("layer_id", "next"), F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64("head", part), F.lit(shards)).cast("int")
    dealt = cut_lineage(headed.join(crowded, "head", "left").select(shard.alias("shard"), "layer_id", "head", "next", "terms", "values"))

    plain = weighed.groupBy("search_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    block = F.pmod(F.xxhash64("search_id"), F.lit(max(1, -(-asked.count() // BLOCK_SEARCHES))))
    fields = f"search_id {search_kind}, layer_id {kind}, score long"
    answer = _answer(k, _arrow_key(search_key), _arrow_key(key))
    best = Window.partitionBy("search_id").orderBy(F.desc("score"), "layer_id")

    def answers(first: int, past: int, floors: DataFrame) -> DataFrame:
        blocks = floors.groupBy(block.alias("block")).agg(F.collect_list(F.struct("search_id", "terms", "floor")).alias("asked"))
        sent = blocks.select(F.explode(F.sequence(F.lit(first), F.lit(past - 1))).alias("shard"), "asked")
        mine = dealt.filter((F.col("shard") >= first) & (F.col("shard") < past))
        return mine.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(answer, fields)

    wave = -(-shards // 8)
    found = answers(0, wave, plain.withColumn("floor", F.lit(0).cast("bigint")))
    if wave < shards:
        found = cut_lineage(found)
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
        floors = plain.join(ranked.select("search_id", F.col("score").alias("floor")), "search_id", "left")
        found = found.unionByName(answers(wave, shards, floors.withColumn("floor", F.coalesce("floor", F.lit(0)))))
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("search_id", "rank", "layer_id", "score")


def _hashes(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts in a row, and how many each text has."""
    found = [terms_of(t) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    return cache.of([w for f in found for w in f]), sizes


def _search_terms(key: pa.DataType):
    def split(batches):
        cache = WordHashes()
        for batch in batches:
            hashes, sizes = _hashes(batch.column(1).to_pylist(), cache)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner).cast(key), pa.array(hashes.view(np.int64))], ["search_id", "term"])

    return split


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``values`` cut into one binary value per row."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _postings(shared, key: pa.DataType):
    def count(batches):
        cache, bitmap = WordHashes(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                hashes, n = _hashes(batch.column(1).to_pylist(), cache)
                held = bitmap[hashes >> np.uint64(64 - SLOT_BITS)]
                terms, code = np.unique(hashes[held], return_inverse=True)
                pairs, tfs = np.unique(np.repeat(np.arange(len(n)), n)[held] * max(1, len(terms)) + code, return_counts=True)
                owner, code = np.divmod(pairs, max(1, len(terms)))
                sizes = np.bincount(owner, minlength=len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(key), pa.array(n), _blobs(terms[code], sizes), _blobs(tfs.astype(np.uint32), sizes)], ["layer_id", "n", "terms", "tfs"]
                )

    return count


def _holders(batches):
    for batch in batches:
        terms, df = np.unique(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], ["term", "df"])


def _headed(shared, n_layers: int, n_terms: int, key: pa.DataType):
    """Saturations instead of counts, and the two terms of a layer that can add most to a score."""

    def head(batches):
        top = shared.value
        for batch in batches:
            rows, heads, nexts, sizes, terms, values = [], [], [], [], [], []
            for row, (n, raw, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "terms", "tfs")))):
                held = np.frombuffer(raw, np.uint64)
                most = top[held >> np.uint64(64 - SLOT_BITS)]
                use = most > 0
                if not use.any():
                    continue
                held, tf = held[use], np.frombuffer(counts, np.uint32)[use].astype(np.int64)
                m = 10 + 90 * n * n_layers // n_terms
                value = 10**9 * tf // (1000 * tf + 8 * m)
                worth = most[use] * value
                first = int(np.argmax(worth))
                lead = int(held[first].view(np.int64))
                worth[first] = -1
                rows.append(row), heads.append(lead), nexts.append(int(held[np.argmax(worth)].view(np.int64)))
                sizes.append(len(held)), terms.append(held.tobytes()), values.append(value.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("layer_id").take(pa.array(rows, pa.int64())).cast(key), pa.array(heads, pa.int64()), pa.array(nexts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(values, pa.binary())],
                ["layer_id", "head", "next", "size", "terms", "values"],
            )

    return head


def _levels(pages: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima of pages, of pages of pages, ... up to one root."""
    levels = [pages]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


class LayerPages:
    """Leaf pages of a shard over the coordinates of one block of searches."""

    def __init__(self, vocabulary: np.ndarray, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, dtype):
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = vocabulary[at] == terms
        self.owner, self.at, self.values = owner[known], at[known], values[known].astype(dtype)
        pages = -(-n // LEAF)
        place = (self.owner // LEAF) * len(vocabulary) + self.at
        order = np.argsort(place, kind="stable")
        spots, first = np.unique(place[order], return_index=True)
        maxima = np.zeros(pages * len(vocabulary), dtype)
        if len(spots):
            maxima[spots] = np.maximum.reduceat(self.values[order], first)
        self.levels = _levels(maxima.reshape(pages, len(vocabulary)))
        self.starts = np.searchsorted(self.owner, np.arange(pages + 1) * LEAF)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def page(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates that a page holds, and its layers over them."""
        if leaf not in self.open:
            part = slice(self.starts[leaf], self.starts[leaf + 1])
            columns, code = np.unique(self.at[part], return_inverse=True)
            dense = np.zeros((LEAF, len(columns)), self.values.dtype)
            dense[self.owner[part] - leaf * LEAF, code] = self.values[part]
            self.open[leaf] = columns, dense
        return self.open[leaf]


def search(pages: LayerPages, weights: np.ndarray, floors: np.ndarray, id_rank: np.ndarray, k: int) -> tuple[list, list, int]:
    """Best layers of every search (rows of ``weights``): row numbers and scores, and the number of scores computed.

    Pairs of nodes are taken by falling bound; a pair is dropped when its bound is below the weakest k-th
    score (or floor) of its searches. Equal bounds stay, because a tie is decided by ``id_rank``.
    """
    n = len(id_rank)
    groups = np.maximum.reduceat(weights, np.arange(0, len(weights), SEARCH_LEAF), axis=0)
    searches, layers = _levels(groups), pages.levels
    rows = [np.empty(0, np.int64) for _ in weights]
    scores = [np.empty(0, weights.dtype) for _ in weights]
    weakest, computed = floors.astype(weights.dtype), 0

    def span(level: int, node: int) -> slice:
        width = SEARCH_LEAF * FAN**level
        return slice(node * width, min(len(weights), (node + 1) * width))

    def children(level: int, node: int, below: list[np.ndarray]) -> range:
        return range(node * FAN, min(len(below[level - 1]), (node + 1) * FAN))

    a, b = len(layers) - 1, len(searches) - 1
    waiting = [(-(layers[a][0] @ searches[b][0]), a, 0, b, 0)]
    while waiting:
        bound, a, i, b, j = heapq.heappop(waiting)
        mine = span(b, j)
        if bound >= 0 or -bound < weakest[mine].min():
            continue
        if a or b:
            down = a >= b
            inner = children(a, i, layers) if down else children(b, j, searches)
            bounds = layers[a - 1][inner] @ searches[b][j] if down else searches[b - 1][inner] @ layers[a][i]
            for c, value in zip(inner, bounds.tolist()):
                if value > 0:
                    heapq.heappush(waiting, (-value, a - 1, c, b, j) if down else (-value, a, i, b - 1, c))
            continue
        columns, dense = pages.page(i)
        part = dense[: n - i * LEAF] @ weights[mine][:, columns].T
        computed += part.size
        for s in range(mine.start, mine.stop):
            here = part[:, s - mine.start]
            good = np.flatnonzero((here > 0) & (here >= weakest[s]))
            if not len(good):
                continue
            every, value = np.concatenate([rows[s], good + i * LEAF]), np.concatenate([scores[s], here[good]])
            order = np.lexsort((id_rank[every], -value))[:k]
            rows[s], scores[s] = every[order], value[order]
            if len(order) == k:
                weakest[s] = max(weakest[s], value[order[-1]])
    return rows, scores, computed


def _answer(k: int, search_key: pa.DataType, key: pa.DataType):
    def answer(layers: pa.Table, blocks: pa.Table) -> pa.Table:
        out_s, out_l, out_v = [], [], []
        if layers.num_rows and blocks.num_rows:
            layers = layers.sort_by([("head", "ascending"), ("next", "ascending"), ("layer_id", "ascending")])
            sizes = np.array([len(r) // 8 for r in layers.column("terms").to_pylist()])
            terms = np.frombuffer(b"".join(layers.column("terms").to_pylist()), np.uint64)
            values = np.frombuffer(b"".join(layers.column("values").to_pylist()), np.int32)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ids = layers.column("layer_id")
            id_rank = np.empty(len(sizes), np.int64)
            id_rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(sizes))
            ids = ids.to_pylist()
            for asked in blocks.column("asked").to_pylist():
                asked.sort(key=lambda one: max((t["w"], t["term"]) for t in one["terms"]))  # searches with the same heaviest term are neighbours
                words = [np.array([t["term"] for t in one["terms"]], np.int64).view(np.uint64) for one in asked]
                vocabulary = np.unique(np.concatenate(words))
                most = max(t["w"] for one in asked for t in one["terms"]) * 10**6 * max(map(len, words))
                dtype = np.float64 if most < 2**53 else np.int64  # whole numbers either way; only the first has fast products
                weights = np.zeros((len(asked), len(vocabulary)), dtype)
                for s, (one, w) in enumerate(zip(asked, words)):
                    weights[s, np.searchsorted(vocabulary, w)] = [t["w"] for t in one["terms"]]
                pages = LayerPages(vocabulary, owner, terms, values, len(sizes), dtype)
                rows, scores, _ = search(pages, weights, np.array([one["floor"] for one in asked]), id_rank, k)
                for one, mine, score in zip(asked, rows, scores):
                    out_s += [one["search_id"]] * len(mine)
                    out_l += [ids[r] for r in mine.tolist()]
                    out_v += score.astype(np.int64).tolist()
        return pa.table({"search_id": pa.array(out_s, search_key), "layer_id": pa.array(out_l, key), "score": pa.array(out_v, pa.int64())})

    return answer
