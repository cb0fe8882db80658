"""Exact Jaccard linking of text layers through a token-group matrix.

Layers with equal shingle sets form one class. Similar classes (same smallest hash of their commoner shingles) are
partitioned into groups; the matrix holds, for every group, the union of its members' shingles that an
exact prefix argument allows to decide. A class whose own prefix does not meet enough of a group's rows cannot link
into it; the others are sent to the group, where its whole union bounds the overlap again, and only a
group that still qualifies is opened and compared member by member.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.llm.components import connected
from cutlens.llm.textops import WordHashes, mixed, packed, shingle_set, words_of
from cutlens.session import cut_lineage

#: Members of a group, and visitors that one task compares with them at a time.
GROUP_MEMBERS, VISITORS = 256, 2048
#: Prefix shingles that a visitor shares with a group.
SHARED = 4
#: Counters that order shingles by rarity, and marks of the layers whose texts are sent: fixed sizes, so they may be broadcast.
RARITY_BITS, MARK_BITS = 18, 23


def link_similar(
    text_layers: DataFrame, layer_id: str = "layer_id", text: str = "text", shingle: int = 5, threshold: float = 0.8
) -> DataFrame:
    """One row per layer: ``layer_id``, ``n_shingles`` (size of its set of distinct word shingles),
    ``class_id`` (smallest layer id with the same set) and ``component_id`` (smallest layer id reachable
    over links of Jaccard likeness >= ``threshold``, itself included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words than ``shingle`` count as one
    shingle, none (or a null text) as the empty set, which links with nothing. Rows that share an id
    count as one node; a row with a null id keeps its ``n_shingles`` and gets null ids. Other columns are
    not returned. An empty table gives an empty result. The comparison is exact on 64-bit shingle hashes,
    with the threshold as a decimal fraction, so a likeness equal to it counts.
    """
    ratio = Fraction(str(threshold))
    layers = text_layers.select(F.col(layer_id).alias("layer_id"), F.col(text).alias("text"))
    key = layers.schema["layer_id"].dataType.simpleString()
    counts = layers.select("text").mapInArrow(_rarity(shingle), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rarity = np.zeros(1 << RARITY_BITS, np.int64)
    found = counts.toArrow()  # 2^18 rows at most
    rarity[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = layers.sparkSession.sparkContext.broadcast(rarity)
    fields = f"layer_id {key}, set_key binary, n long, least long, tokens binary, indexed int"
    sets = cut_lineage(layers.mapInArrow(_prefixes(shingle, ratio, shared, _arrow_key(layers)), fields))

    linkable = sets.filter("n > 0 AND layer_id IS NOT NULL")
    # what is read off a set is the same for all its holders, so one aggregate names the class and keeps it
    of_set = [F.first(c).alias(c) for c in ("n", "least", "tokens", "indexed")]
    classes = cut_lineage(linkable.groupBy("set_key").agg(F.min("layer_id").alias("class_id"), *of_set))
    heads = classes.select("set_key", "class_id")
    # an id with several texts heads several classes; each keeps its own group
    crowded = classes.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS).alias("parts")).filter("parts > 1")
    group = F.xxhash64("least", F.pmod(F.xxhash64("class_id"), F.coalesce("parts", F.lit(1))))
    grouped = classes.join(crowded, "least", "left").select("class_id", "n", "tokens", "indexed", group.alias("group_id"))

    words = grouped.mapInArrow(_exploded(_arrow_key(layers)), f"class_id {key}, n long, group_id long, token long, in_index boolean")
    matrix = words.filter("in_index").groupBy("token", "group_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    visits = words.select("token", "class_id", "n", F.col("group_id").alias("home")).join(matrix, "token")
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * ratio.numerator / ratio.denominator))
    fits = (F.col("home") != F.col("group_id")) & (F.col("low") <= F.col("n")) & (F.col("high") * ratio.denominator >= F.col("n") * ratio.numerator)
    met = visits.filter(fits).groupBy("class_id", "group_id", "n").agg(F.count(F.lit(1)).alias("met"))
    visits = cut_lineage(met.filter(F.col("met") >= needed).select("class_id", "group_id"))
    crowd = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    guests = visits.groupBy("group_id").agg(F.count(F.lit(1)).alias("guests"))
    opened = crowd.join(guests, "group_id", "left").filter("members > 1 OR guests > 0")
    opened = opened.select("group_id", F.ceil(F.coalesce("guests", F.lit(1)) / VISITORS).alias("parts"))
    residents = grouped.join(opened, "group_id").select("class_id", "group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"))
    callers = visits.join(opened, "group_id").select("class_id", "group_id", F.pmod(F.xxhash64("class_id"), F.col("parts")).alias("part"), F.lit(False).alias("member"))
    present = cut_lineage(residents.unionByName(callers))
    marked = _marked(layers, present.select("class_id"))
    texts = present.join(marked, present["class_id"] == marked["layer_id"]).select("class_id", "text", "member", "group_id", "part")
    links = texts.groupBy("group_id", "part").applyInArrow(_open_group(shingle, ratio, _arrow_key(layers)), f"a {key}, b {key}")

    components = connected(links)
    named = heads.join(components, F.col("class_id") == F.col("node"), "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    joined = sets.filter("n > 0 AND layer_id IS NOT NULL").join(named, "set_key").select("layer_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    bare = sets.filter("n = 0 OR layer_id IS NULL").select("layer_id", F.col("n").alias("n_shingles"), F.col("layer_id").alias("class_id"), F.col("layer_id").alias("component_id"))
    return joined.unionByName(bare)


def keep_one_of_similar(documents: DataFrame, layer_id: str = "layer_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``documents`` with only the smallest id of each component of similar texts; rows with a null id and
    texts without words stay. All columns are kept; of repeated rows of a kept id, each stays."""
    found = link_similar(documents, layer_id, text, shingle, threshold)
    gone = found.filter("layer_id <> component_id").select(F.col("layer_id").alias("_gone")).distinct()
    return documents.join(gone, documents[layer_id] == F.col("_gone"), "left_anti")


def _arrow_key(layers: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(layers.schema["layer_id"].dataType)


def _marked(layers: DataFrame, ids: DataFrame) -> DataFrame:
    """``layers`` without most of those whose id is not among ``ids``, before anything is shuffled: a mark per hash slot."""
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MARK_BITS)
    # 64 slots a row, so what comes to the driver is 2 MB at most
    rows = ids.select(slot("class_id").alias("s")).groupBy(F.expr("s div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("bits"))
    words = np.zeros(1 << (MARK_BITS - 6), np.int64)
    found = rows.toArrow()
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    shared = layers.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def keep(batches):
        for batch in batches:
            s = batch.column("_slot").to_numpy()
            held = (shared.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(held.astype(bool))).select(["layer_id", "text"])

    return layers.filter("layer_id IS NOT NULL").withColumn("_slot", slot("layer_id")).mapInArrow(keep, layers.schema)


def _at_least(ratio: Fraction, n: np.ndarray | int):
    """Smallest integer >= ratio * n."""
    return -((-ratio.numerator * n) // ratio.denominator)


def _rarity(shingle: int):
    def count(batches):
        cache, total = WordHashes(), np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = shingle_set(words_of(t, True), shingle, cache)
                np.add.at(total, (found >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 50_000):
            part = slots[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])

    return count


def _prefixes(shingle: int, ratio: Fraction, shared, key: pa.DataType):
    """Size, identity, group hash and rarest shingles of every layer's set.

    With sets of size ``n``, a partner at the threshold shares at least ``ratio * n``; a partner that is
    not smaller, at least ``2 ratio / (1 + ratio) * n``. All but so many shingles, plus ``k``, hold ``k``
    shared ones (or all, if fewer are shared) if both sides take them in the same order: the probe prefix and the
    shorter index prefix, with ``k`` = ``SHARED``.
    """
    both = 2 * ratio / (1 + ratio)

    def prefix(batches):
        cache = WordHashes()
        rarity = shared.value
        for batch in batches:
            sizes, keys, least, tokens, indexed = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                found = shingle_set(words_of(t, True), shingle, cache)
                n = len(found)
                sizes.append(n)
                keys.append(_identity(found))
                order = np.lexsort((found, rarity[(found >> np.uint64(64 - RARITY_BITS)).astype(np.int64)])) if n else []
                probe = min(n, n - math.ceil(ratio * n) + SHARED)
                # of the shingles behind the prefix: near copies differ in the rarest ones, and are to share a group
                common = found[order][min(probe, n // 2) :] if n else found
                least.append(int(mixed(common ^ np.uint64(0x5851F42D4C957F2D)).min().view(np.int64)) if n else None)
                tokens.append(packed(found[order][:probe]) if n else b"")
                indexed.append(min(n, n - math.ceil(both * n) + SHARED))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(key), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.int64()), pa.array(tokens, pa.binary()), pa.array(indexed, pa.int32())],
                ["layer_id", "set_key", "n", "least", "tokens", "indexed"],
            )

    return prefix


def _identity(found: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(packed(found), digest_size=16).digest()


def _exploded(key: pa.DataType):
    """One row per class and probed shingle."""

    def explode(batches):
        for batch in batches:
            raw = batch.column("tokens").to_pylist()
            sizes = np.array([len(r) // 8 for r in raw], np.int64)
            if not sizes.sum():
                continue
            owner = np.repeat(np.arange(len(raw)), sizes)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            indexed = batch.column("indexed").to_numpy(zero_copy_only=False)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id").take(take).cast(key), batch.column("n").take(take), batch.column("group_id").take(take), pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(place < indexed[owner])],
                ["class_id", "n", "group_id", "token", "in_index"],
            )

    return explode


def _open_group(shingle: int, ratio: Fraction, key: pa.DataType):
    """Links of a group: among its members, and from each visitor whose overlap with the union allows one.

    Not every pair is reported: members that are already joined need no second link, and a visitor is
    linked once to each joined set of members that it reaches, so a group gives fewer links than rows.
    """

    def compare(table: pa.Table) -> pa.Table:
        cache = WordHashes()
        ids, texts, member = (table.column(c).to_pylist() for c in ("class_id", "text", "member"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], not member[i]))
        inside = [i for i in order if member[i]]
        sets = [shingle_set(words_of(texts[i], True), shingle, cache) for i in inside]
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        rank = np.argsort(every, kind="stable")
        every, owner = every[rank], owner[rank]
        union, first = np.unique(every, return_index=True)
        first = np.r_[first, len(every)]
        root = np.arange(len(sets))
        a, b = [], []

        def alike(found: np.ndarray) -> np.ndarray:
            """Members at the threshold, by one pass over the rows of the union that ``found`` meets."""
            if not len(found) or not len(union):
                return np.empty(0, np.int64)
            at = np.minimum(np.searchsorted(union, found), len(union) - 1)
            at = at[union[at] == found]
            if len(at) < _at_least(ratio, len(found)):
                return np.empty(0, np.int64)
            spans = first[at + 1] - first[at]
            rows = np.repeat(first[at] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            shared = np.bincount(owner[rows], minlength=len(sets))
            return np.flatnonzero((shared > 0) & (shared * ratio.denominator >= (sizes + len(found) - shared) * ratio.numerator))

        for k, i in enumerate(inside):
            for m in alike(sets[k]).tolist():
                if m < k and root[m] != root[k]:
                    a.append(ids[i]), b.append(ids[inside[m]])
                    low, high = sorted((root[m], root[k]))
                    root[root == high] = low
        for i in order:
            if not member[i]:
                near = alike(shingle_set(words_of(texts[i], True), shingle, cache))
                for r in np.unique(root[near]).tolist():
                    m = near[root[near] == r][0]
                    a.append(ids[i]), b.append(ids[inside[m]])
        return pa.table({"a": pa.array(a, key), "b": pa.array(b, key)})

    return compare
