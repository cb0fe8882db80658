"""Packing of tokenised text layers into sequences by fitted length patterns.

Only the histogram of piece lengths (at most ``budget`` counts) is looked at to decide how many
sequences of which pattern are needed; which piece goes where is a ranked join over all pieces.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.llm.similarity import _arrow_key
from cutlens.session import cut_lineage

#: Length classes of the pattern fit, and documents in a pattern at most.
CLASSES, PARTS = 256, 3
#: Rows of a length that one task ranks.
RANKED_ROWS = 200_000
#: Fixed value: how the byte-level format splits a text before merging.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = re.compile(r"\s{1000}|\S{10000}")


def pack_layers(text_layers: DataFrame, tokenizer: str, layer_id: str = "layer_id", text: str = "text", budget: int = 2048, end_id: int = 0) -> DataFrame:
    """Places every piece of every layer in a sequence of at most ``budget`` tokens.

    A layer is the ids of its text (null: none) by the file ``tokenizer`` without special tokens, then
    ``end_id``. A longer one is cut into pieces of ``budget``, of which the first may be shorter; no other
    layer is cut. Returns ``layer_id``, ``piece`` (int, from 0), ``start``, ``length``, ``ids_crc32`` (of
    the ids as little-endian unsigned 32-bit numbers), ``sequence_id``, ``offset`` (all bigint); a
    sequence has no gaps. Repeated rows and null ids are packed like any others; other columns are not
    returned; an empty table gives an empty result.

    Patterns of up to three lengths that fill a sequence are enumerated, their repeat counts fitted to the
    length histogram by non-negative least squares and rounded down; what is left goes best-fit into
    new sequences, longest first, still as counts of lengths. The histogram and the plan are bounded by
    ``budget``, whatever the number of layers.
    """
    layers = text_layers.select(F.col(layer_id).alias("layer_id"), F.col(text).alias("text"))
    key = layers.schema["layer_id"].dataType.simpleString()
    pieces = cut_lineage(layers.mapInArrow(_pieces(tokenizer, budget, end_id, _arrow_key(layers)), f"layer_id {key}, piece int, start long, length long, ids_crc32 long"))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_patterns(histogram, budget)

    spark = text_layers.sparkSession
    salts = max(4, sum(histogram.values()) // RANKED_ROWS + 1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("layer_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_salt").orderBy("layer_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(shifts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    schema = "length long, first long, past long, sequence long, offset long"
    places = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    # the plan has a few rows for each of at most `budget` lengths
    placed = ranked.join(F.broadcast(places), "length").filter("_rank >= first AND _rank < past")
    return placed.select("layer_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")


def plan_patterns(histogram: dict[int, int], budget: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, past rank, first sequence, offset)`` for every run of equal patterns."""
    left = {n: c for n, c in histogram.items() if c > 0}
    runs: list[tuple[tuple[int, ...], int]] = []
    if left.pop(budget, 0):
        runs.append(((budget,), histogram[budget]))
    step = max(1, -(-budget // CLASSES))
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        by_class.setdefault(-(-n // step), []).append(n)
    classes = budget // step
    counts = np.zeros(classes + 1)
    for c, lengths in by_class.items():
        if c <= classes:
            counts[c] = sum(left[n] for n in lengths)
    patterns = [p for p in _patterns(classes) if all(counts[c] for c in p)]
    for pattern, repeat in zip(patterns, np.floor(_nnls(patterns, counts) + 1e-9).astype(int).tolist()):
        while repeat > 0:
            taken: list[int] = []
            for c in pattern:  # the longest of a class first: the pattern bounds their sum
                options = by_class[c]
                if len(taken) + 1 == len(pattern):  # the last one may be a little longer, to fill what rounding left
                    room = budget - sum(taken)
                    options = [n for k in range(c, c + PARTS + 1) for n in by_class.get(k, ()) if n <= room]
                pick = next((n for n in reversed(options) if left[n] > taken.count(n)), None)
                if pick is None:
                    break
                taken.append(pick)
            if len(taken) < len(pattern):
                break
            times = min(repeat, *(left[n] // taken.count(n) for n in taken))
            for n in taken:
                left[n] -= times
            runs.append((tuple(taken), times))
            repeat -= times
    runs += _best_fit({n: c for n, c in left.items() if c}, budget)

    ranks: dict[int, int] = {}
    plan, sequence = [], 0
    for lengths, times in runs:
        offset = 0
        for n in lengths:
            first = ranks.get(n, 0)
            plan.append((n, first, first + times, sequence, offset))
            ranks[n], offset = first + times, offset + n
        sequence += times
    return plan


def _patterns(classes: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``PARTS`` length classes that fill a sequence exactly."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], room: int) -> None:
        if room == 0:
            found.append(head)
        elif len(head) < PARTS:
            for c in range(min(room, head[-1] if head else classes), 0, -1):
                if c * (PARTS - len(head)) < room:
                    break
                extend((*head, c), room - c)

    extend((), classes)
    return found


def _nnls(patterns: list[tuple[int, ...]], target: np.ndarray) -> np.ndarray:
    """Non-negative least squares ``min |A x - target|`` by active sets; ``A`` counts classes by pattern."""
    x = np.zeros(len(patterns))
    if not patterns:
        return x
    a = np.zeros((len(target), len(patterns)), np.float32)
    for k, p in enumerate(patterns):
        for c in p:
            a[c, k] += 1
    active: list[int] = []
    for _ in range(6 * len(target)):
        gradient = a.T @ (target - a @ x).astype(np.float32)
        gradient[active] = -1
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-3 * max(1.0, target.max()) ** 0.5:
            break
        active.append(best)
        while active:
            part = a[:, active].astype(np.float64)
            solved = np.linalg.lstsq(part, target, rcond=None)[0]
            if solved.min() > 1e-9:
                x[:] = 0
                x[active] = solved
                break
            now = x[active]
            falling = solved <= 1e-9
            step = np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-12))
            x[active] = now + step * (solved - now)
            stay = [k for k, out in zip(active, falling & (x[active] <= 1e-9)) if not out]
            if len(stay) == len(active):
                stay = [k for k, v in zip(active, solved) if v > 1e-9]
            x[[k for k in active if k not in stay]] = 0
            active = stay
    return x


def _best_fit(left: dict[int, int], budget: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    lengths = sorted(left)
    runs: list[tuple[tuple[int, ...], int]] = []
    while lengths:
        head = lengths[-1]
        pattern, used, times = [head], {head: 1}, left[head]
        room = budget - head
        while room:
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            n = lengths[at]
            used[n] = used.get(n, 0) + 1
            pattern.append(n)
            room -= n
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
        runs.append((tuple(pattern), times))
    return runs


class _Ids:
    """Ids of a text as bytes, by a tokenizer file.

    A byte-level BPE whose merges stand in the order of their ids is read as ranks, which gives the same ids
    in a quarter of the time; other files, texts with an added token and texts with very long runs of white
    space or without any go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranked = _ranked(spec)

    def of(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.added) or _LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.cache
def _ids(path: str) -> _Ids:
    """Read once by a worker, not once a task."""
    return _Ids(path)


def _ranked(spec: dict):
    """The tokenizer as ranks of byte strings, or None if its file is not of the kind that allows it."""
    import tiktoken

    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    byte_of = {}
    for byte in range(256):  # visible Latin-1 characters stand for themselves, the others for 256 and on
        visible = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte
        byte_of[chr(byte if visible else 256 + len(byte_of) - sum(ord(c) < 256 for c in byte_of))] = byte
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t not in {a["content"] for a in spec["added_tokens"]}}
    if any(x >= y for x, y in zip(merged, merged[1:])) or len(ranks) != len(merged) + 256 or merged and max(ranks[bytes([b])] for b in range(256)) > merged[0]:
        return None
    return tiktoken.Encoding("ranked", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _pieces(tokenizer: str, budget: int, end_id: int, key: pa.DataType):
    names = ["layer_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        ids_of, end = _ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = (ids_of.of(t) if t else b"") + end
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    n = ((total - 1) % budget + 1) if at == 0 else budget
                    owner.append(row), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())).cast(key), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names
            )

    return cut
