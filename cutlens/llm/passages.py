"""Removal of byte strings that occur more than once in a corpus of text layers, by column-wise sorting.

A string of ``window`` bytes holds exactly one anchor, the smallest hash of its grams, at a place that
follows from its bytes. Strings that share the bytes around their anchor form a collection whose members
stand in columns, the anchor in one of them. Columns are inserted from the last to the first, one symbol of
every member a round: the preceding symbols in the order of the suffixes are the collection's
Burrows-Wheeler transform, sorting them stably gives the order of the next round, and the common prefixes of
neighbours follow from the previous ones. A string is repeated if its suffix has a neighbour with which it
shares ``window`` symbols.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.llm.textops import mixed
from cutlens.llm.windows import _squeeze, _stretch

#: Bytes worked on at once; code points of a bundle and keys of a block: at least, at most (in between they grow
#: with the root of the corpus); bytes of members that one task sorts; members from which a collection is hot.
BLOCK_BYTES, BUNDLE_CHARS, BLOCK_KEYS, SLOT_BYTES, HOT = 1 << 21, (4_000_000, 32_000_000), (200_000, 4_000_000), 100_000_000, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INDEX = np.uint64((1 << 22) - 1)
_SHORT_PERIOD = 64
_KEYS = "_bundle int, block long, keys binary, counts binary"
_TOLD = "_bundle int, cold binary, hot binary"
_MEMBERS = "slot int, kind string, key long, _bundle int, lead int, strings int, body binary, holders binary"
_SPANS = "_bundle int, spans binary"


def remove_repeated_bytes(text_layers: DataFrame, text: str = "text", window: int = 400) -> DataFrame:
    """``text_layers`` without each byte that lies in a string of ``window`` bytes which also starts anywhere else, in
    the same layer or another; overlaps count, and strings are judged on the input.

    A text is its UTF-8 bytes (null: none). All other columns stay; ``text`` makes way for ``kept`` (binary: the
    remaining bytes joined), ``n_bytes``, ``n_removed`` and ``n_spans`` (bigint: maximal removed runs). Columns of these
    names and ``_bundle`` are replaced. Repeated rows count as repeated text; null ids matter to nothing. Texts
    shorter than ``window`` stay whole; long ones are worked on in blocks. An empty table gives an empty result.

    Anchor neighbourhoods that occur once are cleared by their hashes; only strings of the others travel, once per
    bundle. A collection of more than ``HOT`` members of different text is not sorted in one task: its strings are
    counted by 128-bit hashes, dealt by hash.
    """
    chars = max(1.0, text_layers.agg(F.sum(F.char_length(text).cast("double"))).first()[0] or 0.0)
    bundles = int(min(2**30, chars // min(max(BUNDLE_CHARS[0], 300 * chars**0.5), BUNDLE_CHARS[1]) + 1))
    keys = 4 * chars / max(1, window)
    blocks = int(max(1, keys // min(max(BLOCK_KEYS[0], 300 * keys**0.5), BLOCK_KEYS[1])))
    slots = int(min(2**30, chars * 4 // SLOT_BYTES + 1))
    kept = [c for c in text_layers.columns if c.lower() not in (text.lower(), "kept", "n_bytes", "n_removed", "n_spans", "_bundle", "_text")]
    layers = text_layers.select(F.col(text).alias("_text"), *kept)
    bundled = layers.select(F.pmod(F.xxhash64("_text", *_whole(text_layers, kept)), F.lit(bundles)).cast("int").alias("_bundle"), "_text", *kept)
    found = bundled.groupBy("_bundle").applyInArrow(_counted_keys(window, blocks), _KEYS)
    told = found.groupBy("block").applyInArrow(_repeated_keys, _TOLD)
    members = bundled.groupBy("_bundle").cogroup(told.groupBy("_bundle")).applyInArrow(_members(window, slots), _MEMBERS)
    spans = members.groupBy("slot").applyInArrow(_sorted_collections(window), _SPANS)
    fields = ", ".join(f"`{c}` {text_layers.schema[c].dataType.simpleString()}" for c in kept)
    out = f"{fields}{', ' if kept else ''}kept binary, n_bytes long, n_removed long, n_spans long"
    return bundled.groupBy("_bundle").cogroup(spans.groupBy("_bundle")).applyInArrow(_removal(kept), out)


def _whole(df: DataFrame, names: list[str]) -> list[str]:
    """Columns that a hash can take, to deal copies of a text to different bundles."""
    return [c for c in names if not any(k in df.schema[c].dataType.simpleString() for k in ("map", "variant"))]


class Runs(NamedTuple):
    """Neighbouring strings with the same anchor and side of it: text, first string and last one, anchor, key of the
    anchor's neighbourhood, hash of all their bytes."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    body: np.ndarray


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)])) for base in (_BASE, _BASE_INVERSE))


class _Hashes:
    """Hash of any stretch of some bytes."""

    def __init__(self, raw: np.ndarray):
        power, self.back = _powers(BLOCK_BYTES + 8192 if len(raw) <= BLOCK_BYTES + 8192 else len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])


def _blocks(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """``(text, offset, bytes)`` in blocks; a long text comes in stretches that share ``window - 1`` bytes."""
    block, held = [], 0
    for i, raw in enumerate(texts):
        if len(raw) < window:
            continue
        for at in range(0, len(raw) - window + 1, BLOCK_BYTES // 2):
            part = raw[at : at + BLOCK_BYTES // 2 + window - 1] if len(raw) > BLOCK_BYTES // 2 else raw
            block.append((i, at, part))
            held += len(part)
            if held >= BLOCK_BYTES // 2:
                yield block
                block, held = [], 0
            if part is raw:
                break
    if block:
        yield block


def runs_of(texts: list[bytes], window: int) -> tuple[Runs, list[tuple[int, int, int]]]:
    """Runs of all strings of the texts, and ``(text, start, end)`` of stretches found repeated on the way: in a text
    that repeats itself with a short period, a string one period after an equal one is left out."""
    gram = min(32, max(1, window // 4))
    span = window - gram + 1
    half = (span - 1) // 2
    out, echoes = [], []
    for block in _blocks(texts, window):
        sizes = np.array([len(p) for *_, p in block])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
        hashes = _Hashes(raw)
        grams = hashes.grams(gram)
        packed = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(packed) // span) * span, np.iinfo(np.uint64).max)
        padded[: len(packed)] = packed
        tiles = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(raw) - window + 1
        least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
        owner = np.repeat(np.arange(len(block)), sizes)[:n]
        usable = np.arange(n) + window <= ends[owner]
        anchor = (least & _INDEX).astype(np.int64)
        # anchors of one hash that follow each other closely: a short period
        spots = np.flatnonzero(usable[1:] & usable[:-1] & (anchor[1:] != anchor[:-1]) & ((least[1:] | _INDEX) == (least[:-1] | _INDEX)))
        gaps = anchor[spots + 1] - anchor[spots]
        close = (gaps > 0) & (gaps <= _SHORT_PERIOD)
        for part, gap in sorted(set(zip(owner[spots[close]].tolist(), gaps[close].tolist()))):
            low, high = int(ends[part] - sizes[part]), int(ends[part])
            wrong = np.concatenate([[0], np.cumsum(raw[low + gap : high] != raw[low : high - gap])])
            same = np.flatnonzero(wrong[window:] == wrong[:-window]) if len(wrong) > window else np.empty(0, np.int64)
            usable[low + gap + same] = False
            echoes += [(block[part][0], block[part][1] + a, block[part][1] + b + gap + window) for a, b in _stretches(same)]
        at = np.flatnonzero(usable)
        if not len(at):
            continue
        right = anchor[at] - at <= half
        new = np.concatenate([[True], (np.diff(at) != 1) | (anchor[at][1:] != anchor[at][:-1]) | (right[1:] != right[:-1])])
        first = at[new]
        last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        x, right = anchor[first], right[new]
        core = hashes.of(np.where(right, x, x - half - 1), np.where(right, x + window - half, x + gram))
        body = hashes.of(first, last + window)
        text, offset = (np.array([b[i] for b in block])[owner[first]] for i in (0, 1))
        shift = offset - (ends - sizes)[owner[first]]
        out.append(Runs(text, first + shift, last + shift, x + shift, mixed(core + right), body))
    if not out:
        return Runs(*[np.empty(0, np.int64)] * 4, *[np.empty(0, np.uint64)] * 2), echoes
    return Runs(*[np.concatenate(c) for c in zip(*out)]), echoes


def _stretches(ascending: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(ascending):
        return []
    breaks = np.flatnonzero(np.diff(ascending) != 1)
    return list(zip(ascending[np.r_[0, breaks + 1]].tolist(), ascending[np.r_[breaks, len(ascending) - 1]].tolist()))


def _distinct(table: pa.Table) -> tuple[list[bytes], list[int]]:
    """Different texts of a bundle and how often each occurs."""
    many: dict[bytes, int] = {}
    for t in table.column("_text").to_pylist():
        if t:
            raw = t.encode()
            many[raw] = many.get(raw, 0) + 1
    return list(many), list(many.values())


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unzip(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def _counted_keys(window: int, blocks: int):
    """Keys of a bundle by block: twice the number of its different bodies, odd if a key occurs more than once."""

    def count(table: pa.Table) -> pa.Table:
        texts, many = _distinct(table)
        runs, _ = runs_of(texts, window)
        rows = []
        if len(runs.key):
            order = np.lexsort((runs.body, runs.key))
            key, body, often = runs.key[order], runs.body[order], np.array(many)[runs.text[order]]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            other = new | np.concatenate([[True], body[1:] != body[:-1]])
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(other.astype(np.int64), starts) * 2 + (np.add.reduceat(often, starts) > 1)
            key = key[starts]
            block = (key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                rows.append((table.column("_bundle")[0].as_py(), int(block[a]), _squeeze(key[a:b], key[:0]), _zip(counts[a:b].astype(np.uint32))))
        return _table(rows, ["_bundle", "block", "keys", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return count


def _repeated_keys(table: pa.Table) -> pa.Table:
    """Tells each bundle which of its keys occur twice or more in all; those of many bodies are hot."""
    keys = [_stretch(raw)[0] for raw in table.column("keys").to_pylist()]
    counts = [_unzip(raw, np.uint32) for raw in table.column("counts").to_pylist()]
    known, code = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(counts).astype(np.int64)
    bodies = np.bincount(code, weights=counts >> 1)
    repeated = (np.bincount(code) > 1) | (np.bincount(code, weights=counts & 1) > 0)
    rows, at = [], 0
    for bundle, mine in zip(table.column("_bundle").to_pylist(), keys):
        place = code[at : at + len(mine)]
        at += len(mine)
        hot = bodies[place] > HOT
        told = [mine[repeated[place] & is_hot] for is_hot in (~hot, hot)]
        if len(told[0]) or len(told[1]):
            rows.append((bundle, *[_squeeze(t, t[:0]) for t in told]))
    return _table(rows, ["_bundle", "cold", "hot"], [pa.int32(), pa.binary(), pa.binary()])


_MEMBER_NAMES = ["slot", "kind", "key", "_bundle", "lead", "strings", "body", "holders"]
_MEMBER_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _members(window: int, slots: int):
    """Strings of a bundle whose key is repeated, each body once, with the places (text hash, first string) that wait
    for an answer; stretches that the bundle itself knows to be repeated; hashes of the strings of hot keys."""

    def gather(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, many = _distinct(table) if table.num_rows else ([], [])
        rows: list[tuple] = []
        if texts:
            bundle = table.column("_bundle")[0].as_py()
            names = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
            runs, echoes = runs_of(texts, window)
            spans = [(int(names[i]), a, b) for i, a, b in echoes]
            spans += [(int(names[i]), 0, len(t)) for i, (t, m) in enumerate(zip(texts, many)) if m > 1 and len(t) >= window]
            cold, hot = (np.sort(np.concatenate([_stretch(r)[0] for r in told.column(c).to_pylist()] or [np.empty(0, np.uint64)])) if told.num_rows else np.empty(0, np.uint64) for c in ("cold", "hot"))
            is_hot = _among(runs.key, hot)
            use = np.flatnonzero(is_hot | _among(runs.key, cold))
            bodies: dict[tuple[int, int, bytes], list[int]] = {}
            for r, i, a, b in zip(use.tolist(), runs.text[use].tolist(), runs.first[use].tolist(), runs.last[use].tolist()):
                bodies.setdefault((int(runs.key[r]), int(runs.anchor[r]) - a, texts[i][a : b + window]), []).append(r)
            hashed = []
            for (key, lead, body), holders in bodies.items():
                where = [(int(names[runs.text[r]]), int(runs.first[r])) for r in holders]
                if len(holders) > 1 or many[runs.text[holders[0]]] > 1:
                    spans += [(name, a, a + len(body)) for name, a in where]
                    where = []
                strings = len(body) - window + 1
                if is_hot[holders[0]]:
                    hashed.append(_string_hashes(body, window, where))
                else:
                    slot = (key >> 32) * slots >> 32
                    rows.append((slot, "body", key - (1 << 64) if key >> 63 else key, bundle, lead, strings, body, np.array(where, np.uint64).tobytes()))
            if hashed:
                every = np.concatenate(hashed)
                slot = ((every[:, 0] >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                for s in np.unique(slot).tolist():
                    rows.append((s, "hot", 0, bundle, 0, 0, b"", _zip(every[slot == s])))
            if spans:
                rows.append((bundle % slots, "span", 0, bundle, 0, 0, b"", _zip(np.array(spans, np.uint64))))
        return _table(rows, _MEMBER_NAMES, _MEMBER_TYPES)

    return gather


def _string_hashes(body: bytes, window: int, where: list[tuple[int, int]]) -> np.ndarray:
    """128-bit hash, text and place of every string of ``body``; no place (all ones) where no answer is waited for."""
    digests = [xxhash.xxh3_128_intdigest(body[k : k + window]) for k in range(len(body) - window + 1)]
    out = np.empty((len(digests), 4), np.uint64)
    out[:, 0], out[:, 1] = [d >> 64 for d in digests], [d & 0xFFFFFFFFFFFFFFFF for d in digests]
    out[:, 2:] = np.iinfo(np.uint64).max
    if where:
        out[:, 2], out[:, 3] = where[0][0], where[0][1] + np.arange(len(digests))
    return out


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending) or not len(values):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def repeated_strings(key: np.ndarray, lead: np.ndarray, strings: np.ndarray, bodies: list[bytes], window: int) -> np.ndarray:
    """Flags (member, string) of the strings that another member of the same collection (``key``, ascending) has at the
    same place; ``lead`` is the place of the anchor in a body."""
    n = len(bodies)
    middle, width = int(lead.max()), int((np.array([len(b) for b in bodies]) - lead).max() + lead.max())
    rows = np.full((n, width), -1, np.int16)
    for i, (b, at) in enumerate(zip(bodies, (middle - lead).tolist())):
        rows[i, at : at + len(b)] = np.frombuffer(b, np.uint8)
    columns = np.ascontiguousarray(rows.T)
    del rows
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    order, common = np.arange(n), np.zeros(n, np.int64)
    flags = np.zeros((n, int(strings.max())), bool)
    offset = middle - lead
    past = int((offset + strings).max())
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]  # preceding symbols in the order of the suffixes: this round's part of the transform
        unlike = np.flatnonzero((symbol[1:] != symbol[:-1]) & ~begins[1:]) + 1
        longer = np.where((symbol < 0) | begins, 0, np.minimum(common + 1, window))
        if len(unlike):
            mixed_group = np.zeros(group[-1] + 1, bool)
            mixed_group[group[unlike]] = True
            at = np.flatnonzero(mixed_group[group])
            q = np.lexsort((symbol[at], group[at]))
            order[at] = order[at[q]]
            g, s = group[at], symbol[at][q]
            same = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (s[1:] >= 0)
            new = np.zeros(len(at), np.int64)
            if same.any():
                # the least common prefix between the two in the old order
                ends = np.stack([q[:-1][same] + 1, q[1:][same] + 1], axis=1).ravel()
                least = np.minimum.reduceat(np.append(common[at], 0), ends)[::2]
                new[1:][same] = np.minimum(least + 1, window)
            longer[at] = new
        common = longer
        if c < past:
            found = np.flatnonzero(np.maximum(common, np.append(common[1:], 0)) >= window)
            if len(found):
                member = order[found]
                string = c - offset[member]
                ok = (string >= 0) & (string < strings[member])
                flags[member[ok], string[ok]] = True
    return flags


def _sorted_collections(window: int):
    def answer(table: pa.Table) -> pa.Table:
        spans: dict[int, list[np.ndarray]] = {}
        kind = table.column("kind").to_pylist()
        bundle = table.column("_bundle").to_numpy()
        holders = table.column("holders").to_pylist()
        for i in [i for i, k in enumerate(kind) if k == "span"]:
            spans.setdefault(int(bundle[i]), []).append(_unzip(holders[i], np.uint64).reshape(-1, 3))
        use = np.array([i for i, k in enumerate(kind) if k == "body"], np.int64)
        if len(use):
            key = table.column("key").to_numpy()
            use = use[np.argsort(key[use], kind="stable")]
            # a key with one member here has met its equals inside its bundle
            alone = np.concatenate([[True], key[use][1:] != key[use][:-1]]) & np.concatenate([key[use][1:] != key[use][:-1], [True]])
            use = use[~alone]
        if len(use):
            lead, strings = (table.column(c).to_numpy()[use].astype(np.int64) for c in ("lead", "strings"))
            bodies = table.column("body").take(pa.array(use)).to_pylist()
            flags = repeated_strings(key[use], lead, strings, bodies, window)
            for m in np.flatnonzero(flags.any(axis=1)).tolist():
                where = np.frombuffer(holders[use[m]], np.uint64).reshape(-1, 2)
                for name, first in where.tolist():
                    found = [(name, first + a, first + b + window) for a, b in _stretches(np.flatnonzero(flags[m]))]
                    spans.setdefault(int(bundle[use[m]]), []).append(np.array(found, np.uint64))
        hot = [i for i, k in enumerate(kind) if k == "hot"]
        if hot:
            parts = [_unzip(holders[i], np.uint64).reshape(-1, 4) for i in hot]
            every, owner = np.concatenate(parts), np.repeat(bundle[hot], [len(p) for p in parts])
            order = np.lexsort((every[:, 1], every[:, 0]))
            every, owner = every[order], owner[order]
            like = (every[1:, :2] == every[:-1, :2]).all(axis=1)
            found = (np.concatenate([[False], like]) | np.concatenate([like, [False]])) & (every[:, 2] != np.iinfo(np.uint64).max)
            for b in np.unique(owner[found]).tolist():
                mine = every[found & (owner == b)]
                spans.setdefault(int(b), []).append(np.stack([mine[:, 2], mine[:, 3], mine[:, 3] + np.uint64(window)], axis=1))
        return _table([(b, _zip(np.concatenate(s))) for b, s in spans.items()], ["_bundle", "spans"], [pa.int32(), pa.binary()])

    return answer


def _removal(kept: list[str]):
    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        every = [_unzip(raw, np.uint64).reshape(-1, 3) for raw in told.column("spans").to_pylist()] if told.num_rows else []
        every = np.concatenate(every) if every else np.empty((0, 3), np.uint64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        out, sizes, removed, runs = [], [], [], []
        for t in table.column("_text").to_pylist():
            raw = (t or "").encode()
            left, right = np.searchsorted(every[:, 0], np.uint64(xxhash.xxh64_intdigest(raw)), "left"), np.searchsorted(every[:, 0], np.uint64(xxhash.xxh64_intdigest(raw)), "right")
            sizes.append(len(raw))
            if left == right:
                out.append(raw), removed.append(0), runs.append(0)
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, every[left:right, 1].astype(np.int64), 1)
            np.subtract.at(edge, every[left:right, 2].astype(np.int64), 1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum())), runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        columns = {c: table.column(c) for c in kept}
        return pa.table({**columns, "kept": pa.array(out, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64())})

    return remove
