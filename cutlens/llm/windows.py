"""Removal of word windows that occur more than once in a corpus of text layers.

A count-min sketch per bundle of layers is merged over all bundles; cells that stay below two clear
all their windows, so only windows estimated repeated are grouped exactly in a second pass. The sketch
never underestimates, so no repeated window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.llm.textops import WordHashes, runs, words_of

#: Code points of text a bundle holds, and values a merging task gets: at least, and at most. In between
#: both grow with the root of the corpus, so that a bundle has many values for each block at any size.
BUNDLE_CHARS, BLOCK_VALUES = (1_000_000, 32_000_000), (100_000, 4_000_000)
#: Sketch cells per window and row, and rows of the sketch.
CELLS_PER_WINDOW, DEPTH = 8, 2
_PART = "_bundle int, kind int, block long, n int, cells binary"
_FOUND = "_bundle int, kind int, block long, cells binary"


def remove_repeated_windows(
    text_layers: DataFrame, layer_id: str = "layer_id", text: str = "text", window: int = 35, clean_as_is: bool = False
) -> DataFrame:
    """``text_layers`` with each word dropped that lies in a window of ``window`` consecutive words
    whose sequence also starts anywhere else, in the same layer or another.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged. All other columns stay; ``text`` becomes the
    kept words joined by one space (with ``clean_as_is``, a text that loses nothing stays verbatim), and
    ``n_words``, ``n_removed`` (bigint) are added; columns of these names and ``_bundle`` are replaced. A null text has no words and becomes the empty text. Repeated rows count as
    repeated text; rows with a null ``layer_id`` are treated like any other. An empty table gives an
    empty result.

    A bundle of layers is the unit of work; hot passages meet once per bundle, never once per layer.
    """
    chars = max(1.0, text_layers.agg(F.sum(F.char_length(text).cast("double"))).first()[0] or 0.0)
    words = chars / 6
    bundles = int(min(2**30, chars // min(max(BUNDLE_CHARS[0], 140 * chars**0.5), BUNDLE_CHARS[1]) + 1))
    blocks = int(max(1, words // min(max(BLOCK_VALUES[0], 45 * words**0.5), BLOCK_VALUES[1])))
    bits = max(16, int(words * CELLS_PER_WINDOW).bit_length())
    kept = [c for c in text_layers.columns if c.lower() not in ("n_words", "n_removed", "_bundle")]
    bundle = F.pmod(F.xxhash64(layer_id, text), F.lit(bundles)).cast("int").alias("_bundle")
    bundled = text_layers.select(bundle, *kept)
    sketches = bundled.groupBy("_bundle").applyInArrow(_sketches(text, window, bits, blocks), _PART)
    repeated_cells = sketches.groupBy("kind", "block").applyInArrow(_twice(np.uint64), _FOUND)
    left = bundled.groupBy("_bundle").cogroup(repeated_cells.groupBy("_bundle"))
    suspects = left.applyInArrow(_suspects(text, window, bits, blocks), _PART)
    repeated = suspects.groupBy("kind", "block").applyInArrow(_twice("V16"), _FOUND)
    left = bundled.groupBy("_bundle").cogroup(repeated.groupBy("_bundle"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text_layers.schema if f.name in kept)
    return left.applyInArrow(_removal(text, window, kept, clean_as_is), f"{fields}, n_words bigint, n_removed bigint")


def _cells(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    """Sketch cell of each window in one row of the sketch."""
    return (hashes * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[row])) >> np.uint64(64 - bits)


def _tables(texts: list, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cache = WordHashes()
    for t in texts:
        hashes = cache.of(words_of(t))
        yield runs(hashes, window), runs(hashes, window, 1)


def _blocked(bundle: int, kind: int, values: np.ndarray, block: np.ndarray) -> Iterator[dict]:
    """Distinct values of a bundle by block: first those that it has once, then those it has more often."""
    order = np.lexsort((values, block)) if values.dtype.kind != "V" else np.argsort(values.view("u8").reshape(-1, 2)[:, 0], kind="stable")
    values, block = values[order], block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for a, b in zip(edges[:-1], edges[1:]):
        once, many = _counted(values[a:b])
        yield {"_bundle": bundle, "kind": kind, "block": int(block[a]), "n": len(once), "cells": once.tobytes() + many.tobytes()}


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if values.dtype.kind == "V":  # numpy does not order raw bytes: use both halves
        halves = values.view("u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        halves = halves[order]
        first = np.r_[True, (halves[1:] != halves[:-1]).any(axis=1)]
        values = np.ascontiguousarray(halves[first]).view("V16").ravel()
    else:
        values = np.sort(values)
        first = np.r_[True, values[1:] != values[:-1]]
        values = values[first]
    counts = np.diff(np.r_[np.flatnonzero(first), len(first)])
    return values[counts == 1], values[counts > 1]


def _as_table(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema(schema))


_PART_ARROW = [("_bundle", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("cells", pa.binary())]
_FOUND_ARROW = [("_bundle", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("cells", pa.binary())]


def _sketches(text: str, window: int, bits: int, blocks: int):
    """Partial sketch of a bundle: its cells by row and block."""

    def partial(table: pa.Table) -> pa.Table:
        bundle = table.column("_bundle")[0].as_py()
        hashes = [h for h, _ in _tables(table.column(text).to_pylist(), window) if len(h)]
        if not hashes:
            return _as_table([], _PART_ARROW)
        every, rows = np.concatenate(hashes), []
        for row in range(DEPTH):
            cells = _cells(every, bits, row)
            step = np.uint64(max(1, -(-(1 << bits) // blocks)))
            for part in _blocked(bundle, row, cells, cells // step):
                every_cell = np.frombuffer(part["cells"], np.uint64)
                rows.append(part | {"cells": _squeeze(every_cell[: part["n"]], every_cell[part["n"] :])})
        return _as_table(rows, _PART_ARROW)

    return partial


def _squeeze(once: np.ndarray, many: np.ndarray) -> bytes:
    """Two ascending runs as gaps, byte plane by byte plane, compressed: about as many bits as a gap needs."""
    gaps = np.concatenate([np.diff(run, prepend=np.uint64(0)).astype(np.uint64) for run in (once, many)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _stretch(raw: bytes, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    gaps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    n = len(gaps) if n is None else n
    return np.cumsum(gaps[:n], dtype=np.uint64), np.cumsum(gaps[n:], dtype=np.uint64)


def _twice(kind):
    """Merge the parts of a block and tell each bundle which of its values occur twice or more in all."""

    def merge(table: pa.Table) -> pa.Table:
        sketch = kind is np.uint64
        parts = []
        for raw, n in zip(table.column("cells").to_pylist(), table.column("n").to_pylist()):
            if sketch:
                parts.append(_stretch(raw, n))
            else:
                every = np.frombuffer(raw, kind)
                parts.append((every[:n], every[n:]))
        every = np.concatenate([v for once, many in parts for v in (once, many, many)])
        _, often = _counted(every)
        rows = []
        for bundle, (once, many) in zip(table.column("_bundle").to_pylist(), parts):
            found = [v for v in (once, many) if len(v)]
            mine = np.concatenate(found) if found else every[:0]
            hit = mine[_inside(mine, often)]
            if len(hit):
                value = _squeeze(np.sort(hit), hit[:0]) if sketch else np.ascontiguousarray(hit.view("u8").reshape(-1, 2)[:, 0]).tobytes()
                rows.append({"_bundle": bundle, "kind": table.column("kind")[0].as_py(), "block": table.column("block")[0].as_py(), "cells": value})
        return _as_table(rows, _FOUND_ARROW)

    return merge


def _inside(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    if values.dtype.kind != "V":
        at = np.searchsorted(among, values)
        return among[np.minimum(at, len(among) - 1)] == values
    mine, theirs = values.view("u8").reshape(-1, 2), among.view("u8").reshape(-1, 2)
    # the first half decides nearly always; equal first halves are compared as pairs
    first = np.searchsorted(theirs[:, 0], mine[:, 0])
    hit, at = np.zeros(len(mine), bool), first
    while True:
        ok = (at < len(theirs)) & ~hit
        ok[ok] = theirs[at[ok], 0] == mine[ok, 0]
        if not ok.any():
            return hit
        hit[ok] = theirs[at[ok], 1] == mine[ok, 1]
        at = at + 1


def _suspects(text: str, window: int, bits: int, blocks: int):
    """Windows of a bundle whose cells are repeated in every row of the sketch, by both hashes."""

    def exact(table: pa.Table, cells: pa.Table) -> pa.Table:
        if not table.num_rows or not cells.num_rows:
            return _as_table([], _PART_ARROW)
        by_row = [[] for _ in range(DEPTH)]
        for row, raw in zip(cells.column("kind").to_pylist(), cells.column("cells").to_pylist()):
            by_row[row].append(_stretch(raw)[0])
        hot = [np.sort(np.concatenate(r)) if r else np.empty(0, np.uint64) for r in by_row]
        found = []
        for h1, h2 in _tables(table.column(text).to_pylist(), window):
            keep = np.ones(len(h1), bool)
            for row in range(DEPTH):
                keep[keep] = _inside(_cells(h1[keep], bits, row), hot[row])
            if keep.any():
                found.append(np.stack([h1[keep], h2[keep]], axis=1))
        if not found:
            return _as_table([], _PART_ARROW)
        halves = np.ascontiguousarray(np.concatenate(found))
        block = (halves[:, 0] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        bundle = table.column("_bundle")[0].as_py()
        return _as_table(list(_blocked(bundle, 9, halves.view("V16").ravel(), block)), _PART_ARROW)

    return exact


def _removal(text: str, window: int, kept: list[str], clean_as_is: bool):
    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        # grouping took both hashes; among a bundle's own windows the first one alone tells them apart
        hits = [np.frombuffer(raw, np.uint64) for raw in found.column("cells").to_pylist()] if found.num_rows else []
        often = np.sort(np.concatenate(hits)) if hits else np.empty(0, np.uint64)
        cache, out, n_words, n_removed = WordHashes(), [], [], []
        for t in table.column(text).to_pylist():
            words = words_of(t)
            gone = np.zeros(len(words), bool)
            if len(often) and len(words) >= window:
                starts = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(_inside(runs(cache.of(words), window), often))
                starts[at] += 1
                np.subtract.at(starts, at + window, 1)
                gone = np.cumsum(starts[:-1]) > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            if clean_as_is and not gone.any():
                out.append(t or "")
            else:
                out.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        columns = {c: table.column(c) for c in kept}
        columns[text] = pa.array(out, pa.string())
        return pa.table({**columns, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    return remove
