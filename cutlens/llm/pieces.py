"""Sampled SentencePiece segmentation of text layers, and lossless decoding."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cutlens.llm.textops import mixed

#: Code points sampled together, lattice positions that stay from one chunk to the next, and segments built at a time.
CHUNK_CHARS, KEPT_POSITIONS, BUILT = 600_000, 1_000_000, 4096
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def encode_layers(text_layers: DataFrame, model: str, layer_id: str = "layer_id", text: str = "text", seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """``text_layers`` with ``piece_ids`` (array<int>): one segmentation of each text, drawn from all that the
    SentencePiece file ``model`` allows, with the probability of its pieces.

    Over the lattice of pieces a forward pass sums the weight of all ways to reach each position; a backward pass then
    draws piece by piece. The draw depends on ``seed`` and the row's ``layer_id`` only, so it is the same on any
    cluster; rows that share an id and a text share the segmentation. A BPE file stores merge ranks, not
    probabilities: a piece of rank r weighs ``(r + 2) ** -sharpness``, which falls as frequencies do by rank; larger values draw
    closer to the best segmentation. Characters without a piece become their UTF-8 bytes, so
    :func:`decode_layers` gives back every text exactly. Null and empty texts have no pieces. A column
    ``piece_ids`` is replaced; all others stay.
    """
    kept = [c for c in text_layers.columns if c.lower() != "piece_ids"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text_layers.schema if f.name in kept)
    return text_layers.select(*kept).mapInArrow(_encode(model, layer_id, text, seed, sharpness, kept), f"{fields}, piece_ids array<int>")


def decode_layers(text_layers: DataFrame, model: str, piece_ids: str = "piece_ids") -> DataFrame:
    """``text_layers`` with ``decoded`` (the text of the pieces; of none or null, the empty text) added or replaced."""
    kept = [c for c in text_layers.columns if c.lower() != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text_layers.schema if f.name in kept)
    return text_layers.select(*kept).mapInArrow(_decode(model, piece_ids, kept), f"{fields}, decoded string")


class _Places(dict):
    """Place of each distinct segment in order of first sight; ``fresh`` are those without a lattice yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = place = len(self)
        self.fresh.append(segment)
        return place


class Lattices:
    """Piece lattices of segments (a blank run and what follows up to the next blank), all positions at once.

    No piece has a blank after another character, so segments are independent.
    """

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.byte_ids, found = np.zeros(256, np.int32), {}  # by length and hash: the piece (none: -1) and its weight
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                rank = min(-sp.get_score(i), size)
                plain = piece.replace("▁", " ")
                total = 0
                for length, c in enumerate(plain, 1):
                    total = (total * int(_STEP[1]) + ord(c) + 1) % 2**64
                    found.setdefault(length, {}).setdefault(total, (-1, 0.0))
                found[len(plain)][total] = (i, -sharpness * math.log(rank + 2))
        self.longest = max(found)
        self.tables, self.sieve = {}, np.zeros(1 << 20, bool)
        for length, rows in found.items():
            hashes = np.array(sorted(rows), np.uint64)
            ids, weights = zip(*[rows[h] for h in hashes.tolist()])
            self.tables[length] = hashes, np.array(ids, np.int32), np.array(weights)
            self.sieve[self._slots(hashes)] = True
        self.floor = -sharpness * math.log(size + 2)
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.first, self.sizes, self.arcs = (np.empty(0, np.int64) for _ in range(3))
        self.chances, self.piece, self.lengths = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int8)

    def _learn(self) -> None:
        """Lattices of the segments not met before, behind those that are kept."""
        fresh, self.places.fresh = self.places.fresh, []
        built = [(self.first, self.sizes, self.arcs, self.chances, self.piece, self.lengths)]
        positions, held = len(self.arcs), len(self.chances)
        for k in range(0, len(fresh), BUILT):
            starts, sizes, arcs, *of_arcs = self.tables_of(fresh[k : k + BUILT])
            built.append((starts + positions, sizes, arcs + held, *of_arcs))
            positions, held = positions + len(arcs), held + len(of_arcs[0])
        if fresh:
            self.first, self.sizes, self.arcs, self.chances, self.piece, self.lengths = map(np.concatenate, zip(*built))

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _STEP[0]) >> np.uint64(44)

    def tables_of(self, distinct: list[str]) -> tuple[np.ndarray, ...]:
        """Where each of the joined segments starts, and its size; for every end position its first arc; and of the arcs, by end
        position and length, the running probabilities, pieces (below zero: the character's own bytes) and lengths."""
        codes = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        starts = np.cumsum(sizes) - sizes
        n, reach_to = len(codes), self.longest
        room = np.repeat(starts + sizes, sizes) - np.arange(n)  # characters from here to the end of the segment
        weight = np.full((n + 1, reach_to), -np.inf)  # by end position and length less one
        piece = np.zeros((n + 1, reach_to), np.int32)
        at, rolling = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, reach_to + 1):
            live = room[at] >= length
            at, rolling = at[live], rolling[live]
            if not len(at):
                break
            rolling = rolling * _STEP[1] + codes[at + length - 1] + np.uint64(1)
            if length == 1:
                piece[at + 1, 0] = -(codes[at].astype(np.int64)) - 1
                weight[at + 1, 0] = self.floor
            # only where a piece begins so, a longer one may follow
            likely = self.sieve[self._slots(rolling)]
            at, rolling = at[likely], rolling[likely]
            hashes, ids, weights = self.tables[length]
            k = np.minimum(np.searchsorted(hashes, rolling), len(hashes) - 1)
            known = hashes[k] == rolling
            at, rolling, k = at[known], rolling[known], k[known]
            whole = ids[k] >= 0
            piece[at[whole] + length, length - 1] = ids[k[whole]]
            weight[at[whole] + length, length - 1] = weights[k[whole]]
        # forward pass: the log of the summed weight of all ways to each position, segments side by side
        reach = np.zeros(n + 1)
        order = np.argsort(-sizes, kind="stable")
        shrinking = sizes[order]
        chances = np.ones((n + 1, reach_to))
        for j in range(1, int(sizes.max()) + 1 if len(sizes) else 1):
            ends = starts[order[: np.searchsorted(-shrinking, -j, side="right")]] + j
            widest = min(j, reach_to)
            before = reach[ends[:, None] - np.arange(1, widest + 1)]
            if j <= reach_to:
                before[:, j - 1] = 0.0  # the segment's own start; the shared position belongs to its neighbour
            ways = weight[ends, :widest] + before
            top = ways.max(1)
            shares = np.exp(ways - top[:, None]).cumsum(1)
            reach[ends] = top + np.log(shares[:, -1])
            chances[ends, :widest] = shares / shares[:, -1:]
        held = weight > -np.inf
        held[0] = True  # the place before all, where no arc ends
        width = held.sum(1)
        return starts, sizes, np.cumsum(width) - width, chances[held], piece[held], np.nonzero(held)[1].astype(np.int8) + np.int8(1)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; ``keys`` are the random keys of the rows."""
        if len(self.arcs) > KEPT_POSITIONS:
            self._forget()
        which, counts = [], []
        for t in texts:
            parts = segments(t)
            counts.append(len(parts))
            which.extend(map(self.places.__getitem__, parts))
        if not which:
            return [np.empty(0, np.int32) for _ in texts]
        owner = np.repeat(np.arange(len(texts)), counts)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self._learn()
        which = np.array(which, np.int64)
        first = self.first[which]
        position = first + self.sizes[which]
        seeds = mixed(keys[owner] + ordinal.astype(np.uint64) * _STEP[0])
        # backward pass: from the end of each segment, draw the piece that ends here
        taken, alive, t = [], np.arange(len(which)), 0
        while len(alive):
            step = np.array([t], np.uint64) * _STEP[1]
            u = (mixed(seeds[alive] + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc, behind = self.arcs[position[alive]], np.arange(len(alive))
            while len(behind):  # up to the first arc whose running probability exceeds the draw; the last one's is 1
                behind = behind[self.chances[arc[behind]] <= u[behind]]
                arc[behind] += 1
            taken.append((alive, self.piece[arc]))
            position[alive] -= self.lengths[arc]
            alive = alive[position[alive] > first[alive]]
            t += 1
        lengths = np.zeros(len(which), np.int64)
        for rows, _ in taken:
            lengths[rows] += 1
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]), np.int32)
        for t, (rows, ids) in enumerate(taken):
            out[ends[rows] - 1 - t] = ids
        per_text = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        return [self._bytes(ids) for ids in np.split(out, np.cumsum(per_text)[:-1])]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece as the pieces of their bytes."""
        single = (ids < 0) & (ids >= -128)
        if single.any():
            ids[single] = self.byte_ids[-ids[single] - 1]
        wide = np.flatnonzero(ids < 0)
        if not len(wide):
            return ids
        parts, at = [], 0
        for k in wide.tolist():
            parts += [ids[at:k], self.byte_ids[list(chr(-int(ids[k]) - 1).encode())]]
            at = k + 1
        return np.concatenate([*parts, ids[at:]])


@functools.lru_cache(maxsize=1)
def _lattices(model: str, sharpness: float) -> Lattices:
    """Lattices of this worker, kept from one task to the next."""
    return Lattices(model, sharpness)


def segments(text: str) -> list[str]:
    """The text behind one blank, cut before every blank that follows another character."""
    if not text:
        return []
    if text[0] != " " != text[-1] and "  " not in text:
        return [" " + word for word in text.split(" ")]
    found, blanks = [], ""
    for word in text.split(" "):
        if word:
            found.append(f"{blanks} {word}")
            blanks = ""
        else:
            blanks += " "
    if blanks:
        found.append(blanks)
    return found


def _encode(model: str, layer_id: str, text: str, seed: int, sharpness: float, kept: list[str]):
    def encode(batches):
        lattices = _lattices(model, sharpness)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(repr(k).encode(), seed=seed) for k in batch.column(layer_id).to_pylist()], np.uint64)
            at = 0
            while at < len(texts):
                past, room = at, CHUNK_CHARS
                while past < len(texts) and (past == at or room > 0):
                    room -= len(texts[past])
                    past += 1
                found = lattices.sample(texts[at:past], keys[at:past])
                offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, past - at) for c in kept], ids], [*kept, "piece_ids"])
                at = past

    return encode


def _decode(model: str, piece_ids: str, kept: list[str]):
    def decode(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for ids in part.column(piece_ids):
                    joined = b"".join([raw[i] for i in ids.values.to_numpy(zero_copy_only=False).tolist()]) if ids.is_valid else b""
                    out.append(joined[1:].decode())  # without the blank put before the text
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(out, pa.string())], [*kept, "decoded"])

    return decode
