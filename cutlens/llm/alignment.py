"""Alignment of two tokenisations of a text layer, and how often their ids are linked in a corpus.

Both token streams of a layer cover the same bytes. Where both end, a group closes; tokens whose bytes
overlap are linked. A byte range of a layer gives a fragment: tokens before its first common end (open
prefix), closed groups, and tokens after its last one (open suffix). Fragments of neighbouring ranges
compose associatively, because only a suffix and the prefix after it can form new groups, so the ranges of a
very long layer are tokenised in tasks of their own and composed by a tree.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.llm.packing import _LONG_RUN, _ranked
from cutlens.llm.similarity import _arrow_key
from cutlens.session import cut_lineage

#: Bytes of a range (a layer with more is cut), code points of a bundle, fragments composed in one step of the tree.
CHUNK_BYTES, BUNDLE_CHARS, COMPOSED = 65_536, 2_000_000, 16
#: A blank between letters or digits: no token of either kind reaches over it from the left.
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_layers(
    text_layers: DataFrame, byte_tokenizer: str, piece_model: str, layer_id: str = "layer_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per layer: ``layer_id``, ``n_a``, ``n_b`` (tokens of either kind), ``n_groups``, ``n_links`` (pairs of
    occurrences whose bytes overlap), ``n_best`` (links whose id pair is held by as many layers as any pair of its A id),
    ``count_sum`` (over the links, how many layers hold their id pair linked; all bigint) and ``groups``: the
    aligned ids as ``a1,a2|b1;a3|b2,b3``.

    A: the blank and the text by the byte-level BPE file ``byte_tokenizer``; B: the text by the SentencePiece file
    ``piece_model``, which adds the blank. Strings of special tokens are plain text. A layer that is null or empty,
    or whose joined token bytes differ from blank and text, has no tokens: zeros and an empty ``groups``. Repeated
    rows and null ids are layers like any other; other columns are not returned; an empty table gives an empty result.

    A layer above ``chunk_bytes`` is cut into byte ranges that are tokenised apart, with the words at their
    edges whole; a word longer than a range stays in one. Ids of two kinds meet in bundles of layers, so counts are
    sent to a bundle once for each pair that it holds.
    """
    layers = text_layers.select(F.col(layer_id).alias("layer_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind, key = layers.schema["layer_id"].dataType.simpleString(), _arrow_key(layers)
    files = (byte_tokenizer, piece_model)
    bundles = int((layers.agg(F.sum(F.char_length("_text").cast("double"))).first()[0] or 0) // BUNDLE_CHARS + 1)
    coded = f"layer_id {kind}, document long, start long, n_a int, ids binary"
    bundle = F.pmod(F.xxhash64("layer_id", "_text"), F.lit(bundles)).cast("int").alias("_bundle")
    short = layers.filter(F.octet_length("_text") < chunk_bytes).select(bundle, "layer_id", "_text")
    pieces = short.mapInArrow(_coded(files, key), f"_bundle int, {coded}")

    long = layers.filter(F.octet_length("_text") >= chunk_bytes)
    ranges = cut_lineage(long.select(F.spark_partition_id().cast("long").alias("document"), "layer_id", "_text").mapInArrow(
        _ranges(files, chunk_bytes, key), f"layer_id {kind}, document long, chunk long, lo long, hi long, at long, _text string"))
    spread = ranges.withColumn("_deal", F.xxhash64("document", "chunk")).repartition("_deal")
    parts = cut_lineage(spread.drop("_deal").mapInArrow(_fragments(files, key), f"{coded}, chunk long, role string, whole boolean, a_ends binary, b_ends binary"))
    bad = parts.filter("NOT whole").select("document").distinct()
    parts = parts.join(bad, "document", "left_anti")
    closed = parts.filter("role = 'closed'").select("layer_id", "document", "start", "n_a", "ids").unionByName(_composed(parts, coded, key))
    # a row of no tokens stands for a layer whatever becomes of its parts
    heads = ranges.filter("chunk = 0").select("layer_id", "document", F.lit(-1).cast("long").alias("start"), F.lit(0).alias("n_a"), F.lit(b"").alias("ids"))
    cut = closed.unionByName(heads).withColumn("_bundle", F.pmod(F.xxhash64("document", "start"), F.lit(bundles)).cast("int"))
    held = closed.mapInArrow(_held_pairs(files), "document long, pair long").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))

    # whole layers and parts of long ones go their own ways, so that neither is aligned twice
    sides = [pieces.repartition("_bundle"), cut.repartition("_bundle")]
    asked = [side.groupBy("_bundle").applyInArrow(_asked(files), "_bundle int, pair long, docs long").withColumn("_cut", F.lit(k)) for k, side in enumerate(sides)]
    asked = asked[0].unionByName(asked[1]).repartition("pair")
    # both readers of `asked` take all of its columns, so that they share one exchange
    counts = asked.unionByName(held.withColumns({"_bundle": F.lit(-1), "_cut": F.lit(2)})).groupBy("pair").agg(F.sum("docs").alias("layers"), F.count("_bundle").alias("_bundles"), F.min("_cut").alias("_least"))
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("layers").alias("most"))
    rated = counts.filter("_bundles > 0 AND _least < 3").join(most, first == F.col("a")).select("pair", "layers", (F.col("layers") == F.col("most")).alias("best"))
    told = asked.join(rated, "pair").select("_bundle", "_cut", "pair", "docs", "layers", "best")
    out = f"layer_id {kind}, document long, start long, {', '.join(f'{c} long' for c in _SUMS)}, groups string"
    whole, parts_of = (side.groupBy("_bundle").cogroup(told.filter(F.col("_cut") == k).groupBy("_bundle")).applyInArrow(_aligned(files, key), out) for k, side in enumerate(sides))
    whole = whole.select("layer_id", *_SUMS, "groups")
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("start") >= 0, F.struct("start", "groups")))), lambda x: x["groups"]), ";")
    joined = parts_of.groupBy("document").agg(F.first("layer_id").alias("layer_id"), *[F.sum(c).alias(c) for c in _SUMS], text_of.alias("groups"))
    return whole.unionByName(joined.drop("document"))


def _composed(parts: DataFrame, coded: str, key: pa.DataType) -> DataFrame:
    """Groups that close where open ends of neighbouring fragments meet, by a tree over the fragments of a layer."""
    kept = ["layer_id", "document", "chunk", "role", "start", "n_a", "ids", "a_ends", "b_ends"]
    left = parts.filter("role <> 'closed'").select(*kept)
    last = left.agg(F.max("chunk")).first()[0] or 0
    fields = f"{coded}, chunk long, role string, a_ends binary, b_ends binary"
    found = None
    while True:
        step = cut_lineage(left.groupBy("document", F.expr(f"chunk div {COMPOSED}").alias("_at")).applyInArrow(_compose(key), fields))
        done = step.filter("role = 'closed'").select("layer_id", "document", "start", "n_a", "ids")
        found = done if found is None else found.unionByName(done)
        if last == 0:
            return found
        left, last = step.filter("role <> 'closed'").select(*kept), last // COMPOSED


class _Pair:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(byte_tokenizer)
        self.plain.encode_special_tokens = True
        spec = json.loads(self.plain.to_str())
        self.ranked = _ranked(spec)
        chars = {}
        for byte in range(256):  # visible Latin-1 characters stand for themselves, the others for 256 and on
            visible = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte
            chars[chr(byte if visible else 256 + len(chars) - sum(ord(c) < 256 for c in chars))] = byte
        vocab = self.plain.get_vocab(with_added_tokens=True)
        self.a_len = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_len[i] = len(token) if all(c in chars for c in token) else len(token.encode())
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int64)
        self.splits = not any("▁" in p.lstrip("▁") for p in names)  # no piece reaches over a blank
        self.width = np.uint16 if max(len(self.a_len), n) <= 1 << 16 else np.uint32
        # decimal ids with the sign that follows: A inside a group, A at its end, B inside, B at its end
        shown = [b"%d%s" % (i, sign) for size, signs in ((len(self.a_len), (b",", b"|")), (n, (b",", b";"))) for sign in signs for i in range(size)]
        self.shown = np.array(shown)
        self.shown = self.shown.view(np.uint8).reshape(len(shown), -1)
        self.shown_len = np.array([len(s) for s in shown])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both kinds of every text (not empty), or None where the bytes differ."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            spaced = " " + text
            raw = spaced.encode()
            if self.ranked is None or _LONG_RUN.search(text):
                a = np.array(self.plain.encode(spaced, add_special_tokens=False).ids, self.width)
            else:
                a = self.ranked.encode_to_numpy(spaced, disallowed_special=()).astype(self.width)
            same = self.a_len[a].sum() == len(raw) and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((a, np.array(b, self.width)) if same else None)
        return out


@functools.cache
def _pair(byte_tokenizer: str, piece_model: str) -> _Pair:
    return _Pair(byte_tokenizer, piece_model)


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeezed(a: np.ndarray, b: np.ndarray) -> bytes:
    both = np.concatenate([a, b])
    return _zstd()[0].compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, both.itemsize).T).tobytes()) if len(both) else b""


def _stretched(raw: bytes, n_a: int, width) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.empty(0, width), np.empty(0, width)
    planes = np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(np.dtype(width).itemsize, -1)
    both = np.ascontiguousarray(planes.T).view(width).ravel()
    return both[:n_a], both[n_a:]


def _coded(files, key: pa.DataType):
    names = ["_bundle", "layer_id", "document", "start", "n_a", "ids"]

    def code(batches):
        pair = _pair(*files)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("_text").to_pylist()
                found = iter(pair.tokens([t for t in texts if t]))
                both = [(next(found) if t else None) for t in texts]
                n_a = [len(f[0]) if f else 0 for f in both]
                blobs = [_squeezed(*f) if f else b"" for f in both]
                blank = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_bundle"), batch.column("layer_id").cast(key), blank, pa.array([0] * len(texts), pa.int64()), pa.array(n_a, pa.int32()), pa.array(blobs, pa.binary())], names
                )

    return code


def byte_ranges(text: str, size: int) -> list[tuple[int, int, int, int, int]]:
    """``(lo, hi, at, first, past)`` of every range of the blank and ``text``: tokens that end in ``(lo, hi]`` are its
    own, and ``text[first:past]``, whose blank stands at byte ``at``, holds all of them. Every ``size`` bytes a range
    ends, unless the word there is longer than that."""
    safe = np.array([-1, *(m.start() for m in _SAFE.finditer(text)), len(text)])
    widths = np.array([len(text[x:y].encode()) for x, y in zip(np.maximum(safe[:-1], 0).tolist(), safe[1:].tolist())])
    where = np.concatenate([[0], 1 + np.cumsum(widths)])  # bytes before each safe blank, in blank + text
    total = int(where[-1])
    edges = []
    for cut in range(size, total, size):
        k = int(np.searchsorted(where, cut, side="right")) - 1
        if where[k + 1] - where[k] <= size:
            edges.append(cut)
    out = []
    for lo, hi in zip([0, *edges], [*edges, total]):
        k = int(np.searchsorted(where, lo, side="right")) - 1
        j = int(np.searchsorted(where, hi, side="left"))
        out.append((lo, hi, int(where[k]), int(safe[k]) + 1, int(safe[j])))
    return out


def _ranges(files, size: int, key: pa.DataType):
    names = ["layer_id", "document", "chunk", "lo", "hi", "at", "_text"]

    def cut(batches):
        row, width = 0, size if _pair(*files).splits else 1 << 60
        for batch in batches:
            for k, t in enumerate(batch.column("_text").to_pylist()):
                number = (batch.column("document")[k].as_py() << 40) + row
                row += 1
                found = byte_ranges(t, width)
                for at in range(0, len(found), 64):
                    part = found[at : at + 64]
                    lo, hi, start, first, past = zip(*part)
                    owner = batch.column("layer_id").take(pa.array([k] * len(part))).cast(key)
                    yield pa.RecordBatch.from_arrays(
                        [owner, pa.array([number] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                         pa.array(start, pa.int64()), pa.array([t[x:y] for x, y in zip(first, past)], pa.string())], names
                    )

    return cut


class Fragment:
    """Tokens of a byte range up to its first common end, and after its last; ``head`` is all there is if no end
    is common (``split`` is False then)."""

    def __init__(self, head, tail, split: bool):
        self.head, self.tail, self.split = head, tail, split

    def then(self, other: Fragment, close) -> Fragment:
        """Composition with the fragment of the range that follows; ``close`` takes the groups this closes."""
        open_end = _joined(self.tail if self.split else self.head, other.head)
        if not self.split:
            return Fragment(open_end, other.tail, other.split)
        if not other.split:
            return Fragment(self.head, open_end, True)
        close(open_end)
        return Fragment(self.head, other.tail, True)


def _joined(x, y):
    return tuple(np.concatenate([p, q]) for p, q in zip(x, y))


def fragment(a, a_ends, b, b_ends, closed_left: bool) -> tuple[Fragment, tuple | None]:
    """Fragment of tokens with their end bytes, and its closed groups; ``closed_left``: it begins where a group does."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    tokens = (a, a_ends, b, b_ends)
    if not len(common) and not closed_left:
        return Fragment(tokens, _cut(tokens, 0, 0, 0, 0), False), None
    low = -1 if closed_left else common[0]
    high = common[-1] if len(common) else low
    x, y = (int(np.searchsorted(a_ends, e, side="right")) for e in (low, high))
    u, v = (int(np.searchsorted(b_ends, e, side="right")) for e in (low, high))
    return Fragment(_cut(tokens, 0, x, 0, u), _cut(tokens, y, len(a), v, len(b)), True), _cut(tokens, x, y, u, v)


def _cut(tokens, x, y, u, v):
    a, a_ends, b, b_ends = tokens
    return a[x:y], a_ends[x:y], b[u:v], b_ends[u:v]


_ROW = ["layer_id", "document", "start", "n_a", "ids", "chunk", "role", "a_ends", "b_ends"]


def _row(layer, document, chunk, role, tokens) -> tuple:
    a, a_ends, b, b_ends = tokens
    ends = (b"", b"") if role == "closed" else (a_ends.tobytes(), b_ends.tobytes())
    return (layer, document, int(a_ends[0]) if len(a_ends) else 0, len(a), _squeezed(a, b), chunk, role, *ends)


def _rows(fragment: Fragment, layer, document, chunk) -> list[tuple]:
    if not fragment.split:
        return [_row(layer, document, chunk, "open", fragment.head)]
    return [_row(layer, document, chunk, "head", fragment.head), _row(layer, document, chunk, "tail", fragment.tail)]


def _row_types(key: pa.DataType) -> list[pa.DataType]:
    return [key, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary()]


def _fragments(files, key: pa.DataType):
    names = [*_ROW[:7], "whole", *_ROW[7:]]
    types = _row_types(key)
    types.insert(7, pa.bool_())

    def make(batches):
        pair = _pair(*files)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = pair.tokens([row["_text"]])[0] if row["_text"] else None
                layer, document, chunk = row["layer_id"], row["document"], row["chunk"]
                if tokens is None:
                    out = [(layer, document, 0, 0, b"", chunk, "closed", False, b"", b"")]
                else:
                    (a, b), kept = tokens, []
                    for ids, size in ((a, pair.a_len), (b, pair.b_len)):
                        ends = row["at"] + np.cumsum(size[ids])
                        own = slice(int(np.searchsorted(ends, row["lo"], side="right")), int(np.searchsorted(ends, row["hi"], side="right")))
                        kept += [ids[own], ends[own]]
                    part, closed = fragment(*kept, closed_left=chunk == 0)
                    found = _rows(part, layer, document, chunk) + ([_row(layer, document, chunk, "closed", closed)] if closed and len(closed[0]) else [])
                    out = [(*r[:7], True, *r[7:]) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return make


def _compose(key: pa.DataType):
    types = _row_types(key)

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["chunk"], r["role"]))
        parts: dict[int, dict[str, tuple]] = {}
        for r in rows:
            a_ends, b_ends = (np.frombuffer(r[c], np.int64) for c in ("a_ends", "b_ends"))
            n = len(a_ends) + len(b_ends)
            width = np.uint16 if not n or len(_zstd()[1].decompress(r["ids"])) == 2 * n else np.uint32
            a, b = _stretched(r["ids"], r["n_a"], width)
            parts.setdefault(r["chunk"], {})[r["role"]] = (a, a_ends, b, b_ends)
        layer, document, out, whole = rows[0]["layer_id"], rows[0]["document"], [], None
        close = lambda tokens: out.append(_row(layer, document, 0, "closed", tokens)) if len(tokens[0]) else None
        for _, roles in sorted(parts.items()):
            part = Fragment(roles["open"], None, False) if "open" in roles else Fragment(roles["head"], roles["tail"], True)
            if part.tail is None:
                part.tail = _cut(part.head, 0, 0, 0, 0)
            whole = part if whole is None else whole.then(part, close)
        out += _rows(whole, layer, document, rows[0]["chunk"] // COMPOSED)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_ROW)

    return compose


class _Stream:
    """All tokens of some rows in one stream; every row has the same bytes in A and B."""

    def __init__(self, pair: _Pair, table: pa.Table | pa.RecordBatch):
        both = [_stretched(raw, n, pair.width) for raw, n in zip(table.column("ids").to_pylist(), table.column("n_a").to_pylist())]
        self.n_a, self.n_b = (np.array([len(x[i]) for x in both], np.int64) for i in (0, 1))
        none = [np.empty(0, pair.width)]
        self.a, self.b = (np.concatenate([x[i] for x in both] or none).astype(np.int64) for i in (0, 1))
        a_ends, b_ends = np.cumsum(pair.a_len[self.a]), np.cumsum(pair.b_len[self.b])
        mark = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
        mark[a_ends] |= 1
        mark[b_ends] |= 2
        cuts = np.flatnonzero(mark)
        ends = mark[cuts]
        a_end, b_end, self.common = (ends & 1).astype(bool), (ends & 2).astype(bool), ends == 3
        # a link for each stretch between neighbouring cuts: one A token and one B token cover it
        self.link_a, self.link_b = self.a[np.cumsum(a_end) - a_end], self.b[np.cumsum(b_end) - b_end]
        closed = np.cumsum(self.common) - self.common
        self.a_group, self.b_group, self.a_last, self.b_last = closed[a_end], closed[b_end], self.common[a_end], self.common[b_end]
        row_end = np.concatenate([[0], a_ends])[np.cumsum(self.n_a)]
        self.link_to = np.searchsorted(cuts, row_end, side="right")
        self.link_row = np.repeat(np.arange(len(self.n_a)), np.diff(self.link_to, prepend=0))
        self.pair = (self.link_a << 32) | self.link_b

    def by_row(self, of_links: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_links, dtype=np.int64)])
        return np.diff(total[self.link_to], prepend=0)

    def groups(self, pair: _Pair) -> list[str]:
        """Aligned ids of every row."""
        a_size, b_size = len(pair.a_len), len(pair.b_len)
        shown = np.concatenate([self.a + a_size * self.a_last, 2 * a_size + self.b + b_size * self.b_last])
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        shown = shown[order]
        size = pair.shown_len[shown]
        text = pair.shown[shown][np.arange(pair.shown.shape[1]) < size[:, None]].tobytes().decode()
        stop = np.concatenate([[0], np.cumsum(size)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [text[x : y - 1] if y > x else "" for x, y in zip([0, *stop[:-1]], stop)]


def _held_pairs(files):
    def held(batches):
        pair = _pair(*files)
        for batch in batches:
            stream = _Stream(pair, batch)
            for row in range(batch.num_rows):
                mine = np.unique(stream.pair[stream.link_row == row])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("document")[row].as_py()] * len(mine), pa.int64()), pa.array(mine)], ["document", "pair"])

    return held


def _asked(files):
    """Pairs of a bundle, and how many of its whole layers hold each."""

    def ask(table: pa.Table) -> pa.Table:
        pair = _pair(*files)
        stream = _Stream(pair, table)
        whole = table.column("document").is_null().to_numpy()
        code = stream.link_a * len(pair.b_len) + stream.link_b
        keys = np.sort(stream.link_row * (len(pair.a_len) * len(pair.b_len)) + code)  # a layer's pairs, once each
        row, code = np.divmod(keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]], len(pair.a_len) * len(pair.b_len))
        held, docs = np.unique(code[whole[row]], return_counts=True)
        other = np.setdiff1d(code[~whole[row]], held)
        code, docs = np.concatenate([held, other]), np.concatenate([docs, np.zeros(len(other), np.int64)])
        pairs = (code // len(pair.b_len) << 32) | code % len(pair.b_len)
        owner = pa.array(np.full(len(pairs), table.column("_bundle")[0].as_py(), np.int32))
        return pa.table({"_bundle": owner, "pair": pa.array(pairs), "docs": pa.array(docs)})

    return ask


def _aligned(files, key: pa.DataType):
    def align(table: pa.Table, told: pa.Table) -> pa.Table:
        pair = _pair(*files)
        stream = _Stream(pair, table)
        known = told.column("pair").to_numpy() if told.num_rows else np.empty(0, np.int64)
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], stream.pair)] if len(stream.pair) else np.empty(0, np.int64)
        layers = told.column("layers").to_numpy()[at] if len(at) else at
        best = told.column("best").to_numpy()[at] if len(at) else at
        sums = [stream.n_a, stream.n_b, stream.by_row(stream.common), stream.by_row(np.ones(len(at), np.int64)), stream.by_row(best), stream.by_row(layers)]
        columns = [table.column("layer_id").cast(key), table.column("document"), table.column("start"), *[pa.array(s.astype(np.int64)) for s in sums], pa.array(stream.groups(pair), pa.string())]
        return pa.table(columns, names=["layer_id", "document", "start", *_SUMS, "groups"])

    return align
