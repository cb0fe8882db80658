"""Alignment of two tokenisations against a plain walk over all pairs of tokens."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cutlens.llm.alignment import Fragment, align_layers, byte_ranges, fragment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def plain(texts):
    """Expected values of every text, by comparing every A token with every B token."""
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    chars, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            chars[chr(byte)] = byte
        else:
            chars[chr(256 + extra)], extra = byte, extra + 1
    linked, shown = [], []
    for text in texts:
        if not text:
            linked.append(None), shown.append("")
            continue
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        a_bytes = [bytes(chars[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            linked.append(None), shown.append("")
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ends[0][i] - len(a_bytes[i]), ends[1][j] - len(b_bytes[j])) < min(ends[0][i], ends[1][j])]
        groups, lo = [], 0
        for hi in both:
            groups.append("|".join(",".join(str(t) for t, e in zip(side, at) if lo < e <= hi) for side, at in ((a, ends[0]), (b, ends[1]))))
            lo = hi
        linked.append((len(a), len(b), len(both), links)), shown.append(";".join(groups))
    held = Counter(p for d in linked if d for p in set(d[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (*d[:3], len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), s) if d else (0, 0, 0, 0, 0, 0, "") for d, s in zip(linked, shown)
    ]


TEXTS = [
    "A caption, unbelievably long: antidisestablishmentarianism!", None, "", " ", "a  b   c\n\n", "<|endoftext|> and <s> are plain </s>", "ein ▁ mark", "naïve Überraschung 東京の夜 🎬🎬",
    "Same words again", "Same words again", "tab\tand\r\nreturn", "\x00\x7f", "x", "’s don't can't 12345 3.14",
]


def test_alignment_matches_a_walk_over_all_pairs(spark):
    rows = [(i % 11, t, "ignored", 1) for i, t in enumerate(TEXTS)]  # ids repeat
    layers = spark.createDataFrame(rows, "layer_id long, text string, groups string, start int")
    found = align_layers(layers, BYTES, PIECES).collect()
    assert sorted((r.layer_id, *[r[c] for c in NAMES]) for r in found) == sorted((i % 11, *w) for i, w in enumerate(plain(TEXTS)))


@pytest.mark.parametrize("size", [5, 16, 64])
def test_byte_ranges_give_what_whole_texts_give(spark, size):
    texts = [t for t in TEXTS if t] + ["word " * 300 + "tail", "nospaceatall" * 40, "ungewöhnlich lange Wörter überall " * 20, None, ""]
    layers = spark.createDataFrame(list(enumerate(texts)), "layer_id long, text string").repartition(3)
    found = align_layers(layers, BYTES, PIECES, chunk_bytes=size).collect()
    assert sorted((r.layer_id, *[r[c] for c in NAMES]) for r in found) == [(i, *w) for i, w in enumerate(plain(texts))]


def test_no_layers_and_null_ids(spark):
    assert align_layers(spark.createDataFrame([], "layer_id string, text string"), BYTES, PIECES).count() == 0
    only = align_layers(spark.createDataFrame([(None, "one"), ("b", None)], "layer_id string, text string"), BYTES, PIECES).collect()
    assert sorted((r.layer_id or "", r.n_a, r.groups) for r in only) == sorted([("", *plain(["one"])[0][:1], plain(["one"])[0][-1]), ("b", 0, "")])


@given(st.lists(st.tuples(st.integers(1, 4), st.booleans()), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.sets(st.integers(1, 110)), st.randoms())
@settings(max_examples=80, deadline=None)
def test_fragments_compose_associatively(a_sizes, b_sizes, cuts, rng):
    total = min(sum(s for s, _ in a_sizes), sum(b_sizes))
    ends = []
    for sizes in ([s for s, _ in a_sizes], b_sizes):
        found = [e for e in np.cumsum(sizes).tolist() if e < total]
        ends.append(np.array([*found, total]))
    ids = [np.arange(len(e)) for e in ends]
    edges = [0, *sorted(c for c in cuts if c < total), total]
    closed: list = []
    close = lambda tokens: closed.append(tokens)
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        kept = [x[(e > lo) & (e <= hi)] for i, e in zip(ids, ends) for x in (i, e)]
        part, inner = fragment(*kept, closed_left=lo == 0)
        parts.append(part)
        if inner is not None:
            close(inner)
    while len(parts) > 1:  # any order of composition
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k].then(parts[k + 1], close)]
    assert isinstance(parts[0], Fragment) and not len(parts[0].head[0]) and not len(parts[0].tail[0])
    for side in (0, 2):
        assert sorted(np.concatenate([c[side] for c in closed]).tolist()) == ids[side // 2].tolist()
    for c in (c for c in closed if len(c[0])):
        assert c[1][-1] == c[3][-1]  # groups end in common


def test_ranges_cover_a_text_once():
    text = "some words, and ein_langes_wort" + "x" * 50 + " more words here " * 5
    total = len((" " + text).encode())
    found = byte_ranges(text, 16)
    assert found[0][0] == 0 and found[-1][1] == total and all(x[1] == y[0] for x, y in zip(found, found[1:]))
    assert all(at <= lo and first <= past for lo, _, at, first, past in found)
