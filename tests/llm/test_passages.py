"""Removal of repeated byte strings against a count of every string."""

import random
from collections import Counter

import numpy as np
import pytest

from cutlens.llm import passages
from cutlens.llm.passages import remove_repeated_bytes, repeated_strings, runs_of


def plain(texts, window):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[k : k + window] for r in raws for k in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - window + 1):
            if count[r[k : k + window]] > 1:
                gone[k : k + window] = True
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), starts, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30) for _ in range(4)]
    texts = [prose(rng.randint(1, 60)) for _ in range(n)]
    for _ in range(n):
        i, s = rng.randrange(n), rng.choice(shared)
        a = rng.randint(0, 10)
        texts[i] += s[a : a + rng.randint(20, 140)] + prose(rng.randint(0, 9))
    copies = [texts[0]] * 5 + [texts[1][:-3] + "zz"] * 2
    runs = ["a" * 130, "a" * 55, "aab" * 60, "ha " * 90 + "!", "x" + "aab" * 20, "line one\n" * 30, "a" * 39, "a" * 40]
    return texts + copies + runs + [None, "", "short", "é" * 45, "東京" * 30]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [4096, 2])
def test_removal_matches_a_count_of_every_string(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "BUNDLE_CHARS", (900, 900))  # texts meet across bundles
    monkeypatch.setattr(passages, "BLOCK_KEYS", (50, 50))
    monkeypatch.setattr(passages, "SLOT_BYTES", 3000)
    texts = corpus(seed)
    rows = [(i, t, "x", 7, "b") for i, t in enumerate(texts)]
    layers = spark.createDataFrame(rows, "layer_id long, text string, kept string, n_spans int, body string").repartition(4)
    found = remove_repeated_bytes(layers, window=40)
    assert found.columns == ["layer_id", "body", "kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.layer_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 40)


def test_long_texts_are_worked_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 256)
    rng = random.Random(5)
    part = "".join(rng.choice("abc ") for _ in range(90))
    texts = ["".join(rng.choice("abcdef ") for _ in range(700)) + part + "".join(rng.choice("xyz") for _ in range(500)), "q" + part + "r", "a" * 900]
    layers = spark.createDataFrame(list(enumerate(texts)), "layer_id long, text string")
    got = {r.layer_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(layers, window=40).collect()}
    assert [got[i] for i in range(3)] == plain(texts, 40)


def test_repeated_rows_null_ids_and_no_rows(spark):
    layers = spark.createDataFrame([(None, "z" * 50 + "tail"), (1, "b" * 10), (1, "b" * 10), (2, "c" * 39), (3, "uniq" + "".join(map(chr, range(65, 122))))] * 1, "layer_id long, text string")
    got = sorted((r.layer_id or -1, r.n_removed, bytes(r.kept)) for r in remove_repeated_bytes(layers, window=40).collect())
    assert got[0] == (-1, 50, b"tail") and got[1:3] == [(1, 0, b"b" * 10)] * 2
    twice = layers.unionByName(layers)
    assert {r.n_removed for r in remove_repeated_bytes(twice, window=40).filter("n_bytes >= 40").collect()} == {54, 61}
    assert remove_repeated_bytes(layers.limit(0), window=40).count() == 0


def test_columns_sort_suffixes_like_a_plain_sort():
    rng = random.Random(4)
    window = 12
    bodies, key, lead, strings = [], [], [], []
    for k in range(6):
        core = "".join(rng.choice("ab") for _ in range(30))
        for _ in range(9):
            a, b = rng.randint(0, 8), rng.randint(22, 30)
            body = list(core[a:b])
            if rng.random() < 0.6:
                body[rng.randrange(len(body))] = "c"
            bodies.append("".join(body).encode()), key.append(k), lead.append(10 - a), strings.append(len(body) - window + 1)
    lead, strings = np.array(lead), np.array(strings)
    lead -= lead.min()
    flags = repeated_strings(np.array(key), lead, strings, bodies, window)
    seen = Counter((key[i], w - lead[i], bodies[i][w : w + window]) for i in range(len(bodies)) for w in range(strings[i]))
    for i in range(len(bodies)):
        for w in range(strings[i]):
            assert flags[i, w] == (seen[key[i], w - lead[i], bodies[i][w : w + window]] > 1)


def test_anchors_follow_from_bytes_alone():
    rng = random.Random(9)
    middle = bytes(rng.choice(b"abcdefgh") for _ in range(300))
    found = []
    for head in (b"", bytes(rng.choice(b"xyz") for _ in range(170))):
        runs, _ = runs_of([head + middle], 40)
        found.append({(int(x) - len(head), int(k)) for x, k, a in zip(runs.anchor, runs.key, runs.first) if int(a) >= len(head)})
    assert found[0] and len(found[0] & found[1]) >= len(found[0]) - 2
