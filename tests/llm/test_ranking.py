"""Ranked search against a plain score of every layer for every search."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cutlens.llm import ranking
from cutlens.llm.ranking import LEAF, LayerPages, rank_layers, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(layers, searches, k):
    bags = [(i, Counter(split(t))) for i, t in layers]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_layers, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for s, t in searches:
        if s is not None:
            asked.setdefault(s, set()).update(split(t))
    out = []
    for s, terms in asked.items():
        scored = []
        for i, bag, n in bags:
            m = 10 + 90 * n * n_layers // n_terms
            total = sum(math.floor(1000 * math.log((2 * n_layers + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if total > 0 and i is not None:
                scored.append((-total, i))
        out += [(s, r, i, -v) for r, (v, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.search_id, r.rank, r.layer_id, r.score) for r in df.collect())


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)] + ["Über", "naïve", "東京", "x" * 300]
    odds = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=odds / odds.sum()))) for i in range(n)]


@pytest.mark.parametrize("postings", [2_000_000, 300])
def test_search_matches_a_score_of_all_pairs(spark, monkeypatch, postings):
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", postings)  # many shards: the first wave's scores bound the others
    monkeypatch.setattr(ranking, "BLOCK_SEARCHES", 7 if postings == 300 else 256)
    layers = corpus(400) + [(900, None), (901, ""), (902, "--- !"), (None, "w1 w2"), (903, "w5, W5; w5"), (904, "w5 w5 W5"), (5, "w7 again"), (5, "w7 again")]
    searches = [(i, t) for i, t in corpus(25, 8)] + [(70, None), (71, "unknownterm"), (72, "w5"), (72, "w7 w7"), (None, "w1")]
    found = rank_layers(
        spark.createDataFrame([(t, i, 0, "x") for i, t in layers], "text string, layer_id long, score int, head string").repartition(5),
        spark.createDataFrame([(i, t, 3) for i, t in searches], "search_id int, text string, rank int"), k=6,
    )
    assert rows(found) == plain(layers, searches, 6)


def test_one_hot_term_is_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", 40)
    layers = [(i, "rare common") for i in range(300)] + [(1000 + i, "other words") for i in range(700)]
    found = rank_layers(spark.createDataFrame(layers, "layer_id int, text string"), spark.createDataFrame([("s", "rare")], "search_id string, text string"), k=10)
    assert rows(found) == plain(layers, [("s", "rare")], 10)


def test_nothing_to_search(spark):
    layers, searches = "layer_id long, text string", "search_id long, text string"
    none, some = spark.createDataFrame([], layers), spark.createDataFrame([(1, "a b")], searches)
    assert rank_layers(none, some).count() == 0
    assert rank_layers(spark.createDataFrame([(1, "a b")], layers), spark.createDataFrame([], searches)).count() == 0
    assert rank_layers(spark.createDataFrame([(1, None), (2, " ")], layers), some).count() == 0


def test_node_pairs_below_the_weakest_score_are_dropped():
    rng = np.random.default_rng(1)
    terms, n = np.arange(64, dtype=np.uint64), 64 * LEAF
    owner = np.repeat(np.arange(n), 2)
    held = np.repeat(np.arange(n) // LEAF, 2).astype(np.uint64)  # every page has one term of its own, twice weighed
    pages = LayerPages(terms, owner, held, rng.integers(1, 10**6, 2 * n).astype(np.int32), n, np.float64)
    weights = np.zeros((64, 64))
    weights[np.arange(64), np.arange(64)] = 1000
    _, scores, computed = search(pages, weights, np.zeros(64), np.arange(n), 10)
    assert computed == 64 * LEAF * ranking.SEARCH_LEAF and all(len(s) == 10 for s in scores)
    floors = np.full(64, 10**10)
    assert search(pages, weights, floors, np.arange(n), 10)[2] == 0


def test_terms():
    assert terms_of("Don't STOP—naïve_ÄB 3.14") == [w.encode() for w in split("Don't STOP—naïve_ÄB 3.14")]
    assert terms_of(None) == [] and terms_of("\x00\x7f~") == []
