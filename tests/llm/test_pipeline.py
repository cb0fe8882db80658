"""Every stage of the pipeline against plain Python, with nulls, an extra column and empty tables; then the whole run."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens binary"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "tokens"]


def corpus():
    """Prose, copies, near copies, a shared passage, planted bad documents, and texts that are null or empty."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(20, 90)) for _ in range(120)]
    texts += [texts[0], texts[0], texts[1][:-3] + "end", prose(10) + " " + passage + " " + prose(5), passage + " " + prose(20), None, "", " \n", "one two"]
    bad = [prose(30) + " vilestword " + prose(5) for _ in range(40)]
    docs = [(i, t, "en" if i % 2 else None, f"site{i % 3}", len(t) if t is not None else None, b"x") for i, t in enumerate(texts + bad)]
    labels = [(i, 1, int(i >= len(texts))) for i in range(0, len(docs), 2)]
    return docs, labels, len(texts)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def shingles(text, n):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def without_similar(docs):
    sets = [shingles(d[1], 5) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    return [d for k, d in enumerate(docs) if find(k) == k]


def without_passages(docs):
    seen = Counter(tuple(w[k : k + 50]) for w in ((d[1] or "").split() for d in docs) for k in range(len(w) - 49))
    out = []
    for d in docs:
        w = (d[1] or "").split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                gone[k : k + 50] = True
        text = " ".join(x for x, g in zip(w, gone) if not g) if gone.any() else d[1] or ""
        out.append((d[0], text, *d[2:4], len(text), d[5]))
    return out


def test_rejected_documents_go_and_clean_ones_stay(spark, folder):
    docs, _, clean = corpus()
    kept = P.drop_rejected(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept.columns == COLUMNS
    found = rows(kept)
    assert set(found) <= set(docs) and len(found) == len(set(found))
    assert {d[0] for d in found} == set(range(clean))  # labelled or not, every bad document goes and no other


def test_one_of_each_similar_group_stays(spark):
    docs = corpus()[0]
    got = P.drop_similar(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "")
    assert got.columns == COLUMNS and rows(got) == sorted(without_similar(docs), key=lambda r: r[0])


def test_repeated_passages_go(spark):
    docs = corpus()[0]
    got = P.drop_repeated_passages(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "")
    assert got.columns == COLUMNS and rows(got) == sorted(without_passages(docs), key=lambda r: r[0])


def check_packing(packed, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d[0]: tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [0] for d in docs}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for doc, mine in pieces.items():
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids[doc])
        for r in mine:
            part = ids[doc][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // 2048) + 1


def test_packing_holds_every_token(spark):
    docs = corpus()[0]
    check_packing(P.pack(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect(), docs)


def test_the_whole_run(spark, folder):
    docs, _, clean = corpus()
    check_packing(P.run(spark, folder).collect(), without_passages(without_similar(docs[:clean])))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, none, str(tmp_path))
        assert got.columns == COLUMNS and got.count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
