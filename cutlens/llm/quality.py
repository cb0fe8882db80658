"""Hierarchical empirical-Bayes review of text layers: words, project and slot.

A logistic model over words and marks of layout gives each layer its own evidence. Every word of the labelled
layers is in it; how far its weight is shrunk to 0 follows from the odds that it tells anything. Grouped sums of
that evidence over all layers of a project, and of a slot within it, give posterior rates of low quality
and of toxicity; a project with few layers is shrunk towards the corpus rate, a slot with few layers
towards its project. The slot's rate then is the prior against which a layer's evidence is weighed.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlens.llm.textops import CACHE_WORDS, words_of
from cutlens.session import cut_lineage

#: Labelled layers the word model is fitted on, at most; spread evenly over sites and marks.
FIT_LAYERS = 20_000
#: Rows of site rates up to which they are broadcast (about 100 bytes each); beyond, they are joined by key.
BROADCAST_SITES = 50_000
TARGETS = ("low_quality", "toxic")
_EDGE = b".,;:!?\"'()*#%&$"
_NO_LETTERS = bytes(b for b in range(128) if not 65 <= b <= 90 and not 97 <= b <= 122)
_NO_WORD = np.uint64(xxhash.xxh64_intdigest(b""))


def judge_layers(
    text_layers: DataFrame, reviews: DataFrame, layer_id: str = "layer_id", project_id: str = "project_id", slot_id: str = "slot_id",
    text: str = "text", low_quality: str = "low_quality", toxic: str = "toxic", cut: float = 0.5, fit_layers: int = FIT_LAYERS,
) -> DataFrame:
    """``text_layers`` with ``low_quality``, ``toxic`` (posterior probabilities, double) and ``rejected``
    (boolean: either reaches ``cut``) added; columns of these names are replaced.

    ``reviews`` has ``layer_id`` and the marks ``low_quality`` and ``toxic`` (1 or 0, null if unknown) for
    some layers; several marks of a layer count as their maximum. Null texts have no words; null projects
    and slots are sites of their own. Without a usable review of both kinds for a target, its evidence is
    nil and its rate 0. Every row comes back once; an empty table gives an empty result.

    Only the word model is fitted on a bounded sample (``fit_layers``); rates and prior odds use every layer.
    The model has every word of that sample; site rates are broadcast only up to ``BROADCAST_SITES`` rows.
    """
    model = fit_evidence(text_layers, reviews, layer_id, project_id, slot_id, text, low_quality, toxic, fit_layers)
    shared = text_layers.sparkSession.sparkContext.broadcast(model)
    sites = [F.col(project_id).alias("_project"), F.col(slot_id).alias("_slot")]
    site_evidence = text_layers.select(*sites, F.col(text).alias("_text")).mapInArrow(_score(shared, "_text", ["_project", "_slot"]), _ddl(text_layers, project_id, slot_id))
    rates = site_rates(site_evidence)

    kept = [c for c in text_layers.columns if c.lower() not in (*TARGETS, "rejected", "_low_quality", "_toxic", "_project", "_slot", "_r0", "_r1")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in text_layers.schema if f.name in kept]
    scored = text_layers.select(*kept).mapInArrow(_score(shared, text, kept), ", ".join([*fields, "_low_quality double", "_toxic double"]))
    if rates.count() <= BROADCAST_SITES:
        rates = F.broadcast(rates)
    weighed = scored.join(rates, F.col(project_id).eqNullSafe(F.col("_project")) & F.col(slot_id).eqNullSafe(F.col("_slot")), "left")
    posterior = [_sigmoid(_logit(F.col(f"_r{i}")) + F.col(f"_{t}")).alias(t) for i, t in enumerate(TARGETS)]
    judged = weighed.select(*kept, *posterior)
    return judged.withColumn("rejected", F.greatest(*TARGETS) >= cut)


def fit_evidence(text_layers, reviews, layer_id, project_id, slot_id, text, low_quality, toxic, fit_layers=FIT_LAYERS) -> dict:
    """Evidence of each word and the prior odds, by target; words from at most ``fit_layers`` reviews."""
    sample, tally = label_sample(text_layers, reviews, layer_id, project_id, slot_id, low_quality, toxic, fit_layers)
    seen = text_layers.select(F.col(layer_id).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_key") == F.col("_id"))
    once = seen.groupBy("_id", "_site", *TARGETS).agg(F.min("_text").alias("_text"))
    kind = sample.schema["_id"].dataType.simpleString()
    listed = once.select("_id", "_site", *TARGETS, "_text").mapInArrow(_listed_words, f"_id {kind}, _site string, low_quality int, toxic int, found binary")
    rows = listed.toArrow().sort_by("_id")  # the bounded sample: eight bytes a word
    found = [r for c in rows.column("found").chunks for r in c.to_pylist()]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.array([len(r) // 8 for r in found], np.int64))
    known_words, word = np.unique(np.frombuffer(b"".join(found), np.uint64), return_inverse=True)
    word = word.astype(np.int32)
    site = np.unique(np.array(rows.column("_site").to_pylist(), object), return_inverse=True)[1] if len(rows) else np.zeros(0, np.int64)
    weights = np.zeros((len(known_words), len(TARGETS)))
    model: dict = {"prior": [], "base": [], "words": known_words, "weights": weights}
    marked = [rows.column(t).to_numpy(zero_copy_only=False).astype(float) for t in TARGETS]
    del rows, found  # the driver's memory
    for i, (t, marks) in enumerate(zip(TARGETS, marked)):
        known = ~np.isnan(marks)
        y = marks[known]
        if not len(y) or y.min() == y.max():
            model["prior"].append(float(y[0]) if len(y) else 0.0), model["base"].append(0.0)
            continue
        held = known[owner]
        words = _Incidence((np.cumsum(known, dtype=np.int32) - 1)[owner[held]], word[held], len(y), len(known_words))
        fitted = _logistic(words, y, _telling(words, y, site[known]))
        n0, n1 = (sum(r["_many"] for r in tally if r[t] == v) for v in (0, 1))
        model["prior"].append(n1 / (n0 + n1)), model["base"].append(float(fitted[-1] - math.log(y.mean() / (1 - y.mean()))))
        weights[:, i] = fitted[:-1]
    return model


def label_sample(text_layers, reviews, layer_id, project_id, slot_id, low_quality, toxic, fit_layers=FIT_LAYERS) -> tuple[DataFrame, list]:
    """At most ``fit_layers`` reviewed layers, one row each (``_id``, ``_site``, the marks), and the numbers of
    all reviewed layers by their marks. Each site and pair of marks gives as many as the others or all it has:
    a hash of the id, times the number of its kind, is about its rank among them."""
    marks = [F.max(F.col(c).cast("int")).alias(t) for c, t in zip((low_quality, toxic), TARGETS)]
    known = reviews.filter(F.col(layer_id).isNotNull()).groupBy(F.col(layer_id).alias("_id")).agg(*marks)
    place = F.to_json(F.struct(F.col(project_id).alias("p"), F.col(slot_id).alias("s")))
    places = text_layers.select(F.col(layer_id).alias("_key"), place.alias("_site"))
    located = cut_lineage(known.join(places, F.col("_id") == F.col("_key")).groupBy("_id", *TARGETS).agg(F.min("_site").alias("_site")))
    strata = cut_lineage(located.groupBy("_site", *TARGETS).agg(F.count(F.lit(1)).alias("_many")))
    tally = strata.groupBy(*TARGETS).agg(F.sum("_many").alias("_many")).collect()  # at most nine rows
    kinds = strata.select(F.col("_site").alias("_at"), *[F.col(t).alias(f"_of_{t}") for t in TARGETS], "_many")
    if strata.count() <= BROADCAST_SITES:
        kinds = F.broadcast(kinds)
    same = F.col("_site").eqNullSafe(F.col("_at"))
    for t in TARGETS:
        same = same & F.col(t).eqNullSafe(F.col(f"_of_{t}"))
    turn = F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53) * F.col("_many")
    return located.join(kinds, same).orderBy(turn, "_id").limit(fit_layers).select("_id", "_site", *TARGETS), tally


class _Incidence:
    """Which words each layer has, for sums over either; pairs come in order of the layer."""

    def __init__(self, layer: np.ndarray, word: np.ndarray, n_layers: int, n_words: int):
        self.word, self.layer_of = word, layer[np.argsort(word, kind="stable")]
        self.layers, self.words = (self._runs(k, n) for k, n in ((layer, n_layers), (word, n_words)))

    @staticmethod
    def _runs(keys, n):
        count = np.bincount(keys, minlength=n)
        some = np.flatnonzero(count)
        return n, some, (np.cumsum(count) - count)[some]

    @staticmethod
    def _sums(values, runs):
        out = np.zeros(runs[0])
        if len(runs[1]):
            out[runs[1]] = np.add.reduceat(values, runs[2])
        return out

    def by_layer(self, of_words: np.ndarray) -> np.ndarray:
        return self._sums(of_words[self.word], self.layers)

    def by_word(self, of_layers: np.ndarray) -> np.ndarray:
        return self._sums(of_layers[self.layer_of], self.words)


def _telling(words: _Incidence, y: np.ndarray, site: np.ndarray) -> np.ndarray:
    """Posterior odds, as a probability, that a word tells the classes apart: its count among the marked layers
    against the rates of the sites it is in (a word of one language is no evidence of that language's rate),
    with a Beta(1/2, 1/2) rate otherwise. The share of telling words is fitted to all words."""
    size = np.bincount(site)
    rate = ((np.bincount(site, weights=y) + 2 * y.mean()) / (size + 2))[site]
    n, marked = (np.rint(words.by_word(v)).astype(np.int64) for v in (np.ones(len(y)), y))
    expected = np.clip(words.by_word(rate) / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    top = int(n.max(initial=0)) + 1
    half, whole = (np.array([math.lgamma(k + c) for k in range(top)]) for c in (0.5, 1.0))
    odds = half[marked] + half[n - marked] - whole[n] - math.log(math.pi) - marked * np.log(expected) - (n - marked) * np.log(1 - expected)
    share = 0.01
    for _ in range(100):
        before, telling = share, 1 / (1 + np.exp(-np.clip(odds + math.log(share / (1 - share)), -700, 700)))
        share = min(max(float(telling[n > 0].mean()) if n.any() else 0.0, 1 / (len(n) + 1)), 0.5)
        if abs(share - before) < 1e-4 * before:
            break
    return telling


def _logistic(words: _Incidence, y: np.ndarray, telling: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression whose ridge penalty is ``penalty`` for a word that surely tells the
    classes apart and grows as that becomes unlikely; Newton steps by conjugate gradients; last the constant."""
    w = np.zeros(len(telling) + 1)
    ridge = np.append(penalty / np.maximum(telling, 1e-6), 1e-6)
    ahead = lambda v: words.by_layer(v[:-1]) + v[-1]
    back = lambda r: np.append(words.by_word(r), r.sum())
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        left, scale, step = back(y - p) - ridge * w, back(curve) + ridge, np.zeros(len(w))
        goal = (1e-2 if k else 1e-1) * np.linalg.norm(left)
        along = left / scale
        gain = left @ along
        for _ in range(50):
            if not gain or np.linalg.norm(left) <= goal:
                break
            bent = back(curve * ahead(along)) + ridge * along
            size = gain / (along @ bent)
            step += size * along
            left = left - size * bent
            eased = left / scale
            gain, was = left @ eased, gain
            along = eased + gain / was * along
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def site_rates(site_evidence: DataFrame) -> DataFrame:
    """``_project``, ``_slot`` and the shrunk rate of each target (``_r0``, ``_r1``): slot towards project,
    project towards corpus, with a strength taken from how much the rates differ between sites."""
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in range(len(TARGETS))]
    # read by the corpus totals, the projects and the slots: scored once, one row a site kept
    slots = cut_lineage(site_evidence.groupBy("_project", "_slot").agg(F.count(F.lit(1)).alias("n"), *sums))
    projects = slots.groupBy("_project").agg(F.sum("n").alias("pn"), *[F.sum(f"s{i}").alias(f"ps{i}") for i in range(len(TARGETS))])
    every, spread = [], []
    for i in range(len(TARGETS)):
        mean = F.sum(f"ps{i}") / F.sum("pn")
        every.append(mean.alias(f"g{i}"))
        rate = F.col(f"ps{i}") / F.col("pn")
        spread.append((F.sum(F.col("pn") * rate * rate) / F.sum("pn") - mean * mean).alias(f"v{i}"))
    corpus = projects.agg(*every, *spread, (F.sum("pn") / F.count(F.lit(1))).alias("size"))
    totals = corpus.first()
    shrunk = slots.join(projects, slots["_project"].eqNullSafe(projects["_project"])).drop(projects["_project"])
    columns = [F.col("_project"), F.col("_slot")]
    for i in range(len(TARGETS)):
        g = min(max(totals[f"g{i}"] or 0.0, 1e-9), 1 - 1e-9)
        noise = g * (1 - g) / max(totals["size"] or 1.0, 1.0)
        strength = min(max(g * (1 - g) / max((totals[f"v{i}"] or 0.0) - noise, 1e-9), 1.0), 1e5)
        project = (F.col(f"ps{i}") + strength * g) / (F.col("pn") + strength)
        columns.append(((F.col(f"s{i}") + strength * project) / (F.col("n") + strength)).alias(f"_r{i}"))
    return shrunk.select(*columns)


def _ddl(df: DataFrame, project_id: str, slot_id: str) -> str:
    kinds = df.schema
    return f"_project {kinds[project_id].dataType.simpleString()}, _slot {kinds[slot_id].dataType.simpleString()}, p0 double, p1 double"


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


class EvidenceWords(dict):
    """Hashes of the words of texts, without edge punctuation and with A-Z lower-cased, and of marks of layout. Words
    are remembered; beyond ``CACHE_WORDS`` of them the memory starts anew."""

    def __missing__(self, word: bytes) -> tuple[int, bool]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.strip(_EDGE).lower()), word[:2].isupper()
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Distinct hashes, ascending; a text without words has none."""
        raw = words_of(text)
        n = len(raw)
        if not n:
            return np.empty(0, np.uint64)
        hashes, capitals = zip(*map(self.__getitem__, raw))
        found = np.unique(np.array(hashes, np.uint64))
        found = found[found != _NO_WORD]
        whole = text.encode()
        shares = {
            b"capitals": sum(capitals) / n,
            b"marks": 1 - len(whole.translate(None, _NO_LETTERS)) / sum(map(len, raw)),
            b"bars": raw.count(b"|") / n,
            b"new": (len(found) + 1) / n,
            b"heads": sum(map(operator.eq, raw, raw[1:])) / n,
        }
        lines = text.split("\n")
        marks = [name + b"%d" % int(20 * share) for name, share in shares.items()]
        marks += [b"lines%d" % int(5 * (1 - len(set(lines)) / len(lines))), b"size%d" % int(math.log2(n))]
        return np.unique(np.concatenate([found, np.array([xxhash.xxh64_intdigest(b"\x00" + m) for m in marks], np.uint64)]))


def _listed_words(batches):
    words = EvidenceWords()
    for batch in batches:
        found = [words.of(t).tobytes() for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "found"])


def _score(shared, text: str, kept: list[str]):
    """Log-likelihood ratios of each layer (``_low_quality``, ``_toxic``); for sites, probabilities at the
    corpus prior instead (``p0``, ``p1``)."""
    for_sites = kept == ["_project", "_slot"]
    names = ["p0", "p1"] if for_sites else ["_low_quality", "_toxic"]

    def score(batches):
        model, words = shared.value, EvidenceWords()
        known, weights = model["words"], model["weights"]
        for batch in batches:
            found = [words.of(t) for t in batch.column(text).to_pylist()]
            every = np.concatenate(found) if found else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
            held = known[at] == every if len(known) else np.zeros(len(every), bool)
            out = [np.bincount(owner[held], weights[at[held], i], minlength=batch.num_rows) + b for i, b in enumerate(model["base"])]
            if for_sites:
                prior = np.clip(np.array(model["prior"]), 1e-12, 1 - 1e-12)
                out = [1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + x, -700, 700))) if model["prior"][i] else np.zeros(len(x)) for i, (p, x) in enumerate(zip(prior, out))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x) for x in out]], [*kept, *names])

    return score
