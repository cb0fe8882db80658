"""One-permutation MinHash fingerprints of text layers, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the permutation (a power of two), and low-order bits kept of each bin's minimum.
BINS, BITS = 256, 4
SHINGLE = 5
_BLANKS = " \t\n\x0b\x0c\r"
#: Probes of an empty bin before the exact fallback, and bits of an id within one ordering bucket.
PROBES, BUCKET_BITS = 48, 8
_SHIFT = 63 - (BINS.bit_length() - 1)
_PER_LONG = 64 // BITS


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (``array<bigint>``) of a text's distinct word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` and unchanged; fewer than ``SHINGLE`` words count as one shingle. Every
    shingle hash falls into one of ``BINS`` bins by its top bits, and a bin keeps its minimum. An empty bin
    borrows from the bin that its own pseudo-random probe sequence, the same for all texts, meets first
    among those that are not empty (optimal densification). The lowest ``BITS`` bits of each bin are
    packed. A text without words (or null) has the empty array. Equal texts have equal fingerprints.
    """
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    hashes = _let(F.split(trimmed, r"[\x20\x09-\x0D]+"), _shingle_hashes)
    # a sentinel above every possible minimum of its bin marks each bin, so that sorting lines up all bins
    sentinels = F.lit([((j + 1) << _SHIFT) - 1 for j in range(BINS)])
    lined = F.sort_array(F.concat(hashes, sentinels))
    minima = _let(lined, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))))
    bins = F.transform(minima, lambda x: F.when(x.bitwiseAND((1 << _SHIFT) - 1) != (1 << _SHIFT) - 1, x))
    dense = _let(bins, _densified)
    return F.when(trimmed == "", F.lit([]).cast("array<bigint>")).otherwise(_let(dense, _packed))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingle_hashes(w: Column) -> Column:
    """Non-negative 63-bit hash of every ``SHINGLE`` consecutive words."""
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]), 1))


def _densified(bins: Column) -> Column:
    def fill(x: Column, i: Column) -> Column:
        borrowed = [F.get(bins, F.xxhash64(i, F.lit(t)).bitwiseAND(BINS - 1).cast("int")) for t in range(PROBES)]
        # few filled bins: the rank of each under the bin's own order decides
        ranked = F.transform(bins, lambda y, j: F.when(y.isNotNull(), F.struct(F.xxhash64(i, j).alias("rank"), y.alias("value"))))
        # what a bin borrows is hashed anew, or a text of one shingle would agree in all bins or in none
        return F.coalesce(x, F.xxhash64(i, F.coalesce(*borrowed, F.array_min(F.filter(ranked, lambda y: y.isNotNull()))["value"])))

    return F.transform(bins, fill)


def _packed(dense: Column) -> Column:
    longs = []
    for at in range(0, BINS, _PER_LONG):
        value = F.lit(0).cast("bigint")
        for k in range(_PER_LONG):
            value = value.bitwiseOR(F.shiftleft(F.get(dense, F.lit(at + k)).bitwiseAND((1 << BITS) - 1), BITS * k))
        longs.append(value)
    return F.array(*longs)


def as_text(packed: Column) -> Column:
    """The fingerprint as lowercase hexadecimal digits, one per bin; of an empty one, the empty string."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness (0 to 1): the share of equal bins less the share that ``BITS``-bit values
    agree by chance. Two empty fingerprints are alike (1), an empty and another are not (0)."""
    ones = sum(1 << (BITS * k) for k in range(_PER_LONG))

    def same(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.lit(_PER_LONG) - F.bit_count(folded.bitwiseAND(ones)).cast("int")

    equal = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    estimate = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(F.greatest(F.lit(0.0), estimate))


def fingerprint_layers(text_layers: DataFrame, layer_id: str = "layer_id", text: str = "text") -> DataFrame:
    """``text_layers`` with the column ``fingerprint`` (``array<bigint>``, see :func:`fingerprint`) added or
    replaced. No shuffle; rows with null ids or texts and repeated rows are handled like others."""
    return text_layers.withColumn("fingerprint", fingerprint(F.col(text)))


def with_next(text_layers: DataFrame, layer_id: str = "layer_id", columns: tuple[str, ...] = ("text",), bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Every row with ``next_<column>`` from the layer after it by id (for the last, the first).

    Ids are whole numbers. Rows meet in buckets of ``2 ** bucket_bits`` ids, and the first row of a bucket is copied to the
    bucket before it, so no task orders more than a bucket. Rows that share an id follow each other in the
    order of ``columns``; rows with a null id come first. A single row is its own successor.
    """
    names = text_layers.columns
    key = F.coalesce(F.col(layer_id).cast("bigint"), F.lit(-(2**63)))
    bucketed = text_layers.select(*names, key.alias("_key"), F.shiftright(key, bucket_bits).alias("_bucket"))
    heads = text_layers.select(key.alias("_key")).groupBy(F.shiftright("_key", bucket_bits).alias("_home")).agg(F.min("_key").alias("_head"))
    span = Window.partitionBy("_shelf").orderBy("_home")
    # buckets are linked shelf by shelf; only one row per shelf meets in one place
    shelved = heads.withColumn("_shelf", F.shiftright("_home", 12))
    tails = shelved.groupBy("_shelf").agg(F.max("_home").alias("_tail"))
    chain = Window.orderBy("_shelf")
    ends = tails.select("_shelf", F.lag("_tail").over(chain).alias("_back"), F.max("_tail").over(Window.partitionBy()).alias("_end"))
    linked = shelved.withColumn("_back_in", F.lag("_home").over(span)).join(ends, "_shelf")
    linked = linked.select(F.col("_head"), F.coalesce("_back_in", "_back", "_end").alias("_before"))
    spread = bucketed.join(linked, F.col("_key") == F.col("_head"), "left")
    copies = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")), F.when(F.col("_head").isNotNull(), F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy")))))
    rows = spread.select(*names, "_key", F.explode(copies).alias("_at"))
    order = Window.partitionBy("_at.b").orderBy("_at.copy", "_key", *columns)
    return rows.select(*names, "_at", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_at.copy")).drop("_at")


def edited_likeness(text_layers: DataFrame, layer_id: str = "layer_id", text: str = "text", share: int = 4) -> DataFrame:
    """How each layer's fingerprint compares with that of an edited text and of the next layer.

    The edited text has its last ``floor(n_chars / share)`` code points replaced by the first as many (or all)
    of the next layer's text, by ascending id (after the last: the first). Returns ``layer_id``, ``n_chars``
    (code points), ``edited_text``, ``fingerprint``, ``edited_fingerprint`` (see :func:`as_text`),
    ``near_edited`` and ``near_next``. Null texts are empty. Ids are whole numbers.
    """
    plain = text_layers.select(F.col(layer_id).alias("layer_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = plain.withColumn("print", fingerprint(F.col("text")))
    paired = with_next(marked, "layer_id", ("text", "print"))
    n = F.char_length("text").cast("bigint")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    both = paired.select("layer_id", n.alias("n_chars"), edited.alias("edited_text"), "print", "next_print")
    both = both.withColumn("edited_print", fingerprint(F.col("edited_text")))
    return both.select(
        "layer_id", "n_chars", "edited_text", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
