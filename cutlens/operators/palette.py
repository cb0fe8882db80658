"""Colour palettes, luma thumbnails and sharpness from pixel samples.

``pixels(<keys>, sample_id, r, g, b)`` with 0..1 channels; grids add ``x, y``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions import color
from cutlens.functions import constants as K
from cutlens.operators.ordered import positions
from cutlens.session import cut_lineage


def luma_thumb(grid: DataFrame, keys: list[str], width: int, height: int,
               tw: int = K.THUMB_WIDTH, th: int = K.THUMB_HEIGHT) -> DataFrame:
    """Box means of the luma on a ``tw`` x ``th`` raster: one row per frame and cell."""
    cell_x = F.least(F.lit(tw - 1), F.expr(f"x * {tw} div {width}")).cast("int")
    cell_y = F.least(F.lit(th - 1), F.expr(f"y * {th} div {height}")).cast("int")
    return (
        grid.select(*keys, cell_x.alias("tx"), cell_y.alias("ty"), color.luma709(F.col("r"), F.col("g"), F.col("b")).alias("_y"))
        .groupBy(*keys, "tx", "ty").agg(F.avg("_y").alias("luma"))
    )


def thumb_stats(thumb: DataFrame, keys: list[str], tw: int = K.THUMB_WIDTH, th: int = K.THUMB_HEIGHT) -> DataFrame:
    """Mean and population deviation over all ``tw * th`` cells of a thumbnail; a cell without a pixel is 0."""
    cells = float(tw * th)
    sums = thumb.groupBy(*keys).agg(F.sum("luma").alias("_s"), F.sum(F.col("luma") * F.col("luma")).alias("_q"))
    mean = F.col("_s") / cells
    return sums.select(*keys, mean.alias("luma_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / cells - mean * mean)).alias("luma_std"))


def thumb_arrays(thumb: DataFrame, keys: list[str], tw: int = K.THUMB_WIDTH, th: int = K.THUMB_HEIGHT) -> DataFrame:
    """The same thumbnails as one array of ``tw * th`` values per frame, empty cells 0."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("ty") * tw + F.col("tx"), F.col("luma"))))
    return thumb.groupBy(*keys).agg(pairs.alias("_cells")).select(
        *keys, F.transform(F.sequence(F.lit(0), F.lit(tw * th - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_cells"), i), F.lit(0.0))).alias("thumb")
    )


def dominant_colors(pixels: DataFrame, keys: list[str], k: int = 3, iterations: int = 8) -> DataFrame:
    """Deterministic k-means of every entity at once: ``(keys, rank, r, g, b, n)``.

    Seeds are evenly spaced samples in luma order. Every Lloyd step is a join with k centroid
    rows per entity and a map-side combined average, so entity size does not matter. Entities
    with at most k samples return them unchanged. A step that changes nothing repeats itself, so
    running all steps equals stopping early.
    """
    luma = color.luma709(F.col("r"), F.col("g"), F.col("b"))
    base = cut_lineage(positions(
        pixels.select(*keys, "sample_id", "r", "g", "b", luma.alias("_y")), keys, ["_y", "sample_id"], F.floor(F.col("_y") * 4096), out="_pos"
    ).drop("_y"))
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = counts.filter(F.col("_n") > k).select(
        *keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                        lambda i: F.least(F.col("_n") - 1, F.floor(i * F.col("_n") / max(1, k - 1))))).alias("c", "_pos")
    )
    seeds = wanted.join(base, [*keys, "_pos"]).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("c", "r", "g", "b"))).alias("cents")
    )
    cents, last = seeds, None
    for step in range(iterations):
        assigned = base.join(cents, keys).withColumn("c", _closest(k))
        moved = assigned.groupBy(*keys, "c").agg(*[F.avg(x).alias(x) for x in "rgb"]).groupBy(*keys).agg(
            F.collect_list(F.struct("c", "r", "g", "b")).alias("_new")
        )
        # a cluster that lost all its samples keeps its centre
        kept = F.transform("cents", lambda o: F.coalesce(F.get(F.filter("_new", lambda m: m["c"] == o["c"]), F.lit(0)), o))
        cents = cents.join(moved, keys).select(*keys, kept.alias("cents"))
        if step % 4 == 3:
            cents = cut_lineage(cents)
        last = assigned
    sizes = last.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"))
    big = cents.select(*keys, F.explode("cents").alias("m")).select(*keys, "m.*").join(sizes, [*keys, "c"], "left").select(
        *keys, "c", "r", "g", "b", F.coalesce("n", F.lit(0)).alias("n")
    )
    tiny = base.join(counts.filter(F.col("_n") <= k).select(*keys), keys).join(
        pixels.select(*keys, "sample_id"), [*keys, "sample_id"]
    ).select(*keys, "sample_id", "r", "g", "b")
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "c")
    arrival = Window.partitionBy(*keys).orderBy("sample_id")
    ranked_big = big.select(*keys, (F.row_number().over(order) - 1).alias("rank"), "r", "g", "b", "n")
    ranked_tiny = tiny.select(*keys, (F.row_number().over(arrival) - 1).alias("rank"), "r", "g", "b", F.lit(1).cast("bigint").alias("n"))
    return ranked_big.unionByName(ranked_tiny)


def _closest(k: int):
    """Index of the nearest centroid, the first of equals."""
    def dist(i):
        m = F.get("cents", F.lit(i))
        return color.distance2(F.col("r"), F.col("g"), F.col("b"), m["r"], m["g"], m["b"])

    best = F.least(*[F.struct(dist(i).alias("d"), F.lit(i).alias("c")) for i in range(k)])
    return best["c"]


def palette_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean luma, mean saturation and contrast of each entity."""
    y = color.luma709(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy(*keys).agg(
        F.avg(y).alias("brightness"),
        F.avg(color.saturation(F.col("r"), F.col("g"), F.col("b"))).alias("saturation"),
        F.least(F.lit(2.0), F.stddev_pop(y) / 0.29).alias("contrast"),
    )


def scene_palettes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Dominant colours as hex plus the palette statistics of each scene."""
    hexes = dominant_colors(pixels, keys).withColumn("hex", color.to_hex(F.col("r"), F.col("g"), F.col("b")))
    lists = hexes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "hex"))), lambda s: s["hex"]).alias("dominant"))
    return palette_stats(pixels, keys).join(lists, keys)


def overall_palette(palettes: DataFrame, video: list[str], scene: str) -> DataFrame:
    """Means over a video's scenes and the first five dominant colours in scene order."""
    means = palettes.groupBy(*video).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("brightness", "saturation", "contrast")])
    # five colours need at most the five earliest scenes that have any
    first = Window.partitionBy(*video).orderBy(scene)
    early = palettes.filter(F.size("dominant") > 0).withColumn("_rn", F.row_number().over(first)).filter("_rn <= 5")
    colours = early.groupBy(*video).agg(F.sort_array(F.collect_list(F.struct("_rn", "dominant"))).alias("_d")).select(
        *video, F.slice(F.flatten(F.transform("_d", lambda s: s["dominant"])), 1, 5).alias("dominant")
    )
    return means.join(colours, video, "left").withColumn("dominant", F.coalesce("dominant", F.array().cast("array<string>")))


def sharpness(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Brightness and sharpness (log of the Laplacian variance) of a luma raster up to 96 x 96.

    ``grid(<keys>, x, y, luma)`` with luma in 0..255; rows and columns are at most 96 long, so
    the windows are bounded. Border pixels only serve as neighbours.
    """
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    c = F.col("luma")
    around = grid.select(
        *keys, "luma", F.lag("luma").over(row).alias("_l"), F.lead("luma").over(row).alias("_r"),
        F.lag("luma").over(col).alias("_u"), F.lead("luma").over(col).alias("_d"),
    ).filter("_l IS NOT NULL AND _r IS NOT NULL AND _u IS NOT NULL AND _d IS NOT NULL")
    lap = 4 * c - F.col("_l") - F.col("_r") - F.col("_u") - F.col("_d")
    return around.groupBy(*keys).agg(
        (F.sum(c) / (F.count(c) * 255)).alias("brightness"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.greatest(F.var_pop(lap), F.lit(1.0))) / 3.0)).alias("sharpness"),
    )
