"""Aggregates over pixel tables: one row per pixel of a frame (key, frame, x, y, and channels r, g, b or grey)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.operators.skew import best_row
from framefusion.session import store_step

RGB = ("r", "g", "b")
PIECES = 64
"""Places that the pixels of one key are dealt to in a join by shuffle."""


def explode_image(images: DataFrame, key: str, frame: str) -> DataFrame:
    """Pixels of Spark `image` structs with three channels (stored as blue, green, red bytes)."""
    i = F.col("image")
    code = lambda at: F.conv(F.hex(F.substring(i["data"], at + 1, 1)), 16, 10).cast("int")
    rows = images.where(i["nChannels"] == 3).select(
        key, frame, "image", F.explode(F.sequence(F.lit(0), i["height"] * i["width"] - 1)).alias("p"))
    return rows.select(key, frame, (F.col("p") % i["width"]).alias("x"), F.floor(F.col("p") / i["width"]).cast("int").alias("y"),
                       code(F.col("p") * 3 + 2).alias("r"), code(F.col("p") * 3 + 1).alias("g"), code(F.col("p") * 3).alias("b"))


def temporal_composite(pixels: DataFrame, keys: Sequence[str], how: str = "min", channels: Sequence[str] = RGB,
                       min_frames: int = 2) -> DataFrame:
    """Pixel-wise minimum, median or mean over the frames of a key; keys with too few frames are left out."""
    fold = {"min": F.min, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[how]
    out = pixels.groupBy(*keys, "x", "y").agg(*[fold(c).alias(c) for c in channels], F.count_distinct("frame").alias("frames"))
    return out.where(F.col("frames") >= min_frames)


def static_mask(pixels: DataFrame, keys: Sequence[str], threshold: float, channels: Sequence[str] = RGB) -> DataFrame:
    """Change, spread and staticness of every pixel over the frames of a key."""
    change = reduce(F.greatest, [F.max(c) - F.min(c) for c in channels]) if len(channels) > 1 else F.max(channels[0]) - F.min(channels[0])
    spread = sum((F.stddev_pop(c) for c in channels[1:]), F.stddev_pop(channels[0])) / len(channels)
    out = pixels.groupBy(*keys, "x", "y").agg(change.alias("change"), spread.alias("std"))
    return out.withColumn("static", F.col("change") < threshold)


def persistence_share(pixels: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Share of a key's frames in which the pixel meets the condition."""
    return pixels.groupBy(*keys, "x", "y").agg(F.avg(condition.cast("double")).alias("share"))


def quantise(channel: str, step: int) -> Column:
    return (F.floor(F.col(channel) / step) * step + step // 2).cast("int").alias(channel)


def font_colour(pixels: DataFrame, keys: Sequence[str], step: int = 24, min_share: float = 0.10, channels: Sequence[str] = RGB) -> DataFrame:
    """Quantised colour that fills at least `min_share` of a frame in the most frames; larger total share settles ties."""
    q = pixels.select(*keys, "frame", *[quantise(c, step) for c in channels])
    total = q.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_all"))
    colours = q.groupBy(*keys, "frame", *channels).agg(F.count(F.lit(1)).alias("_n")).join(total, [*keys, "frame"])
    share = F.col("_n") / F.col("_all")
    strong = colours.withColumn("_share", share).where(F.col("_share") >= min_share)
    seen = strong.groupBy(*keys, *channels).agg(F.count(F.lit(1)).alias("frames"), F.sum("_share").alias("weight"))
    return best_row(seen, list(keys), [F.col("frames"), F.round("weight", 9), *[-F.col(c) for c in channels]])


def static_colour(pixels: DataFrame, keys: Sequence[str], threshold: float = 28, step: int = 20, min_static: int = 8,
                  channels: Sequence[str] = RGB) -> DataFrame:
    """Most common quantised mean colour among the pixels that hardly change."""
    static = static_mask(pixels, keys, threshold, channels).where("static").select(*keys, "x", "y")
    mean = pixels.groupBy(*keys, "x", "y").agg(*[F.avg(c).alias(c) for c in channels]).join(static, [*keys, "x", "y"], "left_semi")
    counts = mean.select(*keys, *[quantise(c, step) for c in channels]).groupBy(*keys, *channels).agg(F.count(F.lit(1)).alias("n"))
    return best_row(counts, list(keys), [F.col("n"), *[-F.col(c) for c in channels]], static_pixels=F.sum("n")).where(
        F.col("static_pixels") >= min_static)


def otsu_split(pixels: DataFrame, keys: Sequence[str], grey: str = "grey") -> DataFrame:
    """Threshold of the 256-bin histogram with the greatest between-class variance, the lowest on ties; 128 if there is
    none. The histogram has at most 256 rows per key, so its running sums are bounded."""
    bins = pixels.groupBy(*keys, F.floor(grey).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    key = Window.partitionBy(*keys)
    upto = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n") * F.col("bin")
    rows = bins.select("*", F.sum("n").over(upto).alias("wb"), F.sum(mass).over(upto).alias("sb"), F.sum("n").over(key).alias("w"),
                       F.sum(mass).over(key).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    variance = F.when(wf > 0, F.col("wb") * wf * gap * gap)
    best = rows.withColumn("variance", variance).groupBy(*keys).agg(
        F.max_by(F.when(F.col("variance").isNotNull(), F.col("bin")), F.struct(F.coalesce(F.round("variance", 3), F.lit(-1.0)), -F.col("bin"))).alias("threshold"))
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(128)))


def otsu_colours(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str] = RGB, border: Column | None = None, min_side: int = 6) -> DataFrame:
    """Median colours on both sides of the split; the side the border pixels fill is the background."""
    grey = sum((F.col(c) for c in channels[1:]), F.col(channels[0])) / len(channels)
    rows = pixels.withColumn("grey", grey)
    rows = rows.join(otsu_split(rows, keys), list(keys)).withColumn("_bright", F.col("grey") > F.col("threshold"))
    edge = border if border is not None else F.lit(True)
    sides = rows.groupBy(*keys).agg((F.avg(F.when(edge, F.col("grey"))) > F.max("threshold")).alias("_ground"))
    rows = rows.join(sides, list(keys)).withColumn("side", F.when(F.col("_bright") == F.col("_ground"), "background").otherwise("font"))
    out = rows.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("pixels"), *[F.percentile(c, 0.5).alias(c) for c in channels])
    return out.where(F.col("pixels") >= min_side)


def _away(channels: Sequence[str], colour: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - v) * (F.col(c) - v) for c, v in zip(channels, colour)]))


def colour_mask(pixels: DataFrame, colours: DataFrame, keys: Sequence[str], tolerance: float | None = None, margin: float = 1.0,
                channels: Sequence[str] = RGB) -> DataFrame:
    """Keep pixels nearer to the font colour (font_*) than to the background (back_*), or within a tolerance of it.

    The colours are stored, so that Spark knows their size and ships a small table to the pixels. Where it joins by shuffle instead, the
    pixels of a key go to PIECES places, and the colours to each of them."""
    colours = store_step(colours).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    rows = pixels.withColumn("_piece", F.pmod(F.hash("frame", "x", "y"), F.lit(PIECES))).join(colours, [*keys, "_piece"])
    font = _away(channels, [F.col(f"font_{c}") for c in channels])
    if tolerance is not None:
        return rows.where(font <= tolerance).select(*pixels.columns)
    back = _away(channels, [F.col(f"back_{c}") for c in channels])
    return rows.where(font * margin < back).select(*pixels.columns)
