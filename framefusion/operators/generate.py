"""Row generators: tokens out of mixed texts, search regions, windows inside regions, hits."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.functions.boxes import Box
from framefusion.operators.box_sets import arrival_dedupe, greedy_nms
from framefusion.operators.greedy import CROWD, keep_apart_in_turn
from framefusion.operators.scan import ordered_scan
from framefusion.operators.skew import best_row, few_values, find_hot, split_hot, top_rows

# Numeric run with inner separators; sub-window fractions; region scales and bands; window scores.
NUMERIC_RUN = r"([0-9][0-9:.\-/]*[0-9]|[0-9])"
WHOLE_NUMERIC = r"^[0-9\s:.\-/]+$"
X_SPANS = ((0.0, 0.35), (0.0, 0.50), (0.0, 0.68), (0.12, 0.52), (0.28, 0.78), (0.48, 1.0))
Y_SPANS = ((0.0, 0.45), (0.18, 0.68), (0.42, 1.0), (0.0, 1.0))
STRIP_BANDS = ((0.0, 0.72, 0.16, 0.84), (0.0, 0.74, 0.24, 0.90), (0.0, 0.78, 0.12, 0.86))
SLOT_BANDS = ((0.0, 0.60, 0.18, 0.78), (0.0, 0.62, 0.24, 0.84), (0.0, 0.66, 0.30, 0.88))
BROAD_BANDS = (
    ("fallback_lower_left_tight", 0.0, 0.58, 0.20, 0.80), ("fallback_lower_left_mid", 0.0, 0.60, 0.28, 0.86),
    ("fallback_lower_left_wide", 0.0, 0.64, 0.36, 0.91), ("fallback_mid_left", 0.0, 0.48, 0.30, 0.72))
WIDE_SPLITS = ((0.0, 0.38), (0.0, 0.50), (0.0, 0.62), (0.10, 0.55), (0.22, 0.72))


def located_runs(text: Column, pattern: str) -> Column:
    """Matches of a digit pattern with start and end offsets. Every digit belongs to a match, so a match begins at the
    first place after the previous one where its text occurs."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int,stop:int>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        start = acc["at"] + F.instr(F.substring(text, acc["at"] + 1, F.length(text)), raw) - 1
        stop = start + F.length(raw)
        item = F.struct(raw.alias("raw"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(found, empty, step, lambda acc: acc["out"])


def refine_numeric(candidates: DataFrame) -> DataFrame:
    """Numeric runs of mixed texts as readings of their own, with a proportional box; only the new rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.coalesce(F.col("candidate_id"), F.lit("ocr")) if "candidate_id" in candidates.columns else F.concat(
        F.lit("ocr_"), F.lpad(F.col("candidate_index").cast("string"), 4, "0"))
    mixed = candidates.where(~F.coalesce(tx.strip(text).rlike(WHOLE_NUMERIC), F.lit(False)))
    rows = mixed.withColumn("_id", ident).withColumn("_text", text).withColumn(
        "_n", F.greatest(F.lit(1), F.length(text))).withColumn("_w", F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")))
    rows = rows.select("*", F.posexplode(located_runs(F.col("_text"), NUMERIC_RUN)).alias("_pos", "_run"))
    sx = F.col("x1") + F.col("_w") * (F.col("_run.start") / F.col("_n"))
    ex = F.col("x1") + F.col("_w") * (F.col("_run.stop") / F.col("_n"))
    pad = F.greatest(F.lit(2.0), (ex - sx) * 0.12)
    conf = F.round(F.coalesce("ocr_conf", F.lit(1.0)) * 0.94, 6)
    number = F.lpad((F.col("_pos") + 1).cast("string"), 2, "0")
    out = rows.select(
        "image_id", "candidate_index", (F.col("_pos") + 1).alias("part"),
        F.concat("_id", F.lit("_num_"), number).alias("candidate_id"), tx.digits(F.col("_run.raw")).alias("text"),
        F.round(F.greatest(F.lit(0.0), sx - pad), 3).alias("x1"), "y1", F.round(ex + pad, 3).alias("x2"), "y2",
        conf.alias("ocr_conf"), conf.alias("detection_conf"), F.lit("refined_numeric_substring").alias("source"),
        F.col("_id").alias("parent_id"), F.col("_text").alias("parent_text"), "image_width", "image_height")
    if "candidate_id" in candidates.columns:
        out = out.join(candidates.select("image_id", "candidate_id"), ["image_id", "candidate_id"], "left_anti")
        out = best_row(out, ["image_id", "candidate_id"], [-F.col("candidate_index"), -F.col("part")])
    return out


def split_mixed(candidates: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Digit runs of one to five digits with purity, prefix flag and box; clock and date texts are dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = candidates.where(~tx.is_time_or_date(text) & (tx.sureness("ocr_conf") >= min_conf))
    rows = rows.withColumn("_text", text).select("*", F.posexplode(located_runs(F.col("_text"), r"([0-9]+)")).alias("_pos", "_run"))
    length = F.length("_run.raw")
    alnum = F.length(F.regexp_replace("_text", "[^0-9A-Za-z]", ""))
    prefix = F.col("_text").rlike(tx.CHANNEL_PREFIX)
    other = F.regexp_replace("_text", r"[\d\s]", "") != ""
    cut = other & ~prefix
    w, n = F.col("x2") - F.col("x1"), F.greatest(F.lit(1), F.length("_text"))
    x1 = F.when(cut, F.col("x1") + w * (F.col("_run.start") / n)).otherwise(F.col("x1"))
    x2 = F.when(cut, F.col("x1") + w * (F.col("_run.stop") / n)).otherwise(F.col("x2"))
    return rows.where(length.between(1, 5)).select(
        "image_id", "candidate_index", F.col("_pos").alias("part"), F.col("_run.raw").alias("raw"),
        tx.canonical(F.col("_run.raw")).alias("value"), x1.alias("x1"), "y1", x2.alias("x2"), "y2",
        ((x1 + x2) / 2 / F.col("image_width")).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / F.col("image_height")).alias("cy"),
        ((F.col("y2") - F.col("y1")) / F.col("image_height")).alias("h"), tx.sureness("ocr_conf").alias("conf"),
        cut.alias("had_text"), prefix.alias("had_prefix"),
        F.when(prefix, 1.0).otherwise(length / F.greatest(F.lit(1), alnum)).alias("purity"))


def explode_tokens(readings: DataFrame) -> DataFrame:
    return readings.select(*[c for c in readings.columns if c != "text"],
                           F.posexplode(tx.digit_tokens(F.col("text"))).alias("token_index", "text"))


def _window(box: Box, kind: str, score: Column | float, keep: Column | None = None) -> Column:
    made = bx.struct(box, F.lit(kind).alias("kind"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))
    return made if keep is None else F.when(keep, made)


def _inline(rows: DataFrame, windows: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Rows for every window that is there; `window_index` is its place in the list."""
    made = F.filter(F.array(*[F.struct(F.lit(i).alias("window_index"), w.alias("w")) for i, w in enumerate(windows)]), lambda p: p["w"].isNotNull())
    return rows.select(*keep, F.explode(made).alias("_w")).select(*keep, "_w.window_index", "_w.w.*")


PLACE = ("x1", "y1", "x2", "y2", "image_width", "image_height")
FEW_PLACES = 20_000
"""Distinct boxes up to which what is made of them may be broadcast."""


def once_per_box(regions: DataFrame, keys: Sequence[str], work: Callable[[DataFrame, list[str]], DataFrame],
                 limit: int = FEW_PLACES) -> DataFrame:
    """`work(rows, keys)`, which makes rows of a region out of its box and its screen alone. Where many regions share few boxes, the work
    is done once for every distinct box and joined to its regions; otherwise once for every region."""
    keys = list(keys)
    regions = regions.select(*keys, *PLACE)
    if not few_values(regions, PLACE, limit):
        return work(regions, keys)
    tags = [f"_of_{c}" for c in PLACE]
    made = work(regions.select(*PLACE).distinct().select("*", *[F.col(c).alias(t) for c, t in zip(PLACE, tags)]), tags)
    own = regions.select(*keys, *[F.col(c).alias(f"_own_{c}") for c in PLACE])
    same = reduce(lambda a, b: a & b, [own[f"_own_{c}"].eqNullSafe(made[t]) for c, t in zip(PLACE, tags)])
    return own.join(F.broadcast(made), same).select(*keys, *[c for c in made.columns if c not in tags])


def geometric_windows(regions: DataFrame, prefix: str = "") -> DataFrame:
    """A region and its fractional sub-windows of at least 14 x 10 pixels, scored by position in the grid."""
    w, h = F.col("image_width"), F.col("image_height")
    region = bx.cols()
    windows = [_window(bx.clamp(region, w, h), f"{prefix}region_full", 0.38)]
    for i, (left, right) in enumerate(X_SPANS):
        for j, (top, bottom) in enumerate(Y_SPANS):
            box = bx.clamp(bx.sub_window(region, left, top, right, bottom), w, h)
            big = (box.x2 - box.x1 >= 14) & (box.y2 - box.y1 >= 10)
            windows.append(_window(box, f"{prefix}geometric_window", 0.35 - 0.01 * (i + j), big))
    keep = [c for c in regions.columns if c not in ("x1", "y1", "x2", "y2", "kind", "score", "window_index")]
    return _inline(regions, windows, keep)


def _bands(frames: DataFrame, bands: Sequence[tuple[float, ...]], stage: int) -> DataFrame:
    w, h = F.col("image_width").cast("double"), F.col("image_height").cast("double")
    boxes = F.array(*[bx.struct(Box(w * a, h * b, w * c, h * d)) for a, b, c, d in bands])
    return frames.select("image_id", "image_width", "image_height", F.lit(stage).alias("stage"),
                         F.posexplode(boxes).alias("arrival", "_b")).select(
        "image_id", "image_width", "image_height", "stage", "arrival", "_b.*")


def search_regions(frames: DataFrame, detections: DataFrame, candidates: DataFrame, fallbacks: bool = True,
                   slot_bands: bool = False) -> DataFrame:
    """Regions to search again: scaled detector boxes, fixed lower-left bands, expanded lower-left digits; a region that
    overlaps an earlier one by more than 0.75 is dropped (0.82 after the slot bands are added)."""
    w, h = F.col("image_width"), F.col("image_height")
    size = ["image_id", "image_width", "image_height"]
    scaled = bx.scale_min_size(bx.cols(), w, h, 1.35, 1.6)
    parts = [detections.select(*size, F.lit(0).alias("stage"), F.col("detection_index").alias("arrival"), *bx.named(scaled))]
    if fallbacks:
        grown = bx.scale_min_size(bx.cols(), w, h, 2.2, 2.0)
        near = candidates.where((tx.digits(F.col("text")) != "") & bx.is_lower_left(bx.cols(), w, h))
        parts += [_bands(frames, STRIP_BANDS, 1),
                  near.select(*size, F.lit(2).alias("stage"), F.col("candidate_index").alias("arrival"), *bx.named(grown))]
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("arrival", F.col("stage") * 10_000_000_000 + F.col("arrival"))
    if not (slot_bands and fallbacks):
        return arrival_dedupe(rows, ["image_id"], "arrival", 0.75)
    extra = _bands(frames, SLOT_BANDS, 3).withColumn("arrival", F.col("stage") * 10_000_000_000 + F.col("arrival"))
    rows = rows.select(*extra.columns)
    # A frame has no more regions than boxes and readings, but for the few bands: counting those makes no region.
    hot = find_hot(detections.select("image_id").unionByName(candidates.select("image_id")), ["image_id"], CROWD)
    if hot is None:
        return keep_apart_in_turn(rows.unionByName(extra), ["image_id"], ["arrival"], F.col("stage") == 3, (0.75, 0.82))
    (cold, crowd), (cold_extra, crowd_extra) = (split_hot(df, hot, ["image_id"]) for df in (rows, extra))
    crowd = arrival_dedupe(crowd.select(*extra.columns), ["image_id"], "arrival", 0.75)
    crowd = arrival_dedupe(crowd.unionByName(crowd_extra), ["image_id"], "arrival", 0.82)
    return keep_apart_in_turn(cold.unionByName(cold_extra), ["image_id"], ["arrival"], F.col("stage") == 3, (0.75, 0.82)).unionByName(crowd)


def broad_regions(frames: DataFrame, detections: DataFrame, candidates: DataFrame, fallbacks: bool = True) -> DataFrame:
    """Wider regions with the name of their origin: channel and area boxes, readings with digits, fixed bands."""
    w, h = F.col("image_width"), F.col("image_height")
    size = ["image_id", "image_width", "image_height"]
    bw, bh = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    channel = F.col("class_id") == 0
    pad_x = F.when(channel, F.greatest(F.lit(10.0), bw * 0.90)).otherwise(F.greatest(F.lit(6.0), bw * 0.08))
    pad_y = F.when(channel, F.greatest(F.lit(8.0), bh * 0.95)).otherwise(F.greatest(F.lit(5.0), bh * 0.10))
    parts = [detections.where("class_id IN (0, 3)").select(
        *size, F.lit(0).alias("stage"), F.col("detection_index").cast("long").alias("arrival"),
        F.when(channel, "yolo_channel_number").otherwise("yolo_channel_number_area").alias("source"),
        *bx.named(bx.expand(bx.cols(), w, h, pad_x, pad_y)))]
    usable = (tx.digits(F.col("text")) != "") | F.col("source").isin("original_ocr", "easyocr", "paddleocr")
    around = bx.expand(bx.cols(), w, h, F.greatest(F.lit(12.0), bw * 1.20), F.greatest(F.lit(8.0), bh * 0.85))
    parts.append(candidates.where(usable & (bx.area(bx.cols()) > 0)).select(
        *size, F.lit(1).alias("stage"), F.col("candidate_index").cast("long").alias("arrival"), F.lit("ocr_expanded").alias("source"),
        *bx.named(around)))
    if fallbacks:
        fw, fh = w.cast("double"), h.cast("double")
        made = F.array(*[bx.struct(Box(fw * a, fh * b, fw * c, fh * d), F.lit(name).alias("source")) for name, a, b, c, d in BROAD_BANDS])
        parts.append(frames.select(*size, F.lit(2).alias("stage"), F.posexplode(made).alias("arrival", "_b")).select(
            *size, "stage", F.col("arrival").cast("long").alias("arrival"), "_b.source", "_b.x1", "_b.y1", "_b.x2", "_b.y2"))
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("arrival", F.col("stage") * 10_000_000_000 + F.col("arrival"))
    rows = rows.where(bx.area(bx.cols()) >= 20)
    return arrival_dedupe(rows, ["image_id"], "arrival", 0.86)


def repair_windows(proposals: DataFrame, keys: Sequence[str], mode: str = "both", ratios: Sequence[float] = (0.08, 0.14, 0.22),
                   k: int = 10) -> DataFrame:
    """Second tries for windows that may be too tight, too wide or clipped; the best `k` per key."""
    w, h = F.col("image_width"), F.col("image_height")
    b = bx.cols()
    bw, bh = F.greatest(F.lit(1.0), b.x2 - b.x1), F.greatest(F.lit(1.0), b.y2 - b.y1)
    score, kind, aspect = F.col("score"), F.col("kind"), bw / bh
    tight = kind.isin("component_span", "component_line") | (aspect < 4.8)
    wide = (aspect >= 3.6) | kind.isin("region_full", "geometric_window")
    capped = lambda top, v: F.least(F.lit(top), v)
    windows = [
        _window(bx.expand(b, w, h, F.greatest(F.lit(3.0), bw * r), F.greatest(F.lit(2.0), bh * r * 0.45)), "repair_tight_expand",
                capped(0.86, score + 0.10 + r), tight) for r in ratios]
    for left, right in WIDE_SPLITS:
        box = bx.clamp(Box(b.x1 + bw * left, b.y1, b.x1 + bw * right, b.y2), w, h)
        windows.append(_window(box, "repair_wide_split", capped(0.84, score + 0.14), wide & (bx.area(box) > 0)))
    windows.append(_window(bx.expand(b, w, h, F.greatest(F.lit(2.0), bw * 0.04), F.greatest(F.lit(4.0), bh * 0.30)),
                           "repair_vertical_expand", capped(0.82, score + 0.08), bh < h * 0.10))
    # Windows come in the order of their proposals, the best proposal first.
    place = proposals["window_index"] if "window_index" in proposals.columns else F.lit(0)
    rows = proposals.select("*", (-score).alias("_p1"), (-bx.area(b)).alias("_p2"), place.alias("_p3"))
    came = ["_p1", "_p2", "_p3", "window_index"]
    made = _inline(rows, windows, [*keys, "image_width", "image_height", *came[:3]])
    best = greedy_nms(made, keys, "score", 0.68, arrival=came, limit=None)
    order = [F.desc("score"), F.desc(bx.area(bx.cols())), *[F.asc(c) for c in (*came, "x1", "y1", "x2", "y2")]]
    best = top_rows(best, keys, order, k).drop("rank", *came[:3])
    if mode == "wide":
        return best.where("kind = 'repair_wide_split'")
    return best.where("kind <> 'repair_wide_split'") if mode == "tight" else best


def history_windows(locks: DataFrame, keys: Sequence[str], max_area: float = 0.18) -> DataFrame:
    """Six padded variants of a remembered box, none larger than `max_area` of the frame."""
    w, h = F.col("image_width"), F.col("image_height")
    b = bx.clamp(bx.cols(), w, h)
    bw, bh = F.greatest(F.lit(1.0), b.x2 - b.x1), F.greatest(F.lit(1.0), b.y2 - b.y1)

    def padded(left: float, top: float, right: float, bottom: float) -> Box:
        return bx.clamp(Box(b.x1 - bw * left, b.y1 - bh * top, b.x2 + bw * right, b.y2 + bh * bottom), w, h)

    variants = [
        ("history_original", b, 0.88), ("history_pad_1p10", bx.scale_center(b, w, h, 1.10, 1.10), 0.86),
        ("history_pad_1p25", bx.scale_center(b, w, h, 1.25, 1.18), 0.84),
        ("history_left_leading_zero_pad", padded(0.35, 0.10, 0.12, 0.10), 0.87),
        ("history_right_pad", padded(0.15, 0.10, 0.28, 0.10), 0.82),
        ("history_vertical_pad", padded(0.10, 0.30, 0.10, 0.30), 0.80)]
    frame = F.greatest(F.lit(1.0), (w * h).cast("double"))
    windows = [_window(box, kind, score, (bx.area(box) > 0) & (bx.area(box) / frame <= max_area)) for kind, box, score in variants]
    made = _inline(locks, windows, [*keys, "image_width", "image_height"])
    return greedy_nms(made, keys, "score", 0.92, arrival=["window_index"], limit=None)


class LineAssigner:
    """Put components, by rising centre, on the first text line close enough; holds running means of the lines."""

    def __init__(self, key, least: float, share: float):
        self.key, self.least, self.share, self.lines = key, least, share, []

    def step(self, row):
        cy, h = (row["y1"] + row["y2"]) / 2, row["y2"] - row["y1"]
        for i, line in enumerate(self.lines):
            n, cy_sum, h_sum = line
            if abs(cy - cy_sum / n) <= max(self.least, self.share * max(h, h_sum / n)):
                line[0], line[1], line[2] = n + 1, cy_sum + cy, h_sum + h
                return [(*row.values(), i)]
        self.lines.append([1, cy, h])
        return [(*row.values(), len(self.lines) - 1)]

    def finish(self):
        return []


def component_spans(components: DataFrame, keys: Sequence[str], longest: int = 7, least: float = 8.0, share: float = 0.55,
                    gap_least: float = 8.0, gap_share: float = 1.15) -> DataFrame:
    """Glyph components to text lines, and every run of up to `longest` neighbours on a line to a scored box.
    `components`: keys, x1..y2, image_width, image_height."""
    keys = list(keys)
    rows = components.select(*keys, "x1", "y1", "x2", "y2", "image_width", "image_height",
                             ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    schema = T.StructType([*rows.schema.fields, T.StructField("line", T.IntegerType())])
    lined = ordered_scan(rows, keys, ["cy", "x1", "y1", "x2", "y2"], lambda key: LineAssigner(key, least, share), schema)
    line = Window.partitionBy(*keys, "line")
    heights = lined.groupBy(*keys, "line").agg(F.percentile(F.col("y2") - F.col("y1"), 0.5).alias("_mh"))
    order = line.orderBy("x1", "y1", "x2", "y2")
    parts = lined.join(heights, keys + ["line"])
    gap = F.col("x1") - F.lag("x2").over(order)
    broken = gap > F.greatest(F.lit(gap_least), F.col("_mh") * gap_share)
    parts = parts.withColumn("_break", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("_run", F.sum("_break").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(*keys, "line", "_run").orderBy("x1", "y1", "x2", "y2").rowsBetween(Window.currentRow, longest - 1)
    following = F.collect_list(F.struct("x1", "y1", "x2", "y2")).over(run)
    spans = parts.withColumn("_next", following).select(
        *keys, "line", "image_width", "image_height", "_next", F.explode(F.sequence(F.lit(1), F.size("_next"))).alias("n"))
    group = F.slice("_next", F.lit(1), F.col("n"))
    edge = lambda how, n: how(F.transform(group, lambda c: c[n]))
    spans = spans.select(*keys, "line", "image_width", "image_height", "n", edge(F.array_min, "x1").alias("x1"),
                         edge(F.array_min, "y1").alias("y1"), edge(F.array_max, "x2").alias("x2"), edge(F.array_max, "y2").alias("y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    spans = spans.where((w >= 8) & (h >= 8) & (w / F.greatest(F.lit(1.0), h) <= 7.0))
    box = bx.expand(bx.cols(), F.col("image_width"), F.col("image_height"), F.greatest(F.lit(3.0), h * 0.12), F.greatest(F.lit(2.0), h * 0.10))
    return spans.select(*keys, "line", "n", *bx.named(box), F.lit("component_span").alias("kind"),
                        (F.lit(0.62) + F.least(F.lit(0.18), F.col("n") * 0.02)).alias("score"), "image_width", "image_height")


def consensus_values(value: Column) -> Column:
    """A value with its three- and two-digit prefixes and suffixes."""
    n = F.length(value)
    part = lambda k: F.when(n > k, F.array(F.substring(value, 1, k), F.substring(value, -k, k))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(F.array(value), part(3), part(2))))


def keep_best_hit(hits: DataFrame, keys: Sequence[str], by_source: bool = False, combined: bool = False) -> DataFrame:
    """The most confident hit per value and rounded box (and source). `combined` adds .72 conf + .28 proposal score."""
    spot = [F.bround(F.col(c)).cast("int").alias(f"k_{c}") for c in ("x1", "y1", "x2", "y2")]
    group = [*keys, "text", *[f"k_{c}" for c in ("x1", "y1", "x2", "y2")], *(["source"] if by_source else [])]
    out = best_row(hits.select("*", *spot), group, [F.col("ocr_conf"), -F.col("hit_index")])
    if combined:
        out = out.withColumn("score", F.round(F.col("ocr_conf") * 0.72 + F.col("proposal_score") * 0.28, 6))
    return out.drop(*[f"k_{c}" for c in ("x1", "y1", "x2", "y2")])


def region_hits(hits: DataFrame, k: int = 35, score: str = "ocr_conf") -> DataFrame:
    """Hits numbered inside their region by confidence; the best `k` of the frame. `hits`: image_id, region_index, …"""
    tie = [F.asc("text"), *[F.asc(c) for c in ("x1", "y1", "x2", "y2")]]
    inside = Window.partitionBy("image_id", "region_index").orderBy(F.desc(score), *tie)
    named = hits.withColumn("hit_index", F.row_number().over(inside)).withColumn(
        "candidate_id", F.format_string("slot_prop_%02d_%03d", "region_index", "hit_index"))
    return top_rows(named, ["image_id"], [F.desc(score), F.asc("region_index"), F.asc("hit_index")], k)


def replace_or_append(candidates: DataFrame, hits: DataFrame, slot_only: bool = False) -> DataFrame:
    from framefusion.operators.frames import union_candidates
    if slot_only:
        return hits
    numbered = hits.withColumn("candidate_index", F.col("rank")).drop("rank")
    return union_candidates(candidates, numbered)
