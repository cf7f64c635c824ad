"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Sizes are words. Every source gets a token target (`source_targets`). Document rates closest to 1 in relative entropy, weighted by
words, under those targets are exp(lambda of the source); the dual is convex with a diagonal Hessian, so Newton steps of all sources
run side by side as one expression over the table of sources (`tilted_rates`). Rates become whole copies: every document gets the
whole part; the rest of the target goes, one more copy each, to documents in the order of a hash until the next would pass it, and the
gap that is left to the largest documents that still fit, until none does. So a source misses its target by less than its smallest
unchosen document, or by what no document can fill.

Defined results: null texts have size 0; documents without words are taken 0 times their size; a null source is a source of its own,
last in order; rows equal in id, source and size share one decision; an empty table gives an empty result. Equal input gives equal
output, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.llm.storage import broadcast_if_small, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 2_000
STEPS = 80


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add `target` to a table (source, source_size): the weights repeat over the sources in code point order, null last, and
    share the sum of all sizes. A target stops at `most` times its source's size; the excess is shared by weight among the rest.

    With sources by cap/weight, the capped ones are a prefix, and the common level of the rest is the largest of the levels
    (total - caps before) / (weights from here). One row per source goes through these windows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                      (F.row_number().over(order) - 1) % len(weights) + 1))
    cap = F.col("source_size") * float(most)
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (table.withColumn("level", level).withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(cap, F.col("level") * F.col("weight"))).drop("level"))


def tilted_rates(targets: DataFrame) -> DataFrame:
    """Add `lambda` and `rate` = exp(lambda): the stationary point of sum(source_size * exp(lambda)) - lambda * target.

    The gradient of a source is source_size * exp(lambda) - target and its curvature source_size * exp(lambda). Steps are held
    to 2 so that far targets cannot throw a source off; convergence is quadratic from there."""
    def step(now: Column, _: Column) -> Column:
        return now + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("target") / (F.col("source_size") * F.exp(now)) - 1))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    return (targets.withColumn("lambda", F.when((F.col("source_size") > 0) & (F.col("target") > 0), solved))
            .withColumn("rate", F.coalesce(F.exp("lambda"), F.lit(0.0))))


def _fills(free: DataFrame, gaps: DataFrame) -> DataFrame:
    """(sk, words, all, last): the sizes taken to fill the gaps (sk, gap, below); of a size not taken whole (`all`), the documents from
    place `last` on, struct(block, at).

    Documents go from the largest to the smallest, each taken if it still fits. Only the table of sizes is walked, in rounds of running
    sums: a round takes sizes whole until one does not fit whole, and of that one as many documents as fit. That leaves less than half of
    the gap, so the rounds are at most the binary digits of the widest gap; they end when nothing fits."""
    sizes = stored(free.groupBy("sk", "words").agg(F.count(F.lit(1)).alias("n")), "mix-fill-sizes")
    descending = Window.partitionBy("sk").orderBy(F.col("words").desc()).rowsBetween(Window.unboundedPreceding, 0)
    taken = None
    while True:
        side = broadcast_if_small(stored(gaps, "mix-gaps"))
        fit = sizes.join(side, "sk").where((F.col("words") <= F.col("gap")) & (F.col("below").isNull() | (F.col("words") < F.col("below"))))
        fit = fit.withColumn("left", F.col("gap") - F.sum(F.col("words") * F.col("n")).over(descending) + F.col("words") * F.col("n"))
        step = stored(fit.where("left >= 0").withColumn("take", F.least(F.col("n"), F.expr("left div words"))).select(
            "sk", "words", "n", "take", (F.col("left") - F.col("take") * F.col("words")).alias("left")), "mix-fills")
        taken = step if taken is None else taken.unionByName(step)
        if step.limit(1).count() == 0:
            break
        gaps = step.groupBy("sk").agg(F.min_by("left", "words").alias("gap"), F.min("words").alias("below"))
    taken = taken.where("take > 0").select("sk", "words", "n", "take")
    # Of a size taken in part: the block that holds its last document by counts of blocks, then the place inside this block.
    part = free.join(broadcast_if_small(taken.where("take < n").drop("n")), ["sk", "words"])
    counts = part.groupBy("sk", "words", "block").agg(F.count(F.lit(1)).alias("n"), F.max("take").alias("take"))
    counts = (counts.withColumn("upto", F.sum("n").over(Window.partitionBy("sk", "words").orderBy(F.col("block").desc())
                                                        .rowsBetween(Window.unboundedPreceding, 0)))
              .where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
              .select("sk", "words", "block", (F.col("take") - F.col("upto") + F.col("n")).alias("nth")))
    inside = Window.partitionBy("sk", "words").orderBy(F.col("at").desc())
    last = (part.select("sk", "words", "block", "at").join(broadcast_if_small(stored(counts, "mix-last")), ["sk", "words", "block"])
            .withColumn("k", F.row_number().over(inside)).where("k = nth").select("sk", "words", F.struct("block", "at").alias("last")))
    return stored(taken.select("sk", "words", (F.col("take") == F.col("n")).alias("all")).join(last, ["sk", "words"], "left"), "mix-filled")


def balanced_copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                    weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per distinct (key, source, size): `multiplicity` of that row, `source_size`, `target`, `rate` and `copies`."""
    sized = (docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
             .groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("multiplicity")))
    sized = stored(sized.withColumn("words", F.col("size") * F.col("multiplicity")).withColumn("hash", F.md5(F.coalesce(
        F.col("key").cast("string"), F.lit("")))), "mix-sizes")
    sources = (sized.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n")))
    plan = (tilted_rates(source_targets(sources, weights))
            .withColumn("base", F.least(F.lit(MOST_COPIES).cast("long"), F.floor(F.col("rate") + 1e-9)))
            .withColumn("rest", F.when(F.col("base") < MOST_COPIES, F.greatest(
                F.lit(0).cast("long"), F.round("target").cast("long") - F.col("base") * F.col("source_size"))).otherwise(0))
            .select(_source_key(F.col("source")).alias("sk"), "source_size", "n", "target", "rate", "base", "rest"))
    plan = broadcast_if_small(stored(plan, "mix-plan"))
    # Running sums in hash order without a window over a whole source: blocks of the hash range, then sums of blocks.
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / 2.0 ** 32
    keyed = (sized.withColumn("sk", _source_key(F.col("source"))).join(plan, "sk")
             .withColumn("block", F.floor(place * F.ceil(F.col("n") / BLOCK_ROWS))))
    inside = Window.partitionBy("sk", "block").orderBy("hash", "key", "size")
    ranked = keyed.withColumn("at", F.row_number().over(inside)).withColumn(
        "upto", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = keyed.groupBy("sk", "block").agg(F.sum("words").alias("block_words"))
    blocks = blocks.select("sk", "block", F.coalesce(F.sum("block_words").over(
        Window.partitionBy("sk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = stored(ranked.join(blocks, ["sk", "block"]).withColumn("upto", F.col("upto") + F.col("earlier")).drop("earlier"), "mix-ranks")
    gaps = ranked.groupBy("sk").agg((F.max("rest") - F.sum(F.when(F.col("upto") <= F.col("rest"), F.col("words")).otherwise(0)))
                                    .alias("gap"), F.lit(None).cast("long").alias("below"))
    free = ranked.where((F.col("upto") > F.col("rest")) & (F.col("rest") > 0) & (F.col("words") > 0))
    fills = broadcast_if_small(_fills(free, gaps))
    spot = F.struct("block", "at")
    more = (F.col("upto") <= F.col("rest")) | F.coalesce((F.col("words") > 0) & (F.col("rest") > 0) & (
        F.col("all") | (spot >= F.col("last"))), F.lit(False))
    return ranked.join(fills, ["sk", "words"], "left").select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "multiplicity", "source_size", "target", "rate",
        F.least(F.lit(MOST_COPIES).cast("long"), F.col("base") + more.cast("long")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, size, source_size, target of its source, rate, copies, and `taken` = copies * size."""
    copies = balanced_copies(docs, key, source, text)
    each = copies.withColumn("_row", F.explode(F.expr("sequence(1L, multiplicity)")))
    return each.select(key, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the mix takes at least once, with their columns and `copies`."""
    chosen = balanced_copies(docs, key, source, text).where("copies > 0").toDF(
        "_key", "_source", "_size", "_multiplicity", "_source_size", "_target", "_rate", "_copies")
    same = (docs[key].eqNullSafe(chosen["_key"]) & docs[source].cast("string").eqNullSafe(chosen["_source"])
            & (word_count(docs[text]) == chosen["_size"]))
    return docs.join(chosen, same).select(*[docs[c] for c in docs.columns if c != "copies"], chosen["_copies"].alias("copies"))
