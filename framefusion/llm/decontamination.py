"""Benchmark decontamination by template windows, in DataFrame functions only.

A text has two forms, one token for one token. Its template: punctuation goes, letters become lower case, and numbers, names and units
become typed placeholders, by rules that do not look at what stands around a name. Its plain form: the words in lower case without marks
at their edges. Windows of `WIDTH` tokens are hashed; the windows of all documents meet those of the benchmark in one hash join for
each form. A re-parameterised question matches by its template. Its slots are then read back from the texts: within one alignment of a
document and an item, every value of the item must stand for one value of the document, or the alignment is dropped. A copied passage
matches by its plain windows as well, whatever its templates hold and whatever values were altered elsewhere in it. A document leaks
an item when its consistent alignments cover at least `COVER` of the item's template windows, or its plain windows at least `COVER` of
all windows of the item.

Defined results: null and empty texts match nothing; items with fewer than `LITERALS` tokens cannot be told and match nothing, templates with
fewer plain tokens match by the plain form alone; items shorter than a window are one window; rows equal in id and text are all reported; repeated items are reported for each id; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.llm.storage import broadcast_if_small, stored

WIDTH, LITERALS, COVER = 8, 4, 0.3
# Unit words after a number, and number words.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms "
    "ton tons ml cl l liter liters litre litres gallon gallons pint pints s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years mph kmh percent dollar dollars euro euros pound pounds cent cents hz khz mhz ghz v w kw j "
    "kj cal kcal pa kpa degree degrees kb mb gb tb meter meters metre metres kilometer kilometers kilometre kilometres")
NUMBERS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion")
# Capitalised words that are no names wherever they stand.
FIRST = (
    "The An This That These Those There Here It Its He She They We You His Her Their Our Your My In On At To Of For From By With Without "
    "Within Into Over Under Between Among After Before During Since Until While When Where Why How What Which Who Whom Whose If Then Than "
    "And Or But Nor So Yet As Is Are Was Were Be Been Being Do Does Did Has Have Had Can Could Will Would Shall Should May Might Must Not "
    "No Yes All Any Both Each Every Some Many Much More Most Few Several Such Other Another Only Also Now Once Because Although Though "
    "However Therefore Thus Hence Let Given Suppose Assume Consider Find Compute Calculate Determine Solve Prove Show Explain Describe "
    "List Name State Choose Select Write Give Use Using Well Please Question Answer Note Today Yesterday Tomorrow")
NUM, NAME, UNIT = "\u0001n", "\u0001p", "\u0001u"

# Most characters are small letters and spaces: every pattern refuses them by one cheap test before it looks at classes and word lists.
_RARE = r"(?=[^a-z ])"
_FREE = r"(?<![a-z])(?<![\p{L}\p{N}\u0001])"
_MARK = r"[^\p{L}\p{N}\s]"


def _any_of(words: str) -> str:
    """A pattern for any of the words in either case, by first letters."""
    rest = {first: "|".join(w[1:] for w in words.split() if w[0] == first) for first in sorted({w[0] for w in words.split()})}
    return "(?:" + "|".join(f"[{a}{a.upper()}](?i:{b})" for a, b in rest.items()) + ")"


_NAME = _RARE + r"(?=\p{Lu}\p{Ll})" + _FREE + r"(?!(?:" + FIRST.replace(" ", "|") + r")(?![\p{L}\p{N}]))\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_NUMBER = (r"(?=[\p{N}" + "".join(sorted({w[0] + w[0].upper() for w in NUMBERS.split()})) + r"])" + _FREE
           + r"(?:\p{N}++(?:[.,:/]\p{N}++)*+|" + _any_of(NUMBERS) + r"(?![\p{L}\p{N}]))")
# Tokens of marks alone do not part a number from its unit.
_UNIT_AFTER = r"(\u0001n\S*+\s++(?:" + _MARK + r"++\s++)*+)" + _any_of(UNITS) + r"(?![\p{L}\p{N}])"
_UNIT_ON = r"(\u0001n)" + _any_of(UNITS) + r"(?![\p{L}\p{N}])"
_EDGES = _RARE + r"(?:(?<!\S)" + _MARK + r"++|" + _MARK + r"++(?!\S))"
_MARKS = _RARE + r"[^\p{L}\p{N}\s\u0001]++"


def _whole(text: Column) -> Column:
    """The text without control marks."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.lit(" "))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def raw_tokens(text: Column) -> Column:
    """The tokens that hold a letter or digit as written, aligned with `template_tokens` and `plain_tokens`."""
    return F.filter(F.split(_whole(text), r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def plain_tokens(text: Column) -> Column:
    """Lower-case tokens without marks at their edges; tokens of marks alone are gone."""
    return _tokens(F.lower(F.regexp_replace(_whole(text), _EDGES, "")))


def template_tokens(text: Column) -> Column:
    """Lower-case tokens with typed placeholders; tokens of marks alone are gone."""
    out = F.regexp_replace(_whole(text), _NAME, NAME)
    out = F.regexp_replace(out, _NUMBER, NUM)
    out = F.regexp_replace(F.regexp_replace(out, _UNIT_AFTER, "$1" + UNIT), _UNIT_ON, "$1" + UNIT)
    return _tokens(F.lower(F.regexp_replace(out, _MARKS, "")))


def _joined(left: Column, a: int, right: Column) -> Column:
    """Windows of a+b tokens from windows of a and of b tokens: the second starts a tokens later."""
    n = F.greatest(F.lit(0), F.size(right) - a)
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(a + 1), n), lambda x, y: F.xxhash64(x, y))


def with_windows(df: DataFrame, tokens: str, widths: list[int]) -> DataFrame:
    """Add w<width>, the hashes of all windows of each width (1 to 8), built by doubling."""
    df = df.withColumn("w1", F.transform(tokens, lambda t: F.xxhash64(t)))
    needed = [w for w in range(2, max(widths) + 1) if w in (2, 4) or w in widths or (w == 6 and 7 in widths)]
    for w in needed:
        a = {2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 6, 8: 4}[w]
        df = df.withColumn(f"w{w}", _joined(F.col(f"w{a}"), a, F.col(f"w{w - a}")))
    return df


FORMS = {"template": template_tokens, "plain": plain_tokens}


def benchmark_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, form, item_pos, width, window, item_windows) of the template windows that hold enough plain tokens and of all plain windows,
    and the item's raw tokens."""
    forms = [benchmark.select(F.col(item).alias("item"), F.lit(form).alias("form"), raw_tokens(F.col(text)).alias("item_raw"),
                              tokens_of(F.col(text)).alias("tokens")) for form, tokens_of in FORMS.items()]
    items = forms[0].unionByName(forms[1]).where(F.size("tokens") >= LITERALS)
    items = with_windows(items, "tokens", list(range(LITERALS, WIDTH + 1)))
    width = F.least(F.lit(WIDTH), F.size("tokens"))
    chosen = F.coalesce(*[F.when(width == w, F.col(f"w{w}")) for w in range(LITERALS, WIDTH + 1)])
    literal = F.transform("tokens", lambda t: (~t.startswith("\u0001")).cast("int"))
    each = (items.select("item", "form", "item_raw", literal.alias("literal"), width.alias("width"), F.posexplode(chosen).alias("item_pos", "window"))
            .where(F.aggregate(F.slice("literal", F.col("item_pos") + 1, F.col("width")), F.lit(0), lambda s, x: s + x) >= LITERALS))
    totals = each.groupBy("item", "form").agg(F.countDistinct("item_pos").alias("item_windows"))
    return each.drop("literal").join(totals, ["item", "form"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", cover: float = COVER) -> DataFrame:
    """One row per document and item it leaks: key, `text_hash` of the document, item, matched `windows`, `item_windows`, `cover`,
    `slots` (placeholder pairs seen) and `changed_slots` (pairs whose values differ), both 0 where only plain windows tell the leak.
    Of the two forms the one that covers more of the item is reported, the template if both cover the same."""
    known = stored(benchmark_windows(benchmark, item, item_text), "bench-windows")
    widths = sorted({WIDTH} | {r.width for r in known.select("width").distinct().collect()})  # at most WIDTH values
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    short = known.select("window", "form", "width", "item", "item_pos", "item_windows")
    side = broadcast_if_small(short, 200_000)
    found = None
    for form, tokens_of in FORMS.items():
        scanned = with_windows(texts.select("key", "text_hash", tokens_of(F.col("text")).alias("tokens")), "tokens", widths)
        for w in widths:
            # The outer form: for the inner one the optimiser adds a filter on the array and, pushing it to the scan, unfolds the
            # doubling steps into one expression that makes every window many times over.
            each = scanned.select("key", "text_hash", F.posexplode_outer(f"w{w}").alias("pos", "window")).where(F.col("window").isNotNull())
            mine = side.where((F.col("width") == w) & (F.col("form") == form)).drop("width")
            hit = each.join(mine, "window").withColumn("width", F.lit(w)).drop("window")
            found = hit if found is None else found.unionByName(hit)
    # Equal rows would double their windows; one of each is enough here.
    found = stored(found.dropDuplicates(["key", "text_hash", "form", "item", "pos", "item_pos"]), "bench-hits")
    copied = (found.where("form = 'plain'").groupBy("key", "text_hash", "item").agg(
        F.countDistinct("item_pos").alias("windows"), F.max("item_windows").alias("item_windows"))
        .withColumns({"slots": F.lit(0), "changed_slots": F.lit(0), "form": F.lit(0)}))
    found = found.where("form = 'template'")
    aligned = found.withColumn("shift", F.col("pos") - F.col("item_pos"))
    group = ["key", "text_hash", "item", "shift"]
    runs = aligned.groupBy(*group).agg(F.collect_set("item_pos").alias("places"), F.max("width").alias("width"),
                                       F.max("item_windows").alias("item_windows"))
    # Texts of the matching documents only, once each, to read the slots.
    matching = broadcast_if_small(found.select("key", "text_hash").distinct(), 100_000)
    bare = (texts.join(matching.toDF("mkey", "mhash"), F.col("key").eqNullSafe(F.col("mkey")) & (F.col("text_hash") == F.col("mhash")))
            .select(F.col("key").alias("dkey"), F.col("text_hash").alias("dhash"), raw_tokens(F.col("text")).alias("doc_raw"),
                    template_tokens(F.col("text")).alias("doc_tokens")))
    # Made before the rows are merged: inside the lambda below, the optimiser would read the text anew for every slot.
    bare = bare.groupBy("dkey", "dhash").agg(F.first("doc_raw").alias("doc_raw"), F.first("doc_tokens").alias("doc_tokens"))
    raw = known.dropDuplicates(["item"]).select(F.col("item").alias("ritem"), "item_raw")
    seen = (runs.join(broadcast_if_small(raw), F.col("item").eqNullSafe(F.col("ritem")))
            .join(bare, F.col("key").eqNullSafe(F.col("dkey")) & (F.col("text_hash") == F.col("dhash"))))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    strip = lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    slots = F.filter(
        F.transform(places, lambda p: F.struct(
            F.get("doc_tokens", p + F.col("shift")).alias("kind"), strip(F.get("item_raw", p)).alias("was"),
            strip(F.get("doc_raw", p + F.col("shift"))).alias("now"))),
        lambda s: s["kind"].startswith("\u0001"))
    pairs = F.array_distinct(F.col("slots"))
    sources = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["was"])))
    consistent = (seen.select(*group, "places", "item_windows", slots.alias("slots"))
                  .where(F.size(pairs) == F.size(sources))
                  .select(*group, F.explode("places").alias("place"), "item_windows", F.size(pairs).alias("slots"),
                          F.size(F.filter(pairs, lambda s: s["was"] != s["now"])).alias("changed_slots")))
    judged = consistent.groupBy("key", "text_hash", "item").agg(
        F.countDistinct("place").alias("windows"), F.max("item_windows").alias("item_windows"), F.max("slots").alias("slots"),
        F.max("changed_slots").alias("changed_slots"))
    judged = (judged.withColumn("form", F.lit(1)).unionByName(copied).withColumn("cover", F.col("windows") / F.col("item_windows"))
              .where(F.col("cover") >= cover).groupBy("key", "text_hash", "item")
              .agg(F.max(F.struct("cover", "form", "windows", "item_windows", "slots", "changed_slots")).alias("best"))
              .select("key", "text_hash", "item", "best.*"))
    return judged.select(F.col("key").alias(key), "text_hash", F.col("item").alias(item), "windows", "item_windows", "cover", "slots",
                         "changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The documents that leak nothing, with their columns."""
    bad = leaks(docs, benchmark, key, text, item, item_text).select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    bad = broadcast_if_small(stored(bad, "bench-leaking"), 1_000_000)
    same = docs[key].eqNullSafe(bad["_key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
